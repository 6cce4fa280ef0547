"""Writers, full refresh, export and clearing.

A refresh writes a complete new version next to the old one; readers go by the newest
version whose write was committed, so a lost job leaves the previous one in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    MapType,
    NumericType,
    DecimalType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from .. import fixed_values as fixed
from ..functions.text import iso_format
from ..operators.quality import layout
from ..operators.stats import table_counts
from .readers import path_exists


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines that keep null fields."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_products(df: DataFrame, path: str, form: str = "json") -> None:
    if form == "json":
        write_json(df, path)
    else:
        df.write.mode("overwrite").format(form).save(path)


def append_reviews(df: DataFrame, path: str) -> None:
    """Only the new rows are written; what is stored stays untouched."""
    df.write.mode("append").parquet(path)


def write_ratings_map(ratings: DataFrame, path: str) -> None:
    """One JSON object keyed by URL per line, the form ``read_ratings_map`` reads."""
    value = F.struct(*[c for c in ratings.columns if c != "product_url"])
    ratings.select(
        F.to_json(F.create_map("product_url", value), {"ignoreNullFields": "false"}).alias("value")
    ).write.mode("overwrite").text(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions under ``path``, oldest first (a listing, no data is read)."""
    if not path_exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(where)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    return sorted(
        n for n in numbers if path_exists(spark, f"{path}/version={n}/_SUCCESS")
    )


def write_version(df: DataFrame, path: str) -> int:
    number = max(_versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no committed version under {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def full_refresh_load(
    products: DataFrame, reviews: DataFrame | None, products_path: str, reviews_path: str
) -> None:
    """Replace both tables. An empty review table replaces the old one as well; only a
    missing one (None) leaves it as it is."""
    write_version(products, products_path)
    if reviews is not None:
        write_version(reviews, reviews_path)


def export_value(value: Column, kind: DataType) -> Column:
    """Times as ISO text, JSON-ready values as they are, anything else as text."""
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return iso_format(value)
    plain = (StringType, BooleanType, ArrayType, MapType, StructType)
    if isinstance(kind, plain) or (
        isinstance(kind, NumericType) and not isinstance(kind, DecimalType)
    ):
        return value
    return value.cast("string")


def export_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *[export_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]
    )


def export_collection(df: DataFrame, path: str) -> None:
    write_json(export_columns(df), path)


def write_layout(df: DataFrame, path: str, partition: str, *order: str) -> None:
    layout(df, partition, *order).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_clustered(
    df: DataFrame, path: str, key: str, *also: str, distinct: int = 1_000_000, files: int | None = None
) -> None:
    """Write ``df`` so that a lookup by ``key`` reads next to nothing, one by ``also`` little.

    Rows are ranged and sorted by ``key``, so a value lies in one or two files and its row group
    is found by its range. Columns of ``also`` lie anywhere; Parquet Bloom filters, sized for
    ``distinct`` values per row group, exclude most row groups. ``files`` is decided by Spark
    where it is not given.
    """
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key, *also).write.mode("overwrite")
    for column in (key, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)
        )
    writer.parquet(path)


def clear_tables(spark: SparkSession, confirm: str, **paths: str) -> DataFrame:
    """Empty the tables at ``paths`` if ``confirm`` is the agreed word.

    Returns one row per table: rows before, deleted, remaining.
    """
    before = table_counts(**{n: spark.read.parquet(p) for n, p in paths.items()})
    # One number per table name: read now, because the files are about to go.
    counts = {row["collection"]: row["documents"] for row in before.toLocalIterator()}
    if confirm == fixed.CLEAR_CONFIRMATION and counts["total"] > 0:
        for path in paths.values():
            empty = spark.createDataFrame([], spark.read.parquet(path).schema)
            empty.write.mode("overwrite").parquet(path)
    after = table_counts(**{n: spark.read.parquet(p) for n, p in paths.items()})
    known = F.create_map(*[F.lit(x) for item in counts.items() for x in item])
    had = known[F.col("collection")]
    return after.select(
        "collection",
        had.alias("before"),
        (had - F.col("documents")).alias("deleted"),
        F.col("documents").alias("remaining"),
    )
