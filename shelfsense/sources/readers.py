"""Readers with fixed schemas.

JSON lines and Parquet split over tasks. A single JSON array or object per file
(``multi_line``) does not, and is kept for files written by other tools.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from .. import schemas
from ..operators.joins import estimated_bytes, last_per_key, session_conf
from ..operators.products import TEXT_FIELDS


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where) and files.getFileStatus(where).isFile()


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table smaller than one file split, hashed over all cores by ``key``.

    A small file is a single row group, which a single task would have to process. Larger
    tables come in enough splits, and pass through without a shuffle.
    """
    spark = df.sparkSession
    size, split = estimated_bytes(df), session_conf(spark).filesMaxPartitionBytes()
    if size is None or size > split:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def read_products(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.PRODUCT_RAW,
    multi_line: bool = False,
    mark_nulls: bool = False,
) -> DataFrame:
    """Raw products; a missing path or a malformed record is an error.

    ``mark_nulls`` (JSON lines) adds ``null_fields``, the text fields that are present
    but null, which a schema alone cannot tell from absent ones.
    """
    if not mark_nulls:
        return (
            spark.read.schema(schema)
            .option("multiLine", multi_line)
            .option("mode", "FAILFAST")
            .json(path)
        )
    document = F.parse_json("value")
    names = [
        F.when(F.is_variant_null(F.variant_get(document, f"$.{f}", "variant")), F.lit(f))
        for f in TEXT_FIELDS
    ]
    return (
        spark.read.text(path)
        .select(
            F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"),
            F.array_compact(F.array(*names)).alias("null_fields"),
        )
        .select("r.*", "null_fields")
    )


class Checked(NamedTuple):
    """What a reader could use, what it could not, and the counts of both from the same scan.

    ``counts`` (rows ``read`` and ``rejected``) fill in while ``rows`` is written.
    """

    rows: DataFrame
    rejects: DataFrame
    counts: Observation


def _checked(parsed: DataFrame, columns: list[str], broken: Column, name: str) -> Checked:
    counts = Observation(name)
    watched = parsed.observe(counts, F.count_if(~broken).alias("read"), F.count_if(broken).alias("rejected"))
    rejects = parsed.where(broken).select(F.col("_record").alias("record"), F.col("_file").alias("file"))
    return Checked(watched.where(~broken).select(*columns), rejects, counts)


def read_reviews_checked(
    spark: SparkSession, path: str, schema: StructType = schemas.REVIEW, multi_line: bool = False
) -> Checked:
    """Stored reviews; records that are no JSON or do not fit the schema are kept as ``rejects``.

    A record with one field of a wrong type is rejected whole. Blank lines are no records. A
    missing path is an empty table without rejects.
    """
    if path_exists(spark, path):
        lines = spark.read.text(path, wholetext=multi_line).select(
            F.col("value").alias("_record"), F.col("_metadata.file_path").alias("_file")
        )
    else:
        lines = spark.createDataFrame([], "_record string, _file string")
    lines = lines.where(F.trim("_record") != "")
    if multi_line:  # an array or a single object per file, usable or not as a whole
        records = F.from_json("_record", ArrayType(schema))
        read = F.when(records.isNull(), F.array(F.lit(None).cast(schema))).otherwise(records)
        parsed = lines.select("_record", "_file", records.isNull().alias("_broken"), F.explode(read).alias("_r"))
    else:
        mark = StructType([*schema.fields, StructField("_bad", StringType())])
        record = F.from_json("_record", mark, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        parsed = lines.select("_record", "_file", record.alias("_r")).withColumn("_broken", F.col("_r._bad").isNotNull())
    parsed = parsed.select("_record", "_file", "_broken", *[F.col(f"_r.{c}").alias(c) for c in schema.names])
    return _checked(parsed, schema.names, F.col("_broken"), "reviews")


def read_reviews(
    spark: SparkSession,
    path: str,
    schema: StructType = schemas.REVIEW,
    multi_line: bool = False,
) -> DataFrame:
    """Stored reviews without the broken ones, which ``read_reviews_checked`` gives as well."""
    return read_reviews_checked(spark, path, schema, multi_line).rows


def read_ratings_checked(
    spark: SparkSession, path: str, schema: StructType = schemas.PRODUCT_RATING,
    whole_files: bool = False,
) -> Checked:
    """Rating summaries from JSON objects keyed by URL, one row per URL, and unreadable lines.

    One object per line splits over tasks; ``whole_files`` reads one object per file. Of several
    lines with one URL the last wins, files in the order of their names. A missing path is an empty
    table without rejects.
    """
    fields = StructType([f for f in schema.fields if f.name != "product_url"])
    # JSON knows text keys only, so maps are read with those and cast afterwards.
    textual = StructType(
        [
            StructField(f.name, MapType(StringType(), f.dataType.valueType))
            if isinstance(f.dataType, MapType)
            else f
            for f in fields
        ]
    )
    columns = ["product_url", *fields.names]
    if path_exists(spark, path):
        lines = spark.read.text(path, wholetext=whole_files).select(
            F.col("value").alias("_record"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),  # grows within a file's block
        ).where(F.trim("_record") != "")
    else:
        lines = spark.createDataFrame([], "_record string, _file string, _start bigint, _line bigint")
    lines = lines.withColumn("_entries", F.from_json("_record", f"map<string,{textual.simpleString()}>"))
    counts = Observation("ratings")
    broken = F.col("_entries").isNull()
    watched = lines.observe(counts, F.count_if(~broken).alias("read"), F.count_if(broken).alias("rejected"))
    entries = watched.select(F.explode("_entries").alias("product_url", "_r"), "_file", "_start", "_line")
    last = last_per_key(entries, "product_url", "_file", "_start", "_line")
    rows = last.select("product_url", *[F.col(f"_r.{f.name}").cast(f.dataType).alias(f.name) for f in fields])
    rejects = lines.where(broken).select(F.col("_record").alias("record"), F.col("_file").alias("file"))
    return Checked(rows.select(*columns), rejects, counts)


def read_ratings_map(
    spark: SparkSession, path: str, schema: StructType = schemas.PRODUCT_RATING,
    whole_files: bool = False,
) -> DataFrame:
    """Rating summaries, one row per URL; unreadable lines are in ``read_ratings_checked``."""
    return read_ratings_checked(spark, path, schema, whole_files).rows


def scan_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; a page whose file could not be read is not in the table."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Pages saved one per file; the file name stands for the address."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
