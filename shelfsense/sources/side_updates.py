"""A stored table whose keyed updates do not rewrite it.

The table lies under ``base`` in buckets by the hash of its key. Updates are appended under
``updates/run=N`` in the same buckets, so a run writes what it changes and nothing else. Reading
merges: buckets without updates are read as they are, the others are joined with the newest
value of every updated column. Compacting writes the touched buckets anew, by overwriting just
these partitions, and drops the updates; files of other buckets keep their names. A compaction that
was interrupted can be run again: setting the same values twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from .readers import _file_system, path_exists

BUCKETS = 64
BUCKET = "_bucket"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bucket_of(key: str | Sequence[str], buckets: int = BUCKETS) -> Column:
    """The bucket follows from the first key column alone, so that all rows of it lie together."""
    return F.pmod(F.xxhash64(_keys(key)[0]), F.lit(buckets)).cast("int")


def create_table(df: DataFrame, path: str, key: str | Sequence[str], buckets: int = BUCKETS) -> None:
    """Write ``df`` as a table that takes updates. A bucket too large for one task is split."""
    placed = df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/base")


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Committed runs of updates, oldest first."""
    if not path_exists(spark, f"{path}/updates"):
        return []
    files, where = _file_system(spark, f"{path}/updates")
    names = [status.getPath().getName() for status in files.listStatus(where)]
    numbers = sorted(int(name.split("=")[1]) for name in names if name.startswith("run="))
    return [n for n in numbers if path_exists(spark, f"{path}/updates/run={n}/_SUCCESS")]


def append_updates(updates: DataFrame, path: str, key: str | Sequence[str], buckets: int = BUCKETS) -> int:
    """Store a run of updates: the key, each once, and the columns to set (also to NULL)."""
    number = max(_runs(updates.sparkSession, path), default=0) + 1
    placed = updates.withColumn(BUCKET, bucket_of(key, buckets))
    placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/updates/run={number}")
    return number


def _newest(spark: SparkSession, path: str, keys: list[str]) -> tuple[DataFrame, list[str]] | None:
    """Per key the newest value ``_new_c`` of every updated column c, and whether it was set (``_set_c``)."""
    runs = {n: spark.read.parquet(f"{path}/updates/run={n}") for n in _runs(spark, path)}
    if not runs:
        return None
    columns = list(dict.fromkeys(c for run in runs.values() for c in run.columns if c not in (*keys, BUCKET)))
    every = None
    for number, run in runs.items():
        # A run speaks for the columns it has; the others stay as earlier runs left them.
        has = [c for c in columns if c in run.columns]
        one = run.select(
            BUCKET, *keys, *[F.struct(F.lit(number).alias("run"), F.col(c).alias("value")).alias(f"_new_{c}") for c in has]
        )
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    newest = every.groupBy(BUCKET, *keys).agg(
        *[F.max_by(f"_new_{c}", F.col(f"_new_{c}.run")).alias(f"_new_{c}") for c in columns]
    )
    return newest, columns


def _merged(base: DataFrame, newest: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    joined = lookup_join(base, newest, [BUCKET, *keys])
    values = []
    for column in dict.fromkeys([*base.columns, *columns]):
        if column not in columns:
            values.append(F.col(column))
            continue
        new = F.col(f"_new_{column}")
        old = F.col(column) if column in base.columns else F.lit(None)
        values.append(F.when(new.isNotNull(), new["value"]).otherwise(old).alias(column))
    return joined.select(*values)


def _base(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; buckets compacted since may have more columns than the others."""
    return spark.read.option("mergeSchema", True).parquet(f"{path}/base")


def _touched(newest: DataFrame) -> list[int]:
    """Buckets with updates: at most as many as there are buckets."""
    return sorted(row[0] for row in newest.select(BUCKET).distinct().collect())


def read_table(spark: SparkSession, path: str, key: str | Sequence[str]) -> DataFrame:
    """The table with all updates applied; buckets without updates are only read."""
    keys, base = _keys(key), _base(spark, path)
    found = _newest(spark, path, keys)
    if found is None:
        return base.drop(BUCKET)
    newest, columns = found
    touched = _touched(newest)
    merged = _merged(base.where(F.col(BUCKET).isin(touched)), newest, keys, columns)
    rest = base.where(~F.col(BUCKET).isin(touched))
    return merged.unionByName(rest, allowMissingColumns=True).drop(BUCKET)


def compact_table(spark: SparkSession, path: str, key: str | Sequence[str]) -> list[int]:
    """Write the updates into the table; the buckets that were written anew."""
    keys, base = _keys(key), _base(spark, path)
    found, runs = _newest(spark, path, keys), _runs(spark, path)
    if found is None:
        return []
    newest, columns = found
    touched = _touched(newest)
    merged = _merged(base.where(F.col(BUCKET).isin(touched)), newest, keys, columns)
    merged.hint("rebalance", BUCKET).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(BUCKET).parquet(f"{path}/base")
    files, _ = _file_system(spark, path)
    for number in runs:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/updates/run={number}"), True)
    return touched
