"""Which keys earlier batches have written, without reading their output again.

Next to the output lies an index. Every batch adds its new keys, in folders by hash, and a bitmap
of all keys so far, which has a fixed width. A batch reads the newest bitmap; only keys that
may be known are looked up, in the folders they fall into. So what a batch reads depends on the
batch and on the bitmap's width, not on how much has been written before. Files are written under
the batch number: a batch that is repeated replaces its own and never sees them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bitmaps import bitmap_of, union_of, width_for, with_membership
from ..operators.joins import first_per_key
from ..sources.readers import _file_system, path_exists
from .jobs import run_available

FOLDERS = 256


class KeyIndex:
    """The index at ``path`` over values of ``key``; ``expected`` keys fix the bitmap's width.

    More keys than expected cost look-ups, never results.
    """

    def __init__(self, path: str, key: str, expected: int = 1_000_000, folders: int = FOLDERS):
        self.path, self.key, self.folders = path, key, folders
        self.width = width_for(expected)

    def _folder(self):
        return F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(self.folders)).cast("int")

    def _before(self, spark: SparkSession, batch_id: int) -> list[int]:
        """Earlier batches in the index, oldest first."""
        if not path_exists(spark, f"{self.path}/bitmap"):
            return []
        files, where = _file_system(spark, f"{self.path}/bitmap")
        numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where))
        return [n for n in numbers if n < batch_id and path_exists(spark, f"{self.path}/bitmap/batch={n}/_SUCCESS")]

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Those of ``keys`` (one column, distinct) that earlier batches have added."""
        spark = keys.sparkSession
        before = self._before(spark, batch_id)
        if not before:
            return keys.limit(0)
        bitmap = spark.read.parquet(f"{self.path}/bitmap/batch={before[-1]}")
        likely = with_membership(keys, self.key, bitmap, self.width, "_likely").where("_likely")
        likely = likely.select(self.key, self._folder().alias("folder"))
        wanted = [row[0] for row in likely.select("folder").distinct().collect()]  # at most ``folders``
        paths = [
            path for n in before for f in wanted
            if path_exists(spark, path := f"{self.path}/keys/batch={n}/folder={f}")
        ]
        if not paths:
            return keys.limit(0)
        stored = spark.read.schema(keys.schema).parquet(*paths)
        return likely.join(stored, self.key, "left_semi").select(self.key)

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Add the distinct new ``keys`` of a batch."""
        spark = keys.sparkSession
        before = self._before(spark, batch_id)
        keys.withColumn("folder", self._folder()).repartition("folder").write.mode("overwrite").partitionBy(
            "folder"
        ).parquet(f"{self.path}/keys/batch={batch_id}")
        parts = [bitmap_of(keys, self.key, self.width)]
        if before:
            parts.append(spark.read.parquet(f"{self.path}/bitmap/batch={before[-1]}"))
        union_of(*parts).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bitmap/batch={batch_id}")


def run_new_keys(
    stream: DataFrame,
    transform: Callable[[DataFrame, int], DataFrame],
    index: KeyIndex,
    out: str,
    checkpoint: str,
    one_per_key: str | None = None,
):
    """Append rows of ``transform`` whose key no earlier batch has written; waits until done.

    With ``one_per_key`` the first row by that column stands for its key within the batch as well;
    otherwise all rows of a new key are kept.
    """

    def new_rows(batch: DataFrame, batch_id: int) -> DataFrame:
        rows = transform(batch, batch_id)
        if one_per_key:
            rows = first_per_key(rows, index.key, one_per_key)
        keys = rows.select(index.key).distinct()
        return rows.join(index.known(keys, batch_id), index.key, "left_anti")

    def indexed(spark: SparkSession, batch_id: int) -> None:
        written = spark.read.parquet(f"{out}/batch={batch_id}")
        index.add(written.select(index.key).distinct(), batch_id)

    return run_available(stream, new_rows, out, checkpoint, indexed)
