"""Helpers shared by the operators: stored intermediates, key filters, small column idioms."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bits of a key filter: at most 2048 rows of 4 KB, 8 MB in all, whatever it is built from.
FILTER_BITS = 26


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back, which ends its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Python workers get this many rows at a time from what is computed inside.

    For rows of some kilobytes each, of which the usual ten thousand would not fit in a worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more; it must not be used afterwards."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of the largest filter that ``filter_bits`` asks for: 64 MB.
MOST_FILTER_BITS = 29
#: A key is hot where it holds more than this part of all rows, so there are fewer hot keys than this.
HOT_PART = 1000


def filter_bits(keys: int) -> int:
    """Bits of a filter that lets about one stranger in sixteen or fewer pass."""
    return min(max((16 * keys).bit_length(), 20), MOST_FILTER_BITS)


def _bit(key: Column, bits: int = FILTER_BITS) -> tuple[Column, Column]:
    place = F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    return F.shiftright(place, 15), place.bitwiseAND(32767)


def key_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """One bit per hashed key, in bitmaps of 32768 bits: false positives, no false negatives."""
    bucket, place = _bit(F.col(column), bits)
    return keys.groupBy(bucket.alias("filter_bucket")).agg(
        F.bitmap_construct_agg(place).alias("filter_bits")
    )


def _set_bit() -> Column:
    byte = F.conv(
        F.hex(F.substring("filter_bits", (F.col("filter_place") / 8).cast("int") + 1, F.lit(1))),
        16, 10,
    ).cast("int")
    return F.getbit(byte, (F.col("filter_place") % 8).cast("int")) == 1


def may_contain(df: DataFrame, column: str, bits: DataFrame, width: int = FILTER_BITS) -> DataFrame:
    """Rows whose key may be in the filter. The filter's size is bounded, so it is broadcast."""
    bucket, place = _bit(F.col(column), width)
    return (
        df.withColumns({"filter_bucket": bucket, "filter_place": place})
        .join(F.broadcast(bits), "filter_bucket")
        .where(_set_bit())
        .drop("filter_bucket", "filter_place", "filter_bits")
    )


def marked(df: DataFrame, column: str, bits: DataFrame, name: str, width: int = FILTER_BITS) -> DataFrame:
    """``df`` with ``name``: whether the key may be in the filter."""
    bucket, place = _bit(F.col(column), width)
    return (
        df.withColumns({"filter_bucket": bucket, "filter_place": place})
        .join(F.broadcast(bits), "filter_bucket", "left")
        .withColumn(name, F.coalesce(_set_bit(), F.lit(False)))
        .drop("filter_bucket", "filter_place", "filter_bits")
    )


def surely_lacks(df: DataFrame, column: str, bits: DataFrame, width: int = FILTER_BITS) -> DataFrame:
    """The other rows: those whose key is not in the filter."""
    return marked(df, column, bits, "filter_passed", width).where("not filter_passed").drop("filter_passed")


def spread_join(rows: DataFrame, table: DataFrame, on: str, held: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row per key, whose column ``held`` says how many
    of the ``total`` rows have the key. Hot keys are fewer than HOT_PART, so theirs are broadcast;
    the rows of no other key are many."""
    limit = max(1, total // HOT_PART)
    hot = F.broadcast(table.where(F.col(held) > limit))
    cold = rows.join(hot.select(on), on, "left_anti").join(table.where(F.col(held) <= limit), on)
    return rows.join(hot, on).unionByName(cold)


def utf8_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned."""
    return F.crc32(text.cast("binary"))


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
