"""Predicates and projections on stored records; all reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.text import is_blank, non_empty


def missing_field(df: DataFrame, field: str) -> DataFrame:
    return df.filter(F.col(field).isNull())


def present_field(df: DataFrame, field: str) -> DataFrame:
    return df.filter(F.col(field).isNotNull())


def lookup_by_key(df: DataFrame, value, key: str = "review_id") -> DataFrame:
    """Rows with that key. Over a table written by ``write_clustered`` the scan skips the files
    and row groups whose key range or Bloom filter excludes it."""
    return df.filter(F.col(key) == F.lit(value))


def non_blank_text(df: DataFrame, text: str | Column = "body") -> DataFrame:
    return df.filter(~is_blank(F.col(text) if isinstance(text, str) else text))


def mention_filter(df: DataFrame, word: str, text: str = "body") -> DataFrame:
    """Rows whose text mentions the word, whatever the case."""
    return df.filter(F.lower(text).contains(word.lower()))


def named_reviewers(
    reviews: DataFrame, page: list[str], order: list[str], shown: int = 3
) -> DataFrame:
    """The first ``shown`` non-empty reviewer names of each page.

    row_number with an upper bound: Spark keeps ``shown`` rows per page in every map
    task before anything is shuffled.
    """
    first = Window.partitionBy(*page).orderBy(*order)
    return (
        reviews.filter(non_empty(F.col("reviewer")).isNotNull())
        .withColumn("shown", F.row_number().over(first))
        .filter(F.col("shown") <= shown)
    )


def project_fields(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(*fields)


def limited_backlog(
    df: DataFrame, field: str, limit: int | None = None, key: str | list[str] = "review_id"
) -> DataFrame:
    """Rows lacking ``field``; with ``limit`` the first so many in key order."""
    backlog = missing_field(df, field)
    return backlog if limit is None else lowest_rows(backlog, limit, key)


def lowest_rows(df: DataFrame, limit: int, key: str | list[str]) -> DataFrame:
    """The ``limit`` rows with the lowest keys.

    Only keys are ordered and cut; the rows themselves, with their text, are fetched by a join
    with the keys that were taken. Equal keys are told apart by a hash of the row, and of rows
    equal in everything as many are taken as are wanted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    marked = df.withColumn("_tie", F.xxhash64(*hashed))
    taken = marked.select(*keys, "_tie").orderBy(*keys, "_tie").limit(limit)
    wanted = taken.groupBy(*keys, "_tie").agg(F.count(F.lit(1)).alias("_wanted"))
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys],
        F.col("_tie") == F.col("_w_tie"),
    )
    renamed = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in keys], F.col("_tie").alias("_w_tie"), "_wanted")
    nth = Window.partitionBy(*keys, "_tie").orderBy("_tie")
    fetched = marked.join(renamed, same).withColumn("_nth", F.row_number().over(nth))
    return fetched.where("_nth <= _wanted").select(*df.columns)


def first_rows(df: DataFrame, limit: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(limit)
