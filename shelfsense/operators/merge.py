"""Set operations and keyed updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import distinct_urls, first_per_key, last_per_key, lookup_join


def append_rows(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; columns one side lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def upsert_latest(
    existing: DataFrame, new: DataFrame, key: str = "product_url", *order: str
) -> DataFrame:
    """Existing and new rows, the last written one per key. Applying it twice changes nothing."""
    return last_per_key(append_rows(existing, new), key, *(order or ("extracted_at", "seq")))


def processed_urls(stored: DataFrame, finished: DataFrame) -> DataFrame:
    return distinct_urls(stored).union(distinct_urls(finished)).distinct()


def url_difference(products: DataFrame, processed: DataFrame) -> DataFrame:
    """Distinct product URLs that are not processed."""
    return lookup_join(
        distinct_urls(products), distinct_urls(processed), "product_url", "left_anti"
    )


def keyed_update(
    target: DataFrame,
    updates: DataFrame,
    key: str = "review_id",
    first_by: str | None = None,
) -> DataFrame:
    """Set the columns of ``updates`` on the rows of ``target`` with the same key.

    ``updates`` holds each key once. Columns the target lacks are added, those it has
    are replaced where an update exists (also by NULL). With ``first_by`` only the row
    with the smallest value of that column is touched among rows sharing a key, as a
    single-document update would.
    """
    columns = [c for c in updates.columns if c != key]
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]).withColumn(
        "_hit", F.lit(True)
    )
    keys = [key]
    if first_by:
        first = target.groupBy(key).agg(F.min(first_by).alias(first_by))
        fresh = lookup_join(fresh, first, key, "inner")
        keys.append(first_by)
    joined = lookup_join(target, fresh, keys)
    values = []
    for column in [*target.columns, *[c for c in columns if c not in target.columns]]:
        if column not in columns:
            values.append(F.col(column))
        elif column in target.columns:
            values.append(
                F.when(F.col("_hit"), F.col(f"_new_{column}"))
                .otherwise(F.col(column))
                .alias(column)
            )
        else:
            values.append(F.col(f"_new_{column}").alias(column))
    return joined.select(*values)


def first_review_per_key(reviews: DataFrame, order: str = "seq") -> DataFrame:
    return first_per_key(reviews, "review_id", order)


def new_rows_only(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key."""
    keys = stored.select(key).distinct()
    return lookup_join(first_per_key(incoming, key, order), keys, key, "left_anti")
