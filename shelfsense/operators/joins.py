"""Lookup joins whose lookup side holds each key once, so rows never multiply.

No join here forces a broadcast. Spark broadcasts the lookup side when its size estimate
(or, at run time, its measured size) is below the session's threshold; otherwise both
sides are shuffled on the key and adaptive execution splits partitions a hot key has made
too large. When the session has switched that off, the rows of heavy keys are salted here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

MAX_HEAVY_KEYS = 1000
HEAVY_ROWS = 1_000_000
SALTS = 256


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's own upper estimate for the optimised plan; None where it is not exposed."""
    plan = getattr(df, "_jdf", None)
    if plan is None:
        return None
    return int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def session_conf(spark: SparkSession):
    """The session's settings with their types (sizes in bytes)."""
    return spark._jsparkSession.sessionState().conf()


def fits_broadcast(df: DataFrame) -> bool:
    size = estimated_bytes(df)
    limit = session_conf(df.sparkSession).autoBroadcastJoinThreshold()
    return size is not None and size <= limit


def _splits_skew(spark: SparkSession) -> bool:
    on = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(spark.conf.get(key).lower() == "true" for key in on)


def heavy_keys(
    df: DataFrame, keys: list[str], max_keys: int = MAX_HEAVY_KEYS, min_rows: int = HEAVY_ROWS
) -> DataFrame:
    """The most frequent keys, at most ``max_keys`` rows.

    Any key left out holds at most 1/max_keys of all rows. Reads only the key columns
    and counts on the map side.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= min_rows)
        .orderBy(F.desc("_rows"), *keys)
        .limit(max_keys)
        .select(*keys)
    )


def salted_lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    salts: int = SALTS,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Lookup join in which the rows of a heavy key are spread over ``salts`` tasks.

    The salt is a hash of the whole row, so a task that is run again after losing its
    executor sends every row to the same place. Only the lookup rows of heavy keys are
    copied, at most MAX_HEAVY_KEYS * salts of them.
    """
    heavy = heavy_keys(left, keys, min_rows=min_rows)
    marked = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    columns = [f.name for f in left.schema if not isinstance(f.dataType, MapType)]
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*columns), F.lit(salts))).otherwise(
        F.lit(0)
    )
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    salted_left = left.join(marked, keys, "left").withColumn("_salt", salt.cast("int"))
    salted_right = right.join(marked, keys, "left").withColumn("_salt", F.explode(copies))
    return (
        salted_left.drop("_heavy")
        .join(salted_right.drop("_heavy"), [*keys, "_salt"], how)
        .drop("_salt")
    )


def lookup_join(
    left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "left"
) -> DataFrame:
    """Join ``left`` with a ``right`` side that is unique on ``keys``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if _splits_skew(left.sparkSession) or fits_broadcast(right):
        return left.join(right, keys, how)
    return salted_lookup_join(left, right, keys, how)


def first_per_key(df: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """The row with the smallest ``order`` values for each key.

    An aggregate, not a window: map tasks keep one row per key before the shuffle, so a
    key that holds a third of the table costs no more than any other.
    """
    return _pick(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """The row with the largest ``order`` values for each key."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys, picker, order) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        picker(F.struct(*others), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def products_with_ratings(products: DataFrame, ratings: DataFrame) -> DataFrame:
    """Attach average_rating and total_reviews by exact URL; NULL when unrated."""
    summary = ratings.select("product_url", "average_rating", "total_reviews")
    return lookup_join(products, summary, "product_url")


def listing_with_details(listing: DataFrame, details: DataFrame, key: str = "k") -> DataFrame:
    """Listing columns plus the detail page's; a failed detail page leaves NULLs."""
    return lookup_join(listing, details, key)


def unprocessed_products(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Products none of whose reviews is stored yet."""
    return lookup_join(products, distinct_urls(reviews), "product_url", "left_anti")


def processed_products(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return lookup_join(products, distinct_urls(reviews), "product_url", "left_semi")


def distinct_urls(df: DataFrame) -> DataFrame:
    return df.select("product_url").distinct()


def products_by_url(products: DataFrame, *columns: str, order: str = "k") -> DataFrame:
    """One product per URL, the one with the lowest ``order``."""
    wanted = products.select("product_url", order, *[c for c in columns if c != order])
    return first_per_key(wanted, "product_url", order)


def reviews_with_products(
    reviews: DataFrame, products: DataFrame, *columns: str, order: str = "k"
) -> DataFrame:
    """Each review with columns of its product; reviews of unknown products are dropped."""
    lookup = products_by_url(products, *columns, order=order).select("product_url", *columns)
    return lookup_join(reviews, lookup, "product_url", "inner")


def orphan_reviews(reviews: DataFrame, products: DataFrame) -> DataFrame:
    return lookup_join(reviews, distinct_urls(products), "product_url", "left_anti")


def products_without_reviews(products: DataFrame, reviews: DataFrame) -> DataFrame:
    return unprocessed_products(products, reviews)
