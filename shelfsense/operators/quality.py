"""Uniqueness and record rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.product import product_id


def unique_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    )


def product_rules() -> dict[str, Column]:
    return {
        "product_id_missing": F.col("product_id").isNull(),
        "title_missing": F.coalesce(F.col("title"), F.lit("")) == "",
        "price_missing": F.col("price").isNull(),
        "price_negative": F.coalesce(F.col("price") < 0, F.lit(False)),
        "rating_out_of_range": F.coalesce(
            ~F.col("average_rating").between(0, 5), F.lit(False)
        ),
    }


def review_rules() -> dict[str, Column]:
    return {
        "review_id_missing": F.coalesce(F.col("review_id"), F.lit("")) == "",
        "product_url_missing": F.coalesce(F.col("product_url"), F.lit("")) == "",
        "rating_missing": F.col("rating").isNull(),
        "rating_out_of_range": F.coalesce(~F.col("rating").between(1, 5), F.lit(False)),
        "body_blank": F.regexp_like(F.coalesce(F.col("body"), F.lit("")), F.lit(r"^\s*$")),
        "url_without_id": product_id(F.col("product_url")).isNull(),
    }


def pid_pattern_check(df: DataFrame, url: str = "product_url") -> DataFrame:
    """How many addresses carry a product id, how many do not, and how long the ids are."""
    found = product_id(F.col(url))
    return df.agg(
        F.count(F.lit(1)).alias("urls"),
        F.count(found).alias("with_id"),
        F.count_if(found.isNull()).alias("without_id"),
        F.min(F.length(found)).alias("shortest"),
        F.max(F.length(found)).alias("longest"),
    )


def failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the names of the rules each row breaks."""
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.withColumn("failed_rules", F.array_compact(names))


def schema_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows per broken rule."""
    return (
        failed_rules(df, rules)
        .select(F.explode("failed_rules").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def layout(df: DataFrame, partition: str, *order: str) -> DataFrame:
    """Rows arranged for ``write.partitionBy(partition)``: few files per value, sorted so
    that min/max statistics skip row groups. The rebalance hint splits a value that
    holds too many rows for one task."""
    return df.hint("rebalance", partition).sortWithinPartitions(partition, *order)
