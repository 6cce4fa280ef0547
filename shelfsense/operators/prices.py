"""Price history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_price(prices: DataFrame, tie: str) -> DataFrame:
    """Newest price per product, the one before it, and the change.

    The filter on row_number lets Spark keep two rows per product inside each map task,
    so the window never sees the full history of a product.
    """
    newest = Window.partitionBy("product_id").orderBy(F.desc("timestamp"), F.desc(tie))
    ranked = prices.withColumn("_rank", F.row_number().over(newest)).filter("_rank <= 2")

    def at(rank: int, column: str):
        return F.max(F.when(F.col("_rank") == rank, F.col(column)))

    return (
        ranked.groupBy("product_id")
        .agg(
            at(1, "timestamp").alias("timestamp"),
            at(1, "current_price").alias("current_price"),
            at(2, "current_price").alias("previous_price"),
        )
        .withColumn("price_change", F.col("current_price") - F.col("previous_price"))
    )
