"""Counts, coverage and breakdowns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percentage, round_n


def stable_avg(value: Column, digits: int = 6) -> Column:
    """Average over an exact decimal sum, so that row order cannot change it."""
    total = F.sum(value.cast("decimal(28,9)")).cast("double")
    return round_n(total / F.nullif(F.count(value), F.lit(0)), digits)


def sentiment_breakdown(scored: DataFrame) -> DataFrame:
    """Per label: reviews, mean confidence, mean combined score; most frequent first."""
    s = "sentiment_analysis"
    return (
        scored.filter(F.col(s).isNotNull())
        .groupBy(F.col(f"{s}.sentiment").alias("sentiment"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            stable_avg(F.col(f"{s}.confidence_score")).alias("avg_confidence"),
            stable_avg(F.col(f"{s}.combined_score")).alias("avg_combined_score"),
        )
        .orderBy(F.desc("count"), "sentiment")
    )


def sort_by_count(counts: DataFrame, count: str, label: str) -> DataFrame:
    return counts.orderBy(F.desc(count), label)


def sentiment_coverage(scored: DataFrame) -> DataFrame:
    total, done = F.col("total_documents"), F.col("documents_with_sentiment")
    return scored.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count("sentiment_analysis").alias("documents_with_sentiment"),
    ).withColumn("coverage_percentage", round_n(percentage(done, total), 2))


def sentiment_stats(scored: DataFrame) -> DataFrame:
    """Coverage and breakdown in one row, from one scan.

    Rows are first counted per label (three labels and "none"), then folded.
    """
    s = "sentiment_analysis"
    label, count = F.col("label"), F.col("count")
    labels = scored.groupBy(F.col(f"{s}.sentiment").alias("label")).agg(
        F.count(F.lit(1)).alias("count"),
        stable_avg(F.col(f"{s}.confidence_score")).alias("avg_confidence"),
        stable_avg(F.col(f"{s}.combined_score")).alias("avg_combined_score"),
    )
    entry = F.struct(
        count.alias("count"), label.alias("_id"), "avg_confidence", "avg_combined_score"
    )
    entries = F.sort_array(F.collect_list(F.when(label.isNotNull(), entry)), asc=False)
    by_id = F.transform(
        entries,
        lambda e: F.struct(e["_id"], e["count"], e["avg_confidence"], e["avg_combined_score"]),
    )
    total, done = F.col("total_documents"), F.col("documents_with_sentiment")
    return (
        labels.agg(
            F.coalesce(F.sum(count), F.lit(0)).alias("total_documents"),
            F.coalesce(F.sum(F.when(label.isNotNull(), count)), F.lit(0)).alias(
                "documents_with_sentiment"
            ),
            by_id.alias("sentiment_breakdown"),
        )
        .withColumn("coverage_percentage", round_n(percentage(done, total), 2))
    )


def sentiment_backlog(reviews: DataFrame, field: str = "sentiment_analysis") -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(field).alias("with_sentiment"),
        F.count_if(F.col(field).isNull()).alias("without_sentiment"),
    )


def nlp_stats(reviews: DataFrame) -> DataFrame:
    total, done = F.col("total_reviews"), F.col("processed_reviews")
    return reviews.agg(
        F.count(F.lit(1)).alias("total_reviews"), F.count("sentences").alias("processed_reviews")
    ).withColumns(
        {
            "unprocessed_reviews": total - done,
            "processing_percentage": percentage(done, total),
        }
    )


def cleaning_summary(marked: DataFrame) -> DataFrame:
    """From products with ``reject_reason``: total, cleaned, errors, success rate."""
    good = F.col("reject_reason").isNull()
    total, cleaned = F.col("total"), F.col("cleaned")
    return marked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(good).alias("cleaned"),
        F.count_if(~good).alias("errors"),
    ).withColumn("success_rate", round_n(percentage(cleaned, total), 1))


def duplicate_ids(df: DataFrame, key: str = "product_id") -> DataFrame:
    return df.agg((F.count(key) - F.count_distinct(key)).alias("duplicates"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows per table and a total line."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("documents")).select(
            F.lit(name).alias("collection"), "documents"
        )
        for name, df in tables.items()
    ]
    each = reduce(DataFrame.union, counts)
    return each.rollup("collection").agg(F.sum("documents").alias("documents")).select(
        F.coalesce("collection", F.lit("total")).alias("collection"), "documents"
    )


def harvest_summary(results: DataFrame) -> DataFrame:
    """From one row per product: success, reviews found, rating found."""
    done = F.col("success_count") + F.col("error_count")
    return results.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("success")).alias("success_count"),
        F.count_if(~F.col("success")).alias("error_count"),
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("total_reviews"),
        F.count_if(F.col("has_reviews")).alias("rated_products"),
    ).withColumns(
        {
            "progress": round_n(percentage(done, F.col("products")), 1),
            "success_rate": round_n(percentage(F.col("success_count"), done), 1),
        }
    )


def batch_result_counts(results: DataFrame, success: Column) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(success).alias("success"),
        F.count_if(~success).alias("failed"),
    )


def review_rollup_by_product(reviews: DataFrame) -> DataFrame:
    verified = F.col("verified_purchaser").cast("int")
    return reviews.groupBy("product_url").agg(
        F.count(F.lit(1)).alias("reviews"),
        stable_avg(F.col("rating")).alias("avg_rating"),
        stable_avg(verified).alias("verified_share"),
        F.sum("helpful_count").alias("helpful_total"),
    )


def rating_counts(reviews: DataFrame) -> DataFrame:
    return (
        reviews.filter(F.col("rating").isNotNull())
        .groupBy("product_url", "rating")
        .agg(F.count(F.lit(1)).alias("reviews"))
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Stars → reviews per product; counted first, so a map holds a handful of entries."""
    pairs = F.sort_array(F.collect_list(F.struct("rating", "reviews")))
    return (
        rating_counts(reviews)
        .groupBy("product_url")
        .agg(F.map_from_entries(pairs).alias("rating_distribution"))
    )


def price_discount_by_category(cleaned: DataFrame) -> DataFrame:
    """Prices and discounts per category and brand, per category, and over all."""
    has = F.col("discount").isNotNull()
    return (
        cleaned.rollup("category", "brand")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("products"),
            stable_avg(F.col("price")).alias("avg_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            stable_avg(has.cast("int")).alias("discounted_share"),
            stable_avg(F.col("discount.discount_percentage")).alias("avg_discount"),
        )
    )


def sentiment_by_category(scored: DataFrame) -> DataFrame:
    """From scored reviews carrying category and brand."""
    s = "sentiment_analysis"
    return scored.groupBy("category", "brand", F.col(f"{s}.sentiment").alias("sentiment")).agg(
        F.count(F.lit(1)).alias("reviews"),
        stable_avg(F.col(f"{s}.confidence_score")).alias("avg_confidence"),
        stable_avg(F.col(f"{s}.combined_score")).alias("avg_combined_score"),
        stable_avg(F.col("rating")).alias("avg_rating"),
    )
