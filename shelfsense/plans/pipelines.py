"""The user's entry points. Each returns lazy tables; writing them is one job per table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, joins, merge, nlp, products, sentiment, stats
from ..session import measured
from ..sources import writers


def build_product_catalog(listing_pages: DataFrame, detail_pages: DataFrame) -> DataFrame:
    """Listing records with the fields of their detail pages.

    ``detail_pages.url`` is the address a listing links to; of several stored copies of
    one page the first by page_id is used.
    """
    listing = extract.product_listing(listing_pages)
    details = extract.product_details(detail_pages, "url", "page_id")
    single = joins.first_per_key(details, "url", "page_id").drop("page_id")
    return joins.lookup_join(
        listing, single.withColumnRenamed("url", "product_url"), "product_url"
    ).drop("position")


class Harvest(NamedTuple):
    reviews: DataFrame
    ratings: DataFrame
    results: DataFrame


def _product_states(pages: DataFrame, order: str | None) -> DataFrame:
    """What the stored first pages of a product show; one row per product that has one.

    Where a first page was stored more than once, the numbers are those of the last one fetched
    that shows any (of the one with most reviews where the order is not known).
    """
    numbers = ("opened_by", "total_reviews", "average_rating", "has_reviews")
    first = pages.filter(F.col("page_no") == 1)
    keys = ["product_url", order] if order else ["product_url"]
    widgets = extract.rating_summary(extract.rating_widget(first, *keys, "html"))
    seen = extract.reviews_present(widgets, *keys, *numbers)
    opened = F.col("opened_by").isNotNull()
    place = F.col(order) if order else F.coalesce("total_reviews", F.lit(0)) + F.coalesce("average_rating", F.lit(0.0)) / 8
    rated_at = F.when(F.col("has_reviews"), place)
    return seen.groupBy("product_url").agg(
        F.bool_or(opened).alias("opened"),
        F.bool_or(opened & F.col("reviews_present")).alias("readable"),
        F.bool_or("has_reviews").alias("has_reviews"),
        F.max_by("total_reviews", rated_at).alias("total_reviews"),
        F.max_by("average_rating", rated_at).alias("average_rating"),
    )


def harvest_reviews(
    product_table: DataFrame,
    pages: DataFrame,
    stored_reviews: DataFrame,
    stored_ratings: DataFrame,
    run_ts: Column,
    max_pages: int | None = None,
    order: str | None = "seq",
) -> Harvest:
    """New reviews, the updated rating table and one result row per submitted product.

    ``pages`` holds product_url, page_no, html and perhaps ``order``, which grows as pages are fetched.
    Products with stored reviews are skipped; reviews are taken only where the rating widget opens
    a review section. Every page is read, or with ``max_pages`` the first ones of every product.
    A product without any page has not been fetched yet: its ``success`` is NULL. One whose first
    page is missing has failed; both have an ``error``. What is known of the products, a row each,
    is stored first, so that joins with pages and reviews know its size.
    """
    order = order if order in pages.columns else None
    titles = joins.first_per_key(product_table.select("product_url", "title", "k"), "product_url", "k")
    todo = measured(
        joins.unprocessed_products(titles, stored_reviews).select("product_url", F.col("title").alias("product_title")),
        "todo",
    )
    wanted = todo.select("product_url")
    if joins.fits_broadcast(wanted):  # else pages are read first, so that joins move records, not pages
        pages = pages.join(wanted, "product_url", "left_semi")
    state = measured(joins.lookup_join(_product_states(pages, order), wanted, "product_url", "left_semi"), "states")
    readable = state.filter("readable").select("product_url")
    if joins.fits_broadcast(readable):  # pages whose reviews would not be taken are not searched for any
        opened = extract.paginate_union(pages.join(readable, "product_url", "left_semi"), max_pages)
        reviews = extract.extract_reviews(opened, "page_no")
    else:
        found_reviews = extract.extract_reviews(extract.paginate_union(pages, max_pages), "page_no")
        reviews = joins.lookup_join(found_reviews, readable, "product_url", "left_semi")
    rated = joins.lookup_join(state.filter("has_reviews"), todo, "product_url")
    no_stars = F.create_map().cast("map<int,bigint>")
    new_ratings = joins.lookup_join(rated, stats.rating_distribution(reviews), "product_url").select(
        "product_url", "product_title", "average_rating", "total_reviews",
        F.coalesce("rating_distribution", no_stars).alias("rating_distribution"), run_ts.alias("extracted_at"),
    )
    ratings = merge.upsert_latest(stored_ratings, new_ratings, "product_url", "extracted_at")
    counts = reviews.groupBy("product_url").agg(F.count(F.lit(1)).alias("reviews"))
    fetched = pages.groupBy("product_url").agg(F.count(F.lit(1)).alias("pages"))
    results = todo
    for part in (state, fetched, counts):
        results = joins.lookup_join(results, part, "product_url")
    attempted = F.col("readable").isNotNull()
    error = F.when(F.col("pages").isNull(), "no page stored").when(~attempted, "first page not stored")
    outcome = (
        F.when(F.col("readable"), "read").when(F.col("opened"), "reviews not loaded").when(attempted, "reviews not opened")
    )
    results = results.select(
        "product_url",
        "product_title",
        F.when(F.col("pages").isNotNull(), attempted).alias("success"),
        error.alias("error"),
        outcome.alias("outcome"),
        F.coalesce("has_reviews", F.lit(False)).alias("has_reviews"),
        F.coalesce("reviews", F.lit(0).cast("bigint")).alias("reviews"),
        F.coalesce("pages", F.lit(0).cast("bigint")).alias("pages"),
    )
    return Harvest(reviews, ratings, results)


class Cleaning(NamedTuple):
    cleaned: DataFrame
    rejected: DataFrame
    summary: Observation


def clean_products(
    raw: DataFrame, ratings: DataFrame, run_ts: Column | None = None, strict_nulls: bool = False
) -> Cleaning:
    """Cleaned and rejected products; the summary fills in while ``cleaned`` is written."""
    summary = Observation("cleaning")
    valid = products.reject_reason(raw, strict_nulls).isNull()
    watched = raw.observe(
        summary,
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid).alias("cleaned"),
        F.count_if(~valid).alias("errors"),
    )
    cleaned = products.clean_products(watched, ratings, run_ts, strict_nulls)
    return Cleaning(cleaned, products.rejected_products(raw, strict_nulls), summary)


def load_tables(
    spark: SparkSession,
    cleaned: DataFrame,
    reviews: DataFrame | None,
    products_path: str,
    reviews_path: str,
) -> DataFrame:
    """Full refresh of both tables; returns the row counts."""
    writers.full_refresh_load(cleaned, reviews, products_path, reviews_path)
    return stats.table_counts(
        products=writers.read_version(spark, products_path),
        reviews=writers.read_version(spark, reviews_path),
    )


def process_reviews_nlp(
    reviews: DataFrame,
    concatenate: bool = True,
    skip_processed: bool = True,
    run_ts: Column | None = None,
) -> DataFrame:
    """The review table after an incremental tokenisation run.

    Tokenising is row by row, so the rows are enriched in place: no join, no shuffle.
    """
    return nlp.nlp_enrich(reviews, concatenate, run_ts, skip_processed)


def score_reviews(
    reviews: DataFrame,
    words: DataFrame,
    limit: int | None = None,
    force: bool = False,
    key: str = "review_id",
    run_ts: Column | None = None,
) -> DataFrame:
    """The review table after an incremental sentiment run.

    Reviews are scored in place where the lexicon is small enough to go along with the plan and
    the first of several rows with one id is known by ``seq``.
    """
    lexicon = sentiment.carried_words(words) if limit is None else None
    if lexicon is not None and (key != "review_id" or "seq" in reviews.columns):
        return sentiment.score_in_place(reviews, lexicon, force, key, run_ts)
    updates = sentiment.sentiment_incremental(reviews, words, limit, force, key, run_ts)
    return merge.keyed_update(reviews, updates, key)


def export_tables(spark: SparkSession, out: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        writers.export_collection(df, f"{out}/{name}")
