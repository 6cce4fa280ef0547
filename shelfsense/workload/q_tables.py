"""Joins, keyed updates, set operations, windows, limits."""

from pyspark.sql import functions as F

from ..functions import product as p
from ..functions.text import iso_format
from ..operators import filters, joins, merge, prices
from . import sqlkit as q
from .registry import Tables, query

URL = "product_url"


@query(
    "products_with_ratings",
    """SELECT p.k, p.product_url, r.average_rating, r.total_reviews
    FROM products_raw p LEFT JOIN ratings_summary r ON p.product_url = r.product_url""",
)
def products_with_ratings(t: Tables):
    rated = joins.products_with_ratings(t.products_raw.select("k", URL), t.ratings_summary)
    return rated.select("k", URL, "average_rating", "total_reviews")


@query(
    "listing_with_details",
    """SELECT p.k, p.title, p.product_url, p.price, d.detailed_title, d.detailed_price, d.sku, d.description
    FROM products_raw p LEFT JOIN product_details d USING (k)""",
)
def listing_with_details(t: Tables):
    return joins.listing_with_details(t.products_raw, t.product_details).drop("search_url")


_STORED = "rating >= 4"


@query(
    "unprocessed_products",
    f"""SELECT k, product_url FROM products_raw WHERE product_url NOT IN
    (SELECT product_url FROM reviews_raw WHERE {_STORED})""",
)
def unprocessed_products(t: Tables):
    stored = t.reviews_raw.filter(_STORED)
    return joins.unprocessed_products(t.products_raw, stored).select("k", URL)


@query(
    "processed_products",
    f"""SELECT k, product_url FROM products_raw WHERE product_url IN
    (SELECT product_url FROM reviews_raw WHERE {_STORED})""",
)
def processed_products(t: Tables):
    stored = t.reviews_raw.filter(_STORED)
    return joins.processed_products(t.products_raw, stored).select("k", URL)


def _iso_rating(df):
    return df.select(
        URL, "average_rating", "total_reviews", iso_format(F.col("extracted_at")).alias("extracted_at")
    )


_LATEST = f"""SELECT product_url, average_rating, total_reviews, {q.iso('extracted_at')} AS extracted_at
  FROM ratings_history QUALIFY row_number() OVER (PARTITION BY product_url ORDER BY extracted_at DESC, seq DESC) = 1"""


@query("upsert_ratings", _LATEST)
def upsert_ratings(t: Tables):
    history = t.ratings_history
    return _iso_rating(merge.upsert_latest(history.filter("seq = 1"), history.filter("seq > 1")))


@query("latest_rating", _LATEST)
def latest_rating(t: Tables):
    return _iso_rating(joins.last_per_key(t.ratings_history, URL, "extracted_at", "seq"))


@query(
    "reviews_with_products",
    f"""WITH {q.BY_URL} SELECT r.seq, r.review_id, r.product_url, b.k, b.brand, b.category, b.product_id
    FROM reviews_raw r JOIN by_url b ON r.product_url = b.product_url""",
)
def reviews_with_products(t: Tables):
    title = F.col("title")
    lookup = t.products_raw.select(
        "k", URL, p.brand(title).alias("brand"), p.category(title).alias("category"),
        p.product_id(F.col(URL)).alias("product_id"),
    )
    reviews = t.reviews_raw.select("seq", "review_id", URL)
    return joins.reviews_with_products(reviews, lookup, "k", "brand", "category", "product_id")


@query(
    "orphan_reviews",
    """SELECT seq, review_id, product_url FROM reviews_raw
    WHERE product_url NOT IN (SELECT product_url FROM products_raw)""",
)
def orphan_reviews(t: Tables):
    return joins.orphan_reviews(t.reviews_raw, t.products_raw).select("seq", "review_id", URL)


@query(
    "products_without_reviews",
    """SELECT k, product_url FROM products_raw
    WHERE product_url NOT IN (SELECT product_url FROM reviews_raw)""",
)
def products_without_reviews(t: Tables):
    return joins.products_without_reviews(t.products_raw, t.reviews_raw).select("k", URL)


# --- set operations ---------------------------------------------------------
@query(
    "append_reviews",
    """SELECT seq, review_id, rating FROM reviews_raw WHERE verified_purchaser
    UNION ALL SELECT seq, review_id, rating FROM reviews_raw WHERE rating IS NOT NULL""",
)
def append_reviews(t: Tables):
    reviews = t.reviews_raw.select("seq", "review_id", "rating", "verified_purchaser")
    both = merge.append_rows(
        reviews.filter("verified_purchaser"), reviews.filter("rating IS NOT NULL")
    )
    return both.drop("verified_purchaser")


@query(
    "processed_urls",
    """SELECT product_url FROM reviews_raw WHERE verified_purchaser
    UNION SELECT product_url FROM ratings_summary""",
)
def processed_urls(t: Tables):
    return merge.processed_urls(t.reviews_raw.filter("verified_purchaser"), t.ratings_summary)


@query(
    "url_difference",
    "SELECT product_url FROM products_raw EXCEPT SELECT product_url FROM ratings_summary",
)
def url_difference(t: Tables):
    return merge.url_difference(t.products_raw, t.ratings_summary)


# --- windows, sorts, limits -------------------------------------------------
@query(
    "first_review_per_key",
    """SELECT review_id, seq, product_url, rating, title FROM reviews_raw
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1""",
)
def first_review_per_key(t: Tables):
    reviews = t.reviews_raw.select("review_id", "seq", URL, "rating", "title")
    return merge.first_review_per_key(reviews)


@query(
    "latest_price",
    f"""SELECT product_id, {q.iso("timestamp")} AS timestamp, current_price, previous_price,
      current_price - previous_price AS price_change
    FROM (SELECT product_id, timestamp, current_price,
        lead(current_price) OVER w AS previous_price, row_number() OVER w AS n
      FROM prices WINDOW w AS (PARTITION BY product_id ORDER BY timestamp DESC, line DESC)) WHERE n = 1""",
)
def latest_price(t: Tables):
    found = prices.latest_price(t.prices, "line")
    return found.withColumn("timestamp", iso_format(F.col("timestamp")))


@query(
    "limited_backlog",
    "SELECT review_id, seq FROM reviews_raw WHERE rating IS NULL ORDER BY review_id, seq LIMIT 20",
)
def limited_backlog(t: Tables):
    reviews = t.reviews_raw.withColumn("order_key", F.struct("review_id", "seq"))
    return filters.limited_backlog(reviews, "rating", 20, "order_key").select("review_id", "seq")


@query(
    "sample_products",
    f"WITH {q.CLEANED} SELECT k, title, product_id, brand, category, price FROM cleaned ORDER BY k LIMIT 5",
)
def sample_products(t: Tables):
    from ..operators.products import derive_product, valid_products

    cleaned = derive_product(valid_products(t.raw_products))
    return filters.first_rows(cleaned, 5, "k").select(
        "k", "title", "product_id", "brand", "category", "price"
    )


@query(
    "sample_processed",
    """SELECT review_id, seq, rating FROM reviews_raw WHERE rating IS NOT NULL
    ORDER BY review_id, seq LIMIT 1""",
)
def sample_processed(t: Tables):
    done = filters.present_field(t.reviews_raw, "rating")
    return filters.first_rows(done, 1, "review_id", "seq").select("review_id", "seq", "rating")


# --- keyed update -----------------------------------------------------------
@query(
    "keyed_update",
    """WITH updates AS (SELECT review_id, max(helpful_count) AS helpful_count, count(*) AS copies
      FROM reviews_raw WHERE verified_purchaser GROUP BY review_id),
    firsts AS (SELECT review_id, min(seq) AS seq FROM reviews_raw GROUP BY review_id)
    SELECT r.seq, r.review_id, CASE WHEN u.review_id IS NOT NULL THEN u.helpful_count + 100 ELSE r.helpful_count END
      AS helpful_count, u.copies FROM reviews_raw r LEFT JOIN firsts f ON r.review_id = f.review_id AND r.seq = f.seq
    LEFT JOIN updates u ON u.review_id = f.review_id""",
)
def keyed_update(t: Tables):
    updates = (
        t.reviews_raw.filter("verified_purchaser")
        .groupBy("review_id")
        .agg(
            (F.max("helpful_count") + 100).alias("helpful_count"),
            F.count(F.lit(1)).alias("copies"),
        )
    )
    target = t.reviews_raw.select("seq", "review_id", "helpful_count")
    return merge.keyed_update(target, updates, first_by="seq")


@query(
    "sort_by_count",
    "SELECT reviewer, count(*) AS reviews FROM reviews_raw GROUP BY reviewer",
)
def sort_by_count(t: Tables):
    from ..operators.stats import sort_by_count as ordered

    counts = t.reviews_raw.groupBy("reviewer").agg(F.count(F.lit(1)).alias("reviews"))
    return ordered(counts, "reviews", "reviewer")
