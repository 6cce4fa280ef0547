"""Aggregations and data quality."""

from pyspark.sql import functions as F

from ..operators import products, quality, stats
from ..sources import writers
from . import sqlkit as q
from .registry import Tables, query

URL = "product_url"


def cleaned(t: Tables):
    return products.derive_product(products.valid_products(t.raw_products))


@query(
    "cleaning_summary",
    f"""SELECT count(*) AS total, count({q.PRODUCT_ID}) AS cleaned, count(*) - count({q.PRODUCT_ID}) AS errors,
    {q.rn(q.pct(f"count({q.PRODUCT_ID})", "count(*)"), 1)} AS success_rate FROM raw_products""",
)
def cleaning_summary(t: Tables):
    return stats.cleaning_summary(products.with_reject_reason(t.raw_products))


@query(
    "duplicate_ids",
    f"WITH {q.CLEANED} SELECT count(product_id) - count(DISTINCT product_id) AS duplicates FROM cleaned",
)
def duplicate_ids(t: Tables):
    return stats.duplicate_ids(cleaned(t))


@query(
    "table_counts",
    """WITH c AS (SELECT 'products' AS collection, count(*) AS documents FROM products_raw
      UNION ALL SELECT 'reviews', count(*) FROM reviews_raw UNION ALL SELECT 'prices', count(*) FROM prices)
    SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(documents) AS BIGINT) FROM c""",
)
def table_counts(t: Tables):
    return stats.table_counts(products=t.products_raw, reviews=t.reviews_raw, prices=t.prices)


@query(
    "sentiment_coverage",
    f"""SELECT count(*) AS total_documents, count(CASE WHEN verified_purchaser THEN 1 END) AS documents_with_sentiment,
    {q.rn(q.pct("count(CASE WHEN verified_purchaser THEN 1 END)", "count(*)"), 2)} AS coverage_percentage
    FROM reviews_raw""",
)
def sentiment_coverage(t: Tables):
    from .q_text import _partly_scored

    return stats.sentiment_coverage(_partly_scored(t))


@query(
    "sentiment_backlog",
    """SELECT count(*) AS total, count(CASE WHEN verified_purchaser THEN 1 END) AS with_sentiment,
    count(CASE WHEN NOT verified_purchaser THEN 1 END) AS without_sentiment FROM reviews_raw""",
)
def sentiment_backlog(t: Tables):
    from .q_text import _partly_scored

    return stats.sentiment_backlog(_partly_scored(t))


@query(
    "nlp_stats",
    f"""SELECT count(*) AS total_reviews, count(CASE WHEN verified_purchaser THEN 1 END) AS processed_reviews,
    count(CASE WHEN NOT verified_purchaser THEN 1 END) AS unprocessed_reviews,
    {q.pct("count(CASE WHEN verified_purchaser THEN 1 END)", "count(*)")} AS processing_percentage FROM reviews_raw""",
)
def nlp_stats(t: Tables):
    from .q_text import _partly_tokenised

    return stats.nlp_stats(_partly_tokenised(t))


@query(
    "batch_result_counts",
    f"""SELECT count(*) AS processed, count(CASE WHEN {q.strip('body')} <> '' THEN 1 END) AS success,
    count(CASE WHEN {q.strip('body')} = '' THEN 1 END) AS failed FROM reviews_raw""",
)
def batch_result_counts(t: Tables):
    from ..functions.text import is_blank

    return stats.batch_result_counts(t.reviews_raw, ~is_blank(F.col("body")))


@query(
    "review_rollup_by_product",
    f"""SELECT product_url, count(*) AS reviews, {q.avg('rating')} AS avg_rating,
    {q.avg('CAST(verified_purchaser AS INTEGER)')} AS verified_share, CAST(sum(helpful_count) AS BIGINT) AS helpful_total
    FROM reviews_raw GROUP BY product_url""",
)
def review_rollup_by_product(t: Tables):
    return stats.review_rollup_by_product(t.reviews_raw)


@query(
    "rating_distribution",
    """SELECT product_url, rating, count(*) AS reviews FROM reviews_raw WHERE rating IS NOT NULL
    GROUP BY product_url, rating""",
)
def rating_distribution(t: Tables):
    maps = stats.rating_distribution(t.reviews_raw)
    return maps.select(URL, F.explode("rating_distribution").alias("rating", "reviews"))


@query(
    "price_discount_by_category",
    f"""WITH {q.CLEANED} SELECT category, brand, CAST(grouping(category) * 2 + grouping(brand) AS INTEGER) AS level,
    count(*) AS products, {q.avg('price')} AS avg_price, min(price) AS min_price, max(price) AS max_price,
    {q.avg('CAST(coalesce(has_discount, false) AS INTEGER)')} AS discounted_share,
    {q.avg('discount_percentage')} AS avg_discount FROM cleaned GROUP BY ROLLUP (category, brand)""",
)
def price_discount_by_category(t: Tables):
    return stats.price_discount_by_category(cleaned(t))


# --- quality ----------------------------------------------------------------
@query(
    "unique_violations",
    f"WITH {q.CLEANED} SELECT product_id, count(*) AS rows FROM cleaned GROUP BY product_id HAVING count(*) > 1",
)
def unique_violations(t: Tables):
    return quality.unique_violations(cleaned(t), "product_id")


@query(
    "unique_violations_reviews",
    f"""WITH {q.BY_URL} SELECT b.product_id, r.review_id, count(*) AS rows FROM reviews_raw r
    JOIN by_url b ON r.product_url = b.product_url GROUP BY b.product_id, r.review_id HAVING count(*) > 1""",
)
def unique_violations_reviews(t: Tables):
    from ..functions.product import product_id
    from ..operators.joins import reviews_with_products

    lookup = t.products_raw.select("k", URL, product_id(F.col(URL)).alias("product_id"))
    linked = reviews_with_products(t.reviews_raw.select(URL, "review_id"), lookup, "product_id")
    return quality.unique_violations(linked, "product_id", "review_id")


@query(
    "schema_violations",
    r"""SELECT rule, count(*) AS rows FROM (
      SELECT unnest(list_filter([
        CASE WHEN coalesce(review_id, '') = '' THEN 'review_id_missing' END,
        CASE WHEN coalesce(product_url, '') = '' THEN 'product_url_missing' END,
        CASE WHEN rating IS NULL THEN 'rating_missing' END,
        CASE WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_out_of_range' END,
        CASE WHEN regexp_matches(body, '^\s*$') THEN 'body_blank' END,
        CASE WHEN NOT regexp_matches(product_url, '\d+p\.html') THEN 'url_without_id' END],
        lambda x: x IS NOT NULL)) AS rule FROM reviews_raw) GROUP BY rule""",
)
def schema_violations(t: Tables):
    return quality.schema_violations(t.reviews_raw, quality.review_rules())


@query(
    "schema_violations_products",
    f"""WITH {q.CLEANED}, r AS (SELECT c.*, s.average_rating FROM cleaned c LEFT JOIN ratings_summary s
      ON c.product_url = s.product_url)
    SELECT rule, count(*) AS rows FROM (SELECT unnest(list_filter([
        CASE WHEN title = '' THEN 'title_missing' END, CASE WHEN price IS NULL THEN 'price_missing' END,
        CASE WHEN price < 0 THEN 'price_negative' END,
        CASE WHEN average_rating NOT BETWEEN 0 AND 5 THEN 'rating_out_of_range' END],
        lambda x: x IS NOT NULL)) AS rule FROM r) GROUP BY rule""",
)
def schema_violations_products(t: Tables):
    full = products.clean_products(t.raw_products, t.ratings_summary)
    return quality.schema_violations(full, quality.product_rules())


@query(
    "pid_pattern_check",
    f"""SELECT count(*) AS urls, count(p) AS with_id, count(*) - count(p) AS without_id,
    CAST(min(length(p)) AS INTEGER) AS shortest, CAST(max(length(p)) AS INTEGER) AS longest
    FROM (SELECT {q.PRODUCT_ID} AS p FROM products_raw)""",
)
def pid_pattern_check(t: Tables):
    return quality.pid_pattern_check(t.products_raw)


@query(
    "layout",
    f"""WITH {q.CLEANED} SELECT category, brand, product_id, price FROM cleaned""",
)
def layout(t: Tables):
    path = t.scratch("layout")
    table = cleaned(t).select("category", "brand", "product_id", "price")
    writers.write_layout(table, path, "category", "brand", "product_id")
    return t.spark.read.parquet(path).select("category", "brand", "product_id", "price")
