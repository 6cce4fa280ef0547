"""Scalar functions and filters."""

from pyspark.sql import functions as F

from ..functions import product as p
from ..functions import text as tx
from ..functions import tokens
from ..functions.sentiment import confidence
from ..operators import filters, products
from . import sqlkit as q
from .registry import Tables, query

URL, TITLE, PRICE = "product_url", "title", "price"


def scalar(name: str, sql: str, build, table: str = "products_raw", key: str = "k"):
    """A query that evaluates one function on every row of a table."""

    @query(name, f"SELECT {key}, {sql} AS {name} FROM {table}")
    def run(t: Tables):
        return getattr(t, table).select(key, build().alias(name))


scalar("product_id", q.PRODUCT_ID, lambda: p.product_id(F.col(URL)))
scalar("brand", q.BRAND, lambda: p.brand(F.col(TITLE)))
scalar("clean_price", q.PRICE, lambda: p.clean_price(F.col(PRICE)))
scalar("category", q.CATEGORY, lambda: p.category(F.col(TITLE)))
scalar("discount_percentage", q.DISCOUNT_PCT, lambda: p.discount_percentage(F.col(PRICE)))
scalar("discount_amount", q.DISCOUNT_AMOUNT, lambda: p.discount_amount(F.col(PRICE)))
scalar("original_price", q.ORIGINAL_PRICE, lambda: p.original_price(F.col(PRICE)))
scalar("discount_ends", q.ENDS, lambda: p.discount_ends(F.col(PRICE)))
scalar(
    "title_preview",
    "CASE WHEN length(title) > 20 THEN substr(title, 1, 20) || '...' ELSE title END",
    lambda: tx.preview(F.col(TITLE), 20),
)
scalar(
    "round_n",
    q.rn("c_acctbal / 7", 3),
    lambda: tx.round_n(F.col("c_acctbal") / 7, 3),
    "customer",
    "c_custkey",
)
scalar(
    "clamp01",
    "CASE WHEN value IS NOT NULL THEN least(greatest(value / 50 - 0.2, 0), 1) END",
    lambda: tx.clamp(F.col("value") / 50 - 0.2, 0.0, 1.0),
    "events",
    "event_id",
)
scalar("iso_format", q.iso("ts"), lambda: tx.iso_format(F.col("ts")), "events", "event_id")


@query(
    "discount_struct",
    f"""SELECT k, CASE WHEN {q.HAS_DISCOUNT} THEN {q.DISCOUNT_PCT} END AS discount_percentage,
    CASE WHEN {q.HAS_DISCOUNT} THEN {q.DISCOUNT_AMOUNT} END AS discount_amount,
    CASE WHEN {q.HAS_DISCOUNT} THEN {q.ORIGINAL_PRICE} END AS original_price,
    CASE WHEN {q.HAS_DISCOUNT} THEN {q.ENDS} END AS ends_date,
    CASE WHEN {q.HAS_DISCOUNT} THEN true END AS has_discount FROM products_raw""",
)
def discount_struct(t: Tables):
    found = t.products_raw.select("k", p.discount(F.col(PRICE)).alias("discount"))
    return products.flatten_discount(found)


@query(
    "strip_text",
    f"""SELECT k, {q.strip("coalesce(description, '')")} AS description,
    {q.strip("coalesce(sku, '')")} AS sku, {q.strip("coalesce(detailed_title, '')")} AS detailed_title
    FROM raw_products""",
)
def strip_text(t: Tables):
    fields = ("description", "sku", "detailed_title")
    return t.raw_products.select(
        "k", *[tx.strip_or_empty(F.col(f)).alias(f) for f in fields]
    )


@query("stamp", f"SELECT k, {q.PRODUCT_ID} AS product_id, '2025-08-05T23:35:19' AS created_at FROM products_raw")
def stamp(t: Tables):
    run_ts = F.lit("2025-08-05 23:35:19").cast("timestamp")
    stamped = t.products_raw.withColumn("created_at", run_ts)
    return stamped.select(
        "k", p.product_id(F.col(URL)).alias("product_id"),
        tx.iso_format(F.col("created_at")).alias("created_at"),
    )


@query(
    "combine_text",
    """SELECT seq, CASE WHEN coalesce(title, '') <> '' THEN concat_ws(' ', title, body) ELSE body END
    AS with_title, body AS body_only FROM reviews_raw""",
)
def combine_text(t: Tables):
    title, body = F.col("title"), F.col("body")
    return t.reviews_raw.select(
        "seq",
        tokens.combine_text(title, body, True).alias("with_title"),
        tokens.combine_text(title, body, False).alias("body_only"),
    )


@query(
    "confidence_formula",
    """SELECT vec_id, CASE WHEN c IS NOT NULL THEN least(greatest(c, 0), 1) END AS confidence FROM (
      SELECT vec_id, (1 - abs(v - t) / 2) * 0.6 + abs((v + t) / 2) * 0.4 AS c FROM (
        SELECT vec_id, least(greatest(CAST(embedding[1] AS DOUBLE), -1), 1) AS v,
          least(greatest(CAST(embedding[2] AS DOUBLE), -1), 1) AS t FROM embeddings))""",
)
def confidence_formula(t: Tables):
    v, s = (
        tx.clamp(F.get("embedding", i).cast("double"), -1.0, 1.0) for i in range(2)
    )
    return t.embeddings.select("vec_id", confidence(v, s).alias("confidence"))


# --- filters ----------------------------------------------------------------
@query("valid_products", f"WITH {q.CLEANED} SELECT k, product_id, product_url FROM cleaned")
def valid_products(t: Tables):
    return products.valid_products(t.raw_products).select(
        "k", p.product_id(F.col(URL)).alias("product_id"), URL
    )


@query(
    "rejected_products",
    f"SELECT k, product_url, 'no_product_id' AS reject_reason FROM raw_products WHERE {q.PRODUCT_ID} IS NULL",
)
def rejected_products(t: Tables):
    return products.rejected_products(t.raw_products).select("k", URL, "reject_reason")


@query(
    "rejected_products_strict",
    f"""SELECT k, CASE WHEN {q.PRODUCT_ID} IS NULL THEN 'no_product_id' WHEN title IS NULL THEN 'null_title'
    WHEN description IS NULL THEN 'null_description' WHEN sku IS NULL THEN 'null_sku'
    ELSE 'null_detailed_title' END AS reject_reason FROM raw_products WHERE {q.PRODUCT_ID} IS NULL
    OR title IS NULL OR description IS NULL OR sku IS NULL OR detailed_title IS NULL""",
)
def rejected_products_strict(t: Tables):
    return products.rejected_products(t.raw_products, strict_nulls=True).select(
        "k", "reject_reason"
    )


@query("missing_field", "SELECT seq, review_id FROM reviews_raw WHERE rating IS NULL")
def missing_field(t: Tables):
    return filters.missing_field(t.reviews_raw, "rating").select("seq", "review_id")


@query("present_field", "SELECT seq, review_id, rating FROM reviews_raw WHERE rating IS NOT NULL")
def present_field(t: Tables):
    return filters.present_field(t.reviews_raw, "rating").select("seq", "review_id", "rating")


@query(
    "lookup_by_key",
    "SELECT seq, review_id, product_url, body FROM reviews_raw WHERE review_id = 'bv-review-38'",
)
def lookup_by_key(t: Tables):
    return filters.lookup_by_key(t.reviews_raw, "bv-review-38").select(
        "seq", "review_id", URL, "body"
    )


@query("non_blank_text", f"SELECT seq, review_id FROM reviews_raw WHERE {q.strip('body')} <> ''")
def non_blank_text(t: Tables):
    return filters.non_blank_text(t.reviews_raw).select("seq", "review_id")


@query("mention_filter", "SELECT seq, review_id FROM reviews_raw WHERE lower(body) LIKE '%bike%'")
def mention_filter(t: Tables):
    return filters.mention_filter(t.reviews_raw, "bike").select("seq", "review_id")


@query(
    "named_reviewers",
    """SELECT product_url, reviewer, seq, CAST(row_number() OVER (PARTITION BY product_url ORDER BY seq) AS INTEGER)
    AS shown FROM reviews_raw WHERE coalesce(reviewer, '') <> '' QUALIFY shown <= 3""",
)
def named_reviewers(t: Tables):
    shown = filters.named_reviewers(t.reviews_raw, [URL], ["seq"])
    return shown.select(URL, "reviewer", "seq", "shown")


@query("project_fields", "SELECT review_id FROM reviews_raw")
def project_fields(t: Tables):
    return filters.project_fields(t.reviews_raw, "review_id")
