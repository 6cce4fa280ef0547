"""Readers and writers: each query writes a whole table and reads it back."""

from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import iso_format
from ..operators import filters, joins, merge, products, stats
from ..sources import readers, side_updates, writers
from . import sqlkit as q
from .q_stats import cleaned
from .q_tables import _LATEST, _iso_rating
from .registry import Tables, query

URL = "product_url"
RAW = schemas.PRODUCT_RAW.names
REVIEW = schemas.REVIEW.names


@query("read_products", f"SELECT {', '.join(RAW)} FROM raw_products")
def read_products(t: Tables):
    path = t.scratch("products")
    writers.write_products(t.raw_products.select(*RAW), path)
    return readers.read_products(t.spark, path)


@query(
    "read_products_null_fields",
    """SELECT title, product_url, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'title' END,
    CASE WHEN description IS NULL THEN 'description' END, CASE WHEN sku IS NULL THEN 'sku' END,
    CASE WHEN detailed_title IS NULL THEN 'detailed_title' END], lambda x: x IS NOT NULL), ',') AS null_fields
    FROM raw_products""",
)
def read_products_null_fields(t: Tables):
    path = t.scratch("products")
    writers.write_products(t.raw_products.select(*RAW), path)
    found = readers.read_products(t.spark, path, mark_nulls=True)
    return found.select("title", URL, F.array_join("null_fields", ",").alias("null_fields"))


@query("read_reviews", f"SELECT {', '.join(REVIEW)} FROM reviews_raw")
def read_reviews(t: Tables):
    path = t.scratch("reviews")
    writers.write_json(t.reviews_raw.select(*REVIEW), path)
    return readers.read_reviews(t.spark, path)


@query("read_ratings_map", "SELECT product_url, average_rating, total_reviews FROM ratings_summary")
def read_ratings_map(t: Tables):
    path = t.scratch("ratings")
    writers.write_ratings_map(t.ratings_summary, path)
    return readers.read_ratings_map(t.spark, path).select(URL, "average_rating", "total_reviews")


@query("scan_collection", "SELECT * FROM part")
def scan_collection(t: Tables):
    return readers.scan_collection(t.spark, t.path("part"))


@query("read_pages", "SELECT page_id, url, md5(html) AS digest FROM pages")
def read_pages(t: Tables):
    pages = readers.read_pages(t.spark, t.path("pages"))
    return pages.select("page_id", "url", F.md5("html").alias("digest"))


_FLAT = """discount_percentage, discount_amount, original_price, ends_date, has_discount"""


@query(
    "write_products",
    f"""WITH {q.CLEANED} SELECT k, product_id, title, brand, category, price, raw_price, {_FLAT}, description, sku
    FROM cleaned""",
)
def write_products(t: Tables):
    path = t.scratch("cleaned")
    writers.write_products(cleaned(t), path, "parquet")
    stored = products.flatten_discount(readers.scan_collection(t.spark, path))
    return stored.select(
        "k", "product_id", "title", "brand", "category", "price", "raw_price",
        *[c.strip() for c in _FLAT.split(",")], "description", "sku",
    )


@query("write_reviews", "SELECT seq, review_id, rating, body FROM reviews_raw")
def write_reviews(t: Tables):
    path = t.scratch("reviews")
    table = t.reviews_raw.select("seq", "review_id", "rating", "body", "verified_purchaser")
    for part in (F.col("verified_purchaser"), ~F.col("verified_purchaser")):
        writers.append_reviews(table.filter(part).drop("verified_purchaser"), path)
    return readers.scan_collection(t.spark, path)


@query("write_ratings", _LATEST)
def write_ratings(t: Tables):
    path = t.scratch("ratings")
    history = t.ratings_history
    writers.write_version(history.filter("seq = 1"), path)
    stored = readers_version(t, path)
    writers.write_version(merge.upsert_latest(stored, history.filter("seq > 1")), path)
    return _iso_rating(readers_version(t, path))


def readers_version(t: Tables, path: str):
    return writers.read_version(t.spark, path)


@query(
    "full_refresh_load",
    f"""WITH {q.CLEANED}, c AS (SELECT 'products' AS collection, count(*) AS documents FROM cleaned
      UNION ALL SELECT 'reviews', count(*) FROM reviews_raw)
    SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(documents) AS BIGINT) FROM c""",
)
def full_refresh_load(t: Tables):
    at = {name: t.scratch(name) for name in ("products", "reviews")}
    reviews = t.reviews_raw.select(*REVIEW)
    writers.full_refresh_load(t.raw_products, reviews, at["products"], at["reviews"])
    writers.full_refresh_load(cleaned(t), None, at["products"], at["reviews"])
    return stats.table_counts(**{n: writers.read_version(t.spark, p) for n, p in at.items()})


@query(
    "export_collection",
    f"""SELECT product_url, average_rating, total_reviews, {q.iso('extracted_at')} AS extracted_at, seq
    FROM ratings_history""",
)
def export_collection(t: Tables):
    path = t.scratch("export")
    writers.export_collection(t.ratings_history, path)
    return t.spark.read.schema(
        "product_url string, average_rating double, total_reviews bigint, extracted_at string, seq int"
    ).json(path)


@query(
    "clear_tables",
    """WITH c AS (SELECT 'products' AS collection, count(*) AS n FROM products_raw
      UNION ALL SELECT 'reviews', count(*) FROM reviews_raw UNION ALL SELECT 'prices', count(*) FROM lineitem),
    a AS (SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c)
    SELECT collection, n AS before, n AS deleted, CAST(0 AS BIGINT) AS remaining FROM a""",
)
def clear_tables(t: Tables):
    at = {name: t.scratch(name) for name in ("products", "reviews", "prices")}
    t.products_raw.write.parquet(at["products"])
    t.reviews_raw.write.parquet(at["reviews"])
    t.prices.write.parquet(at["prices"])
    return writers.clear_tables(t.spark, "DELETE", **at)


# --- broken and repeated records --------------------------------------------
_BROKEN = "seq % 17 IN (3, 8)"


@query(
    "read_reviews_rejects",
    f"""SELECT CASE WHEN {_BROKEN} THEN 'rejected' ELSE 'read' END AS kind,
      CASE seq % 17 WHEN 3 THEN '{{"review_id":"' || review_id || '", "rating": 4,'
        WHEN 8 THEN '{{"review_id":"' || review_id || '","rating":"four"}}' ELSE review_id END AS text,
      CASE WHEN NOT {_BROKEN} THEN rating END AS rating FROM reviews_raw""",
)
def read_reviews_rejects(t: Tables):
    """Lines that end too early and lines whose rating is no number, among whole ones."""
    path = t.scratch("reviews")
    table = t.reviews_raw.select("seq", *REVIEW)
    name = F.concat(F.lit('{"review_id":"'), F.col("review_id"))
    line = (
        F.when(F.col("seq") % 17 == 3, F.concat(name, F.lit('", "rating": 4,')))
        .when(F.col("seq") % 17 == 8, F.concat(name, F.lit('","rating":"four"}')))
        .otherwise(F.to_json(F.struct(*REVIEW)))
    )
    table.select(line.alias("value")).write.text(path)
    checked = readers.read_reviews_checked(t.spark, path)
    rows = checked.rows.select(F.lit("read").alias("kind"), F.col("review_id").alias("text"), "rating")
    none = F.lit(None).cast("int").alias("rating")
    return rows.union(checked.rejects.select(F.lit("rejected").alias("kind"), F.col("record").alias("text"), none))


@query(
    "read_ratings_last_line",
    f"""WITH l AS ({_LATEST.replace("extracted_at DESC, seq DESC", "seq DESC")})
    SELECT product_url, average_rating, total_reviews, CAST(0 AS BIGINT) AS broken FROM l
    UNION ALL SELECT 'broken', NULL, NULL, count(*) FROM ratings_history WHERE seq = 2 AND total_reviews % 2 = 0""",
)
def read_ratings_last_line(t: Tables):
    """A URL on several lines of several files, the last one counts; broken lines are kept apart."""
    path = t.scratch("ratings")
    history = t.ratings_history.select(URL, "average_rating", "total_reviews", "seq")
    value = F.to_json(F.create_map(URL, F.struct("average_rating", "total_reviews")))
    for part in (1, 2, 3):
        rows = history.where(F.col("seq") == part)
        lines = rows.select(value.alias("value"))
        if part == 2:
            cut = rows.where("total_reviews % 2 = 0").select(F.substring(URL, 1, 20).alias("value"))
            lines = lines.union(cut)
        lines.write.text(f"{path}/part={part}")
    checked = readers.read_ratings_checked(t.spark, path)
    none = F.lit(0).cast("bigint").alias("broken")
    rows = checked.rows.select(URL, "average_rating", "total_reviews", none)
    broken = checked.rejects.agg(F.count(F.lit(1)).alias("broken")).select(
        F.lit("broken").alias(URL), F.lit(None).cast("double").alias("average_rating"),
        F.lit(None).cast("bigint").alias("total_reviews"), "broken",
    )
    return rows.union(broken)


# --- updates beside the table, clustered layout -----------------------------
_UPDATED = """WITH scores AS (SELECT review_id, max(helpful_count) + 100 AS helpful_count FROM reviews_raw
    WHERE seq % 10 = 4 GROUP BY review_id),
  marks AS (SELECT review_id, min(seq) AS marked, CASE WHEN min(seq) % 20 = 4 THEN NULL ELSE -1 END AS helpful_count
    FROM reviews_raw WHERE seq % 20 = 4 OR seq % 31 = 0 GROUP BY review_id)
  SELECT r.seq, r.review_id, r.body, CASE WHEN m.review_id IS NOT NULL THEN m.helpful_count
    WHEN s.review_id IS NOT NULL THEN s.helpful_count ELSE r.helpful_count END AS helpful_count, m.marked
  FROM reviews_raw r LEFT JOIN scores s ON r.review_id = s.review_id LEFT JOIN marks m ON r.review_id = m.review_id"""


def _with_updates(t: Tables) -> str:
    """A stored table with two runs of updates; the second sets one column again, also to NULL."""
    path = t.scratch("reviews")
    reviews = t.reviews_raw.select("seq", "review_id", "body", "helpful_count")
    side_updates.create_table(reviews, path, "review_id")
    scores = reviews.where("seq % 10 = 4").groupBy("review_id").agg((F.max("helpful_count") + 100).alias("helpful_count"))
    side_updates.append_updates(scores, path, "review_id")
    marks = reviews.where("seq % 20 = 4 or seq % 31 = 0").groupBy("review_id").agg(F.min("seq").alias("marked"))
    blank = F.when(F.col("marked") % 20 != 4, F.lit(-1)).alias("helpful_count")
    side_updates.append_updates(marks.select("review_id", "marked", blank), path, "review_id")
    return path


@query("keyed_update_beside", _UPDATED)
def keyed_update_beside(t: Tables):
    return side_updates.read_table(t.spark, _with_updates(t), "review_id")


@query("keyed_update_compacted", _UPDATED)
def keyed_update_compacted(t: Tables):
    path = _with_updates(t)
    side_updates.compact_table(t.spark, path, "review_id")
    return side_updates.read_table(t.spark, path, "review_id")


@query(
    "clustered_lookup",
    """SELECT 'review' AS found_by, seq, review_id, product_url FROM reviews_raw WHERE review_id = 'bv-review-38'
    UNION ALL SELECT 'product', seq, review_id, product_url FROM reviews_raw
    WHERE product_url = (SELECT min(product_url) FROM reviews_raw)""",
)
def clustered_lookup(t: Tables):
    path = t.scratch("clustered")
    writers.write_clustered(t.reviews_raw.select("seq", "review_id", URL, "body"), path, "review_id", URL)
    stored = readers.scan_collection(t.spark, path)
    lowest = stored.agg(F.min(URL)).first()[0]
    found = [
        filters.lookup_by_key(stored, value, key).select(F.lit(name).alias("found_by"), "seq", "review_id", URL)
        for name, value, key in (("review", "bv-review-38", "review_id"), ("product", lowest, URL))
    ]
    return found[0].union(found[1])
