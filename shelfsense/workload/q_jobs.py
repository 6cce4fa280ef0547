"""Streams and end-to-end jobs."""

from pyspark.sql import functions as F

from ..functions.text import iso_format
from ..operators import joins, products, stats
from ..plans import pipelines
from ..sources import readers, writers
from ..streaming import jobs
from ..streaming.known_keys import KeyIndex, run_new_keys
from . import sqlkit as q
from .q_extract import EXTRACTED, LISTING, _WIDGET
from .q_text import FLAT, FULL_TEXT, SCORES, sentences_sql, words_sql
from .registry import Tables, query

URL = "product_url"


# --- streams ----------------------------------------------------------------
def _document_stream(t: Tables):
    """The stored documents (a file or a folder of files) as a stream of new files.

    Without a limit on files the first run takes all of them as one batch, so that what
    is stored already is read once, not once per slice.
    """
    return jobs.parquet_stream(t.spark, t.path("documents"), t.documents.schema)


def _as_reviews(t: Tables, documents):
    """The review table made of a batch of documents (in the session of the batch)."""
    batch = Tables(documents.sparkSession, t.folder)
    batch.provide("documents", documents)
    return batch.reviews_raw


def _review_batches(t: Tables, transform: jobs.Batch) -> jobs.Batch:
    return lambda documents, batch_id: transform(_as_reviews(t, documents), batch_id)


@query(
    "stream_enrich",
    f"""WITH {SCORES} SELECT r.seq, r.review_id, CAST(len({sentences_sql('r.body')}) AS INTEGER) AS sentences_count,
    CAST(len({words_sql('r.body')}) AS INTEGER) AS words_count, s.sentiment, s.confidence_score, s.combined_score
    FROM reviews_raw r JOIN scored s ON r.seq = s.seq WHERE NOT blank_text(r.body)""".replace(
        "NOT blank_text(r.body)", f"{q.strip('r.body')} <> ''"
    ),
)
def stream_enrich(t: Tables):
    out, place = t.scratch("enriched"), t.scratch("checkpoint")
    enrich = _review_batches(t, jobs.enrich_reviews(t.words))
    for _ in range(2):  # the second run finds nothing new
        jobs.run_available(_document_stream(t), enrich, out, place)
    s = "sentiment_analysis"
    return jobs.written(t.spark, out).select(
        "seq", "review_id", F.size("sentences").alias("sentences_count"),
        F.size("words").alias("words_count"), F.col(f"{s}.sentiment").alias("sentiment"),
        F.col(f"{s}.confidence_score").alias("confidence_score"),
        F.col(f"{s}.combined_score").alias("combined_score"),
    )


_DISTINCT = "SELECT DISTINCT review_id FROM reviews_raw"


@query("stream_dedup", _DISTINCT.replace("reviews_raw", "(SELECT 'bv-review-' || CAST(doc_id - (CASE WHEN doc_id % 40 = 39 THEN 1 ELSE 0 END) AS VARCHAR) AS review_id FROM documents)"))
def stream_dedup(t: Tables):
    out, place = t.scratch("unique"), t.scratch("checkpoint")
    arrivals = _document_stream(t).selectExpr(
        "concat('bv-review-', CAST(doc_id - IF(doc_id % 40 = 39, 1, 0) AS STRING)) AS review_id",
        "doc_id AS seq",
        "timestamp_seconds(1700000000 + doc_id) AS arrived_at",
    )
    unique = jobs.stream_dedup(arrivals, "arrived_at", "3650 days", spread_by="seq")
    jobs.run_append(unique, out, place)
    return t.spark.read.parquet(out).select("review_id")


def _in_parts(t: Tables, table, by: str, parts: int, name: str, run):
    """Store ``table`` in parts by ranges of the number ``by``; ``run`` the stream after each."""
    source = t.scratch(name)
    low, high = table.agg(F.min(by), F.max(by)).first()
    limits = [low + n * (high + 1 - low) / parts for n in range(parts + 1)] if low is not None else [0, 1]
    for begin, end in zip(limits, limits[1:]):
        table.where((F.col(by) >= begin) & (F.col(by) < end)).write.mode("append").parquet(source)
        run(jobs.parquet_stream(t.spark, source, table.schema))


@query(
    "stream_dedup_expiring",
    """WITH a AS (SELECT 'bv-review-' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS review_id FROM documents)
    SELECT DISTINCT review_id FROM a""",
)
def stream_dedup_expiring(t: Tables):
    """Five runs; ids are remembered for a while only, in a store on disk.

    Copies arrive within seconds of each other, some in the next run.
    """
    out, place = t.scratch("unique"), t.scratch("checkpoint")
    arrivals = t.documents.selectExpr(
        "concat('bv-review-', CAST(doc_id - doc_id % 3 AS STRING)) AS review_id", "doc_id AS seq",
        "timestamp_seconds(1700000000 + doc_id) AS arrived_at",
    )

    def run(stream):
        jobs.run_append(jobs.stream_dedup(stream, "arrived_at", "1 hour"), out, place)

    with jobs.state_on_disk(t.spark):
        _in_parts(t, arrivals, "seq", 5, "arrivals", run)
    return t.spark.read.parquet(out).select("review_id")


@query(
    "dedup_batch",
    """SELECT review_id, seq, rating FROM reviews_raw
    QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY seq) = 1""",
)
def dedup_batch(t: Tables):
    """In three batches; what earlier ones have written is known from an index of keys."""
    out, place = t.scratch("unique"), t.scratch("checkpoint")
    index = KeyIndex(t.scratch("index"), "review_id")

    def run(stream):
        run_new_keys(stream, lambda batch, _: _as_reviews(t, batch), index, out, place, "seq")

    _in_parts(t, t.documents, "doc_id", 3, "documents", run)
    return jobs.written(t.spark, out).select("review_id", "seq", "rating")


@query(
    "progress_metrics",
    """SELECT CAST(count(*) AS BIGINT) AS processed, count(CASE WHEN trim(body) <> '' THEN 1 END) AS with_text,
    count(rating) AS rated FROM reviews_raw""",
)
def progress_metrics(t: Tables):
    out, place = t.scratch("metrics"), t.scratch("checkpoint")
    measure = _review_batches(t, jobs.progress_metrics("enrich"))
    jobs.run_available(_document_stream(t), measure, out, place)
    return jobs.written(t.spark, out).agg(
        *[F.sum(c).alias(c) for c in ("processed", "with_text", "rated")]
    )


@query(
    "resume_harvest",
    f"""WITH {EXTRACTED}, stored AS (SELECT product_url FROM reviews_raw WHERE rating = 5)
    SELECT review_id, product_url, rating, body FROM extracted
    WHERE product_url NOT IN (SELECT product_url FROM stored)
      AND product_url IN (SELECT product_url FROM products_raw)
    UNION ALL SELECT review_id, product_url, rating, body FROM reviews_raw WHERE rating = 5""",
)
def resume_harvest(t: Tables):
    columns = ("review_id", URL, "rating", "body")
    stored = t.reviews_raw.filter("rating = 5").select(*columns)
    out, source, place = t.scratch("reviews"), t.scratch("pages"), t.scratch("checkpoint")
    pages = t.review_pages.select(URL, "page_no", "html")
    pages.write.parquet(source)
    products_ = joins.unprocessed_products(t.products_raw.select(URL).distinct(), stored)
    index = KeyIndex(t.scratch("index"), URL)
    stream = jobs.parquet_stream(t.spark, source, pages.schema)
    for _ in range(2):
        run_new_keys(stream, jobs.harvest_pages(products_), index, out, place)
    return jobs.written(t.spark, out).select(*columns).unionByName(stored)


# --- end-to-end jobs --------------------------------------------------------
@query(
    "build_product_catalog",
    f"""WITH {LISTING}, details AS (SELECT * FROM (SELECT product_url, {q.strip('title')} AS detailed_title, detailed_price,
        sku, {q.strip("coalesce(description, '')")} AS description, row_number() OVER (PARTITION BY product_url ORDER BY k) AS n
      FROM raw_products) WHERE n = 1)
    SELECT l.title, l.product_url, l.price, l.search_url, d.detailed_title, d.detailed_price, d.sku, d.description
    FROM listing l LEFT JOIN details d ON l.product_url = d.product_url""",
)
def build_product_catalog(t: Tables):
    return pipelines.build_product_catalog(t.listing_pages, t.detail_pages)


HARVEST = f"""{EXTRACTED}, {_WIDGET},
  stored AS (SELECT DISTINCT product_url FROM reviews_raw WHERE rating = 5),
  todo AS (SELECT product_url, min_by(title, k) AS product_title FROM products_raw
    WHERE product_url NOT IN (SELECT product_url FROM stored) GROUP BY product_url),
  attempt AS (SELECT w.seq, w.product_url, w.opened_by IS NOT NULL AS opened, w.total_reviews, w.average_rating,
      coalesce(w.total_reviews, 0) <> 0 OR coalesce(w.average_rating, 0) <> 0 AS has_reviews,
      w.opened_by IS NOT NULL AND w.seq % 7 <> 2 AS readable
    FROM widget w JOIN reviews_raw r ON r.seq = w.seq WHERE r.page_no = 1),
  state AS (SELECT product_url, bool_or(opened) AS opened, bool_or(has_reviews) AS has_reviews, bool_or(readable) AS readable,
      max(CASE WHEN has_reviews THEN seq END) AS rated_at FROM attempt GROUP BY product_url),
  seen AS (SELECT DISTINCT product_url FROM reviews_raw),
  got AS (SELECT e.* FROM extracted e JOIN state s ON e.product_url = s.product_url
    JOIN todo t ON t.product_url = e.product_url WHERE s.readable),
  n AS (SELECT product_url, count(*) AS reviews FROM got GROUP BY product_url),
  result AS (SELECT t.product_url, t.product_title,
      CASE WHEN s.product_url IS NOT NULL THEN true WHEN seen.product_url IS NOT NULL THEN false END AS success,
      CASE WHEN s.product_url IS NOT NULL THEN NULL WHEN seen.product_url IS NOT NULL THEN 'first page not stored'
        ELSE 'no page stored' END AS error,
      CASE WHEN s.readable THEN 'read' WHEN s.opened THEN 'reviews not loaded' WHEN s.product_url IS NOT NULL
        THEN 'reviews not opened' END AS outcome,
      coalesce(s.has_reviews, false) AS has_reviews, coalesce(n.reviews, 0) AS reviews
    FROM todo t LEFT JOIN state s ON s.product_url = t.product_url LEFT JOIN seen ON seen.product_url = t.product_url
      LEFT JOIN n ON n.product_url = t.product_url)"""


def _harvest(t: Tables) -> pipelines.Harvest:
    stored = t.reviews_raw.filter("rating = 5")
    old = t.ratings_summary.select(
        URL, F.lit("stored before").alias("product_title"), "average_rating", "total_reviews",
        F.create_map(F.lit(5), "total_reviews").alias("rating_distribution"),
        F.lit("2025-08-01 00:00:00").cast("timestamp").alias("extracted_at"),
    )
    run_ts = F.lit("2025-08-05 12:00:00").cast("timestamp")
    return pipelines.harvest_reviews(t.products_raw, t.review_pages, stored, old, run_ts)


@query(
    "harvest_reviews",
    f"WITH {HARVEST} SELECT product_url, page_no, position, review_id, rating, title, body, helpful_count FROM got",
)
def harvest_reviews(t: Tables):
    return _harvest(t).reviews.select(
        URL, "page_no", "position", "review_id", "rating", "title", "body", "helpful_count"
    )


@query(
    "harvest_results",
    f"WITH {HARVEST} SELECT product_url, product_title, success, error, outcome, has_reviews, reviews FROM result",
)
def harvest_results(t: Tables):
    return _harvest(t).results.select(
        URL, "product_title", "success", "error", "outcome", "has_reviews", "reviews"
    )


@query(
    "harvest_ratings",
    f"""WITH {HARVEST}, stars AS (SELECT product_url, string_agg(rating || '=' || c, ',' ORDER BY rating) AS distribution
      FROM (SELECT product_url, rating, count(*) AS c FROM got WHERE rating IS NOT NULL GROUP BY product_url, rating)
      GROUP BY product_url),
    fresh AS (SELECT s.product_url, t.product_title, a.average_rating, a.total_reviews,
        coalesce(stars.distribution, '') AS distribution, '2025-08-05T12:00:00' AS extracted_at
      FROM state s JOIN todo t ON t.product_url = s.product_url JOIN attempt a ON a.seq = s.rated_at AND a.product_url = s.product_url
        LEFT JOIN stars ON stars.product_url = s.product_url)
    SELECT * FROM fresh UNION ALL SELECT product_url, 'stored before', average_rating, total_reviews,
      '5=' || total_reviews, '2025-08-01T00:00:00' FROM ratings_summary
    WHERE product_url NOT IN (SELECT product_url FROM fresh)""",
)
def harvest_ratings(t: Tables):
    stars = F.transform(
        F.array_sort(F.map_entries("rating_distribution")),
        lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")),
    )
    return _harvest(t).ratings.select(
        URL, "product_title", "average_rating", "total_reviews",
        F.array_join(stars, ",").alias("distribution"), iso_format(F.col("extracted_at")).alias("extracted_at"),
    )


@query(
    "harvest_summary",
    f"""WITH {HARVEST}, c AS (SELECT count(*) AS products, count(CASE WHEN success THEN 1 END) AS success_count,
      count(CASE WHEN NOT success THEN 1 END) AS error_count, CAST(sum(reviews) AS BIGINT) AS total_reviews,
      count(CASE WHEN has_reviews THEN 1 END) AS rated_products FROM result)
    SELECT *, {q.rn('100.0::DOUBLE * (success_count + error_count) / products', 1)} AS progress,
      {q.rn('100.0::DOUBLE * success_count / (success_count + error_count)', 1)} AS success_rate FROM c""",
)
def harvest_summary(t: Tables):
    return stats.harvest_summary(_harvest(t).results)


@query(
    "clean_products",
    f"""WITH {q.CLEANED} SELECT c.k, product_id, title, brand, category, c.product_url, price, raw_price,
    discount_percentage, discount_amount, original_price, ends_date, has_discount, r.average_rating, r.total_reviews,
    description, sku, search_url, detailed_title, detailed_price, '2025-08-05T00:00:00.500000' AS created_at
    FROM cleaned c LEFT JOIN ratings_summary r ON c.product_url = r.product_url""",
)
def clean_products(t: Tables):
    run_ts = F.lit("2025-08-05 00:00:00.5").cast("timestamp")
    job = pipelines.clean_products(t.raw_products, t.ratings_summary, run_ts)
    flat = products.flatten_discount(job.cleaned)
    return flat.withColumn("created_at", iso_format(F.col("created_at"))).drop("updated_at")


@query(
    "clean_products_rejected",
    f"SELECT k, product_url, title FROM raw_products WHERE {q.PRODUCT_ID} IS NULL",
)
def clean_products_rejected(t: Tables):
    return pipelines.clean_products(t.raw_products, t.ratings_summary).rejected.select("k", URL, "title")


@query(
    "clean_products_summary",
    f"""SELECT count(*) AS total, count({q.PRODUCT_ID}) AS cleaned, count(*) - count({q.PRODUCT_ID}) AS errors
    FROM raw_products""",
)
def clean_products_summary(t: Tables):
    """The counts that fill in while the cleaned table is written."""
    job = pipelines.clean_products(t.raw_products, t.ratings_summary)
    writers.write_products(job.cleaned, t.scratch("cleaned"), "parquet")
    counts = job.summary.get
    return t.spark.createDataFrame([tuple(counts[c] for c in ("total", "cleaned", "errors"))], "total bigint, cleaned bigint, errors bigint")


@query(
    "load_tables",
    f"""WITH {q.CLEANED}, c AS (SELECT 'products' AS collection, count(*) AS documents FROM cleaned
      UNION ALL SELECT 'reviews', count(*) FROM reviews_raw)
    SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(documents) AS BIGINT) FROM c""",
)
def load_tables(t: Tables):
    job = pipelines.clean_products(t.raw_products, t.ratings_summary)
    return pipelines.load_tables(
        t.spark, job.cleaned, t.reviews_raw, t.scratch("products"), t.scratch("reviews")
    )


@query(
    "process_reviews_nlp",
    f"""SELECT seq, CASE WHEN verified_purchaser THEN 'earlier run' WHEN {q.strip(FULL_TEXT)} <> ''
      THEN array_to_string({sentences_sql('(' + FULL_TEXT + ')')}, ' | ') END AS sentences FROM reviews_raw""",
)
def process_reviews_nlp(t: Tables):
    from .q_text import _partly_tokenised

    after = pipelines.process_reviews_nlp(_partly_tokenised(t), concatenate=True)
    return after.select("seq", F.array_join("sentences", " | ").alias("sentences"))


@query(
    "score_reviews",
    f"""WITH {SCORES}, firsts AS (SELECT review_id, min(seq) AS seq FROM reviews_raw GROUP BY review_id)
    SELECT r.seq, r.review_id, {", ".join("s." + c.strip() for c in FLAT.split(","))}
    FROM reviews_raw r JOIN firsts f ON r.review_id = f.review_id JOIN scored s ON s.seq = f.seq""",
)
def score_reviews(t: Tables):
    from ..operators.sentiment import flatten_sentiment

    after = pipelines.score_reviews(t.reviews_raw, t.words)
    return flatten_sentiment(after.select("seq", "review_id", "sentiment_analysis"))


@query(
    "export_tables",
    f"""WITH {q.CLEANED} SELECT 'products' AS collection, count(*) AS documents, count(price) AS priced FROM cleaned
    UNION ALL SELECT 'reviews', count(*), 0 FROM reviews_raw""",
)
def export_tables(t: Tables):
    from .q_stats import cleaned

    out = t.scratch("export")
    pipelines.export_tables(t.spark, out, products=cleaned(t), reviews=t.reviews_raw)
    counts = [
        t.spark.read.schema(fields)
        .json(f"{out}/{name}")
        .agg(F.count(F.lit(1)).alias("documents"), F.count("price").alias("priced"))
        .select(F.lit(name).alias("collection"), "documents", "priced")
        for name, fields in (("products", "price double"), ("reviews", "price double"))
    ]
    return counts[0].union(counts[1])
