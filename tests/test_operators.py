"""Operators on small literal tables: semantics, invariants, plans."""

import math
import random
import string

import pytest
from pyspark.sql import functions as F

from shelfsense import schemas
from shelfsense.operators import (
    extract,
    filters,
    joins,
    merge,
    nlp,
    prices,
    products,
    quality,
    sentiment,
    stats,
)
from shelfsense.plans import pipelines
from shelfsense.sources import readers, writers
from shelfsense.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- joins ------------------------------------------------------------------
@pytest.fixture
def skewed(spark, tmp_path):
    """A third of all rows share one key, some have none, some keys are unknown."""
    data = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}") for i in range(3000)]
    left = spark.createDataFrame(data, "i int, key string")
    right = spark.createDataFrame(
        [("hot", 1), *[(f"k{j}", j) for j in range(35)]], "key string, v int"
    )
    for name, df in (("left", left), ("right", right)):
        df.write.parquet(str(tmp_path / name))
    return tuple(spark.read.parquet(str(tmp_path / name)) for name in ("left", "right"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(skewed, how):
    left, right = skewed
    plain = left.join(right, "key", how)
    salted = joins.salted_lookup_join(left, right, ["key"], how, salts=7, min_rows=100)
    assert rows(salted.select(plain.columns)) == rows(plain)


def test_heavy_keys_are_bounded(skewed):
    assert rows(joins.heavy_keys(skewed[0], ["key"], max_keys=1, min_rows=10)) == [("hot",)]
    assert joins.heavy_keys(skewed[0], ["key"], max_keys=5, min_rows=10_000).count() == 0


def test_lookup_join_choices(spark, skewed):
    left, right = skewed
    expected = rows(left.join(right, "key", "left"))
    assert "BroadcastHashJoin" in plan(joins.lookup_join(left, right, "key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = joins.lookup_join(left, right, "key")
        assert "SortMergeJoin" in plan(shuffled)
        assert rows(shuffled) == expected
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        salted = joins.lookup_join(left, right, "key")
        assert "_salt" in plan(salted)
        assert rows(salted.select("key", "i", "v")) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z")], "k string, o int, v string")
    assert rows(joins.first_per_key(df, "k", "o")) == [("a", 1, "y"), (None, 5, "z")]
    assert rows(joins.last_per_key(df, "k", "o")) == [("a", 2, "x"), (None, 5, "z")]
    # rows are combined before they are shuffled
    assert plan(joins.first_per_key(df, "k", "o")).count("Aggregate(") == 2


def test_hot_keys_end_to_end(spark):
    """A third of all reviews belong to one product and carry one id."""
    n = 3000
    data = [
        ("hot" if i % 3 == 0 else f"r{i}", "hot" if i % 3 == 0 else f"u{i % 100}", i % 5 + 1, i)
        for i in range(n)
    ]
    reviews = spark.createDataFrame(data, "review_id string, product_url string, rating int, seq int")
    reviews = reviews.withColumns({"verified_purchaser": F.lit(True), "helpful_count": F.lit(1)})
    first = merge.first_review_per_key(reviews)
    assert first.count() == len({d[0] for d in data})
    assert first.filter("review_id = 'hot'").first().seq == 0
    rollup = {r.product_url: r for r in stats.review_rollup_by_product(reviews).collect()}
    assert rollup["hot"].reviews == n // 3 == rollup["hot"].helpful_total
    assert sum(r.reviews for r in rollup.values()) == n
    shown = filters.named_reviewers(
        reviews.withColumn("reviewer", F.col("review_id")), ["product_url"], ["seq"]
    )
    assert rows(shown.filter("product_url = 'hot'").select("seq", "shown")) == [(0, 1), (3, 2), (6, 3)]
    updates = first.select("review_id", F.lit("x").alias("mark"))
    assert merge.keyed_update(reviews, updates).filter("mark = 'x'").count() == n
    assert merge.keyed_update(reviews, updates, first_by="seq").filter("mark = 'x'").count() == first.count()


# --- merging ----------------------------------------------------------------
def test_upsert_is_idempotent(spark):
    old = spark.sql("SELECT 'u' product_url, 1.0D average_rating, timestamp'2025-01-01' extracted_at, 1 seq")
    new = spark.sql(
        "SELECT 'u' product_url, 2.0D average_rating, timestamp'2025-01-02' extracted_at, 1 seq"
        " UNION ALL SELECT 'w', 3.0D, timestamp'2025-01-01', 2"
    )
    once = merge.upsert_latest(old, new)
    twice = merge.upsert_latest(once, new)
    assert rows(once) == rows(twice)
    assert [r[:2] for r in rows(once)] == [("u", 2.0), ("w", 3.0)]


def test_keyed_update(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 7)], "seq int, id string, n int")
    updates = spark.createDataFrame([("a", None, "new")], "id string, n int, extra string")
    everywhere = merge.keyed_update(target, updates, "id")
    assert rows(everywhere) == [(1, "a", None, "new"), (2, "a", None, "new"), (3, "b", 7, None)]
    first = merge.keyed_update(target, updates, "id", first_by="seq")
    assert rows(first) == [(1, "a", None, "new"), (2, "a", 6, None), (3, "b", 7, None)]


def test_latest_price_keeps_two_rows_per_task(spark):
    df = spark.sql("SELECT concat('p', id % 1) product_id, timestamp'2025-01-01' + make_dt_interval(id) timestamp,"
                   " double(id) current_price, id FROM range(100)")
    latest = prices.latest_price(df, "id")
    assert rows(latest.select("current_price", "previous_price", "price_change")) == [(99.0, 98.0, 1.0)]
    assert "WindowGroupLimit" in plan(latest)


# --- products ---------------------------------------------------------------
def test_rejects_and_strict_nulls(spark, tmp_path):
    lines = [
        '{"title": "a", "product_url": "x1p.html", "sku": null}',
        '{"title": "b", "product_url": "x2p.html"}',
        '{"title": "c", "product_url": "none", "price": "$1"}',
        '{"title": "d", "product_url": "x3p.html", "price": "price was ,"}',
    ]
    (tmp_path / "p.json").write_text("\n".join(lines))
    raw = readers.read_products(spark, str(tmp_path), mark_nulls=True)
    reasons = products.with_reject_reason(raw).select("title", "reject_reason")
    assert rows(reasons) == [
        ("a", None), ("b", None), ("c", "no_product_id"), ("d", "unreadable_discount"),
    ]
    strict = products.rejected_products(raw, strict_nulls=True).select("title", "reject_reason")
    assert rows(strict) == [("a", "null_sku"), ("c", "no_product_id"), ("d", "unreadable_discount")]


def test_clean_and_rejected_make_the_whole(tables, spark):
    job = pipelines.clean_products(tables.raw_products, tables.ratings_summary)
    cleaned, rejected = job.cleaned.count(), job.rejected.count()
    total = tables.raw_products.count()
    assert cleaned + rejected == total
    assert job.summary.get == {"total": total, "cleaned": cleaned, "errors": rejected}
    assert set(schemas.PRODUCT_CLEAN.names) <= set(job.cleaned.columns)


def test_statistics_of_empty_tables(spark):
    empty = spark.createDataFrame([], schemas.REVIEW_SENTIMENT)
    assert rows(stats.nlp_stats(empty)) == [(0, 0, 0, 0.0)]
    assert rows(stats.sentiment_coverage(empty)) == [(0, 0, 0.0)]
    assert rows(stats.sentiment_stats(empty)) == [(0, 0, [], 0.0)]
    marked = spark.createDataFrame([], "reject_reason string")
    assert rows(stats.cleaning_summary(marked)) == [(0, 0, 0, 0.0)]


# --- text -------------------------------------------------------------------
def test_second_incremental_run_has_nothing_to_do(spark):
    reviews = spark.createDataFrame(
        [("r1", "T", "Good bike. Bad seat."), ("r2", "", "  "), ("r3", None, None)],
        "review_id string, title string, body string",
    )
    run_ts = F.lit("2025-08-05 12:00:00").cast("timestamp")
    once = pipelines.process_reviews_nlp(reviews, concatenate=False, run_ts=run_ts)
    assert nlp.nlp_incremental(once).count() == 0
    assert filters.present_field(once, "sentences").count() == 1
    again = pipelines.process_reviews_nlp(once, concatenate=False)
    assert rows(again) == rows(once.select(again.columns))


def test_enrichment_stays_in_the_jvm_without_shuffle(tables):
    text = plan(nlp.nlp_enrich(tables.spark.read.parquet(tables.path("documents")).selectExpr(
        "doc_id", "text AS body", "source AS title")))
    assert "Python" not in text and "Exchange" not in text


def test_keywords_limit_before_shuffle(tables):
    df = nlp.top_keywords(tables.documents.select("lang", "text"), "text", "lang", 5)
    assert "WindowGroupLimit" in plan(df)
    assert df.groupBy("lang").count().filter("count > 5").count() == 0


# --- sentiment --------------------------------------------------------------
def brute_force(text, valence, polarity, mods):
    """The published rules, one review at a time in plain Python."""
    if not text or not text.strip():
        return None
    toks = []
    for piece in text.split():
        bare = piece.strip(string.punctuation)
        toks.append(bare if len(bare) > 2 else piece)
    toks = [t for t in toks if len(t) > 1]
    low = [t.lower() for t in toks]
    caps = [t.upper() == t and t.lower() != t for t in toks]
    mixed = any(caps) and not all(caps)
    scores, pols = [], []
    for i, word in enumerate(low):
        v = valence.get(word, 0.0)
        if v:
            if caps[i] and mixed:
                v += math.copysign(0.733, v)
            for d, decay in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i - d >= 0 and low[i - d] not in valence:
                    boost = mods.get((low[i - d], "booster"))
                    if boost is not None:
                        v += math.copysign(1, v) * boost * decay
                    if (low[i - d], "negator") in mods:
                        v *= mods[(low[i - d], "negator")]
            if "but" in low:
                v *= 0.5 if i < low.index("but") else 1.5 if i > low.index("but") else 1
        scores.append(v)
        if word in polarity:
            p = polarity[word]
            intensity = mods.get((low[i - 1], "intensity")) if i >= 1 else None
            if intensity and i >= 2 and (low[i - 2], "negator") in mods:
                p = p * -0.5 / intensity
            elif i >= 1 and (low[i - 1], "negator") in mods:
                p *= -0.5
            elif intensity:
                p *= intensity
            pols.append(max(-1, min(1, p)))
    n_bang, n_q = text.count("!"), text.count("?")
    amp = min(n_bang, 4) * 0.292 + (0 if n_q <= 1 else n_q * 0.18 if n_q <= 3 else 0.96)
    total = sum(scores)
    total += math.copysign(amp, total) if total else 0
    up = sum(s + 1 for s in scores if s > 0)
    down = sum(s - 1 for s in scores if s < 0)
    flat = sum(1 for s in scores if s == 0)
    if up > -down:
        up += amp
    elif up < -down:
        down -= amp
    mass = up - down + flat
    return (
        total / math.sqrt(total * total + 15),
        *((up / mass, -down / mass, flat / mass) if mass else (0, 0, 0)),
        sum(pols) / len(pols) if pols else 0.0,
    )


def test_scores_match_brute_force(spark, tables):
    valence = {r.word: float(r.valence) for r in tables.valence_lexicon.collect()}
    polarity = {r.word: float(r.polarity) for r in tables.polarity_lexicon.collect()}
    mods = {(r.word, r.kind): float(r.value) for r in tables.modifiers.collect()}
    rng = random.Random(7)
    words = [*valence, *{w for w, _ in mods}, "but", "bike", "seat", "a", "GREAT", "BAD", "(good)", "ok!"]
    texts = [
        " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) + rng.choice(["", "!", "?!?", "????", " !!!!!"])
        for _ in range(400)
    ] + ["", "  ", None, "GOOD", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, body string")
    got = sentiment.raw_scores(df, tables.words, "seq").orderBy("seq").collect()
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        want = brute_force(text, valence, polarity, mods)
        assert row.blank == (want is None)
        if want:
            for value, expected in zip(row[2:], want):
                assert value == pytest.approx(expected, abs=6e-4), text


def test_sentiment_struct_of_blank_text(spark, tables):
    df = spark.createDataFrame([(1, None), (2, " \n"), (3, "Good bike")], "seq int, body string")
    got = {r.seq: r.sentiment_analysis for r in sentiment.sentiment_table(df, tables.words, "seq").collect()}
    for seq in (1, 2):
        assert got[seq].asDict(True) == {
            "sentiment": "neutral", "confidence_score": 0.0, "combined_score": None,
            "vader_scores": None, "textblob_polarity": 0.0, "method": "no_text",
        }
    assert got[3].sentiment == "positive" and 0 <= got[3].confidence_score <= 1


def test_sentiment_plan(spark, tables):
    text = plan(sentiment.raw_scores(tables.reviews_raw, tables.words, "seq"))
    assert "BroadcastHashJoin" in text
    assert "Python" not in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_sentiment_incremental_limit_and_force(spark, tables):
    reviews = spark.createDataFrame(
        [("a", 1, "good"), ("a", 2, "bad"), ("b", 3, "bad"), (None, 4, "ok"), ("", 5, "ok")],
        "review_id string, seq int, body string",
    )
    after = pipelines.score_reviews(reviews, tables.words)
    labels = rows(after.select("seq", "sentiment_analysis.sentiment"))
    assert [r[0] for r in labels] == [1, 2, 3, 4, 5]
    assert labels[0][1] == labels[1][1] == "positive" and labels[2][1] == "negative"
    assert labels[3][1] is None and labels[4][1] is None
    assert sentiment.sentiment_incremental(after, tables.words).count() == 0
    assert sentiment.sentiment_incremental(after, tables.words, force=True).count() == 2
    assert sentiment.sentiment_incremental(reviews, tables.words, limit=2).count() == 1


# --- extraction -------------------------------------------------------------
def test_wide_page_is_read_whole(spark):
    cards = "".join(f'<article><h3>t{i}</h3><a href="/pdp/{i}">x</a></article>' for i in range(500))
    filler = "<p>" + "word " * 20000 + "</p>"
    page = spark.createDataFrame([("https://h/l", filler + cards)], "url string, html string")
    listing = extract.product_listing(page)
    assert listing.count() == 500
    assert listing.agg(F.max("position")).first()[0] == 500
    assert "Python" not in plan(listing)


def test_nested_sections_and_missing_container(spark):
    html = '<div id="reviews_container"><section id="bv-review-1"><h3>A</h3></section></div>'
    pages = spark.createDataFrame([("u", html), ("v", "<p>no</p>"), ("w", "")], "product_url string, html string")
    got = extract.extract_reviews(pages).collect()
    assert [(r.product_url, r.position, r.review_id, r.title, r.body, r.helpful_count) for r in got] == [
        ("u", 1, "bv-review-1", "A", None, 0)
    ]


# --- quality and layout -----------------------------------------------------
def test_layout_splits_nothing_away(spark, tables, tmp_path):
    df = products.derive_product(tables.raw_products).select("category", "brand", "product_id")
    writers.write_layout(df, str(tmp_path / "l"), "category", "brand")
    back = spark.read.parquet(str(tmp_path / "l"))
    assert rows(back.select("category", "brand", "product_id")) == rows(df)
    assert "PartitionFilters: [isnotnull(category" in plan(back.filter("category = 'bikes'"))
    assert quality.unique_violations(back, "product_id").count() >= 0


# --- sources ----------------------------------------------------------------
def test_missing_and_broken_inputs(spark, tmp_path):
    nowhere = str(tmp_path / "nowhere")
    assert readers.read_reviews(spark, nowhere).count() == 0
    assert readers.read_ratings_map(spark, nowhere).count() == 0
    with pytest.raises(Exception):
        readers.read_products(spark, nowhere).count()
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "r.json").write_text('[{"review_id": ')
    assert readers.read_reviews(spark, str(broken), multi_line=True).count() == 0
    assert readers.read_ratings_map(spark, str(broken), whole_files=True).count() == 0
    with pytest.raises(Exception):
        readers.read_products(spark, str(broken), multi_line=True).collect()


def test_page_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.html").write_text(f"<h1>{name}</h1>\n<p>x</p>")
    got = extract.product_details(readers.read_page_files(spark, str(tmp_path)), "url")
    assert [r.detailed_title for r in got.orderBy("url").collect()] == ["a", "b"]


def test_json_array_and_keyed_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"title": "x", "product_url": "u"},\n {"title": "y"}\n]')
    assert rows(readers.read_products(spark, str(tmp_path / "a.json"), multi_line=True).select("title")) == [
        ("x",), ("y",),
    ]
    (tmp_path / "m.json").write_text(
        '{\n "u": {"average_rating": 4.5, "total_reviews": 2, "rating_distribution": {"5": 2}},\n "v": {}\n}'
    )
    got = readers.read_ratings_map(spark, str(tmp_path / "m.json"), whole_files=True)
    assert rows(got.select("product_url", "average_rating", "rating_distribution")) == [
        ("u", 4.5, {5: 2}), ("v", None, None),
    ]


def test_refresh_keeps_or_empties_reviews(spark, tmp_path):
    at = [str(tmp_path / n) for n in ("p", "r")]
    df = spark.range(3).toDF("n")
    writers.full_refresh_load(df, df, *at)
    writers.full_refresh_load(df.limit(1), None, *at)
    assert [writers.read_version(spark, p).count() for p in at] == [1, 3]
    writers.full_refresh_load(df, df.limit(0), *at)
    assert [writers.read_version(spark, p).count() for p in at] == [3, 0]


def test_clearing_needs_the_word(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    assert rows(writers.clear_tables(spark, "delete", t=path)) == [("t", 4, 0, 4), ("total", 4, 0, 4)]
    assert rows(writers.clear_tables(spark, "DELETE", t=path)) == [("t", 4, 4, 0), ("total", 4, 4, 0)]
    assert spark.read.parquet(path).columns == ["id"]


def test_export_forms(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2025-08-05 01:02:03' t, CAST(1.50 AS DECIMAL(5,2)) d, NULL AS s, array(1) a")
    writers.export_collection(df, str(tmp_path / "e"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert line == '{"t":"2025-08-05T01:02:03","d":"1.50","s":null,"a":[1]}'


# --- streams ----------------------------------------------------------------
def test_stream_resumes_and_dedups(spark, tmp_path):
    source, out, place = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "review_id string, seq int"
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], schema)
    first.write.parquet(source)
    stream = jobs.parquet_stream(spark, source, first.schema)
    dedup = jobs.dedup_batches(out, first.schema)
    jobs.run_available(stream, dedup, out, place)
    assert rows(jobs.written(spark, out)) == [("a", 1), ("b", 3)]
    spark.createDataFrame([("b", 4), ("c", 5)], schema).write.mode("append").parquet(source)
    second = jobs.run_available(stream, dedup, out, place)
    assert rows(jobs.written(spark, out)) == [("a", 1), ("b", 3), ("c", 5)]
    assert sum(p.numInputRows for p in second.recentProgress) == 2
    third = jobs.run_available(stream, dedup, out, place)
    assert sum(p.numInputRows for p in third.recentProgress) == 0


def test_repeated_batch_replaces_its_own_output(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1)], "review_id string, seq int")
    dedup = jobs.dedup_batches(out, df.schema)
    for _ in range(2):  # the second time as after a failure before the commit
        dedup(df, 0).write.mode("overwrite").parquet(f"{out}/batch=0")
    assert rows(jobs.written(spark, out)) == [("a", 1)]


def test_stream_reads_files_and_folders(spark, tmp_path):
    """The registered streams work on one file as on a folder of part files."""
    from conftest import SMALL

    from shelfsense.workload import runners

    for name in ("part", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    run = runners()["dedup_batch"]
    assert rows(run(spark, str(tmp_path))) == rows(run(spark, SMALL))


def test_observed_progress(spark, tmp_path):
    source = str(tmp_path / "src")
    spark.range(10).write.parquet(source)
    stream = jobs.parquet_stream(spark, source, spark.range(1).schema).observe(
        "rows", F.count(F.lit(1)).alias("n")
    )
    query = jobs.run_available(stream, lambda df, _: df, str(tmp_path / "o"), str(tmp_path / "c"))
    assert sum(r["n"] for r in jobs.observed_progress(query, "rows")) == 10


def test_harvest_reads_every_page(tables):
    """Pages far down are read unless a limit is asked for."""
    url = "product_url"
    stored = tables.reviews_raw.filter("rating = 5")
    run_ts = F.lit("2025-08-05 12:00:00").cast("timestamp")
    ratings = tables.ratings_summary.withColumn("extracted_at", run_ts)
    pages = tables.review_pages.select(
        url, "html", F.when(F.col("page_no") > 1, F.lit(40)).otherwise(F.col("page_no")).alias("page_no")
    )

    def late(*limit):
        job = pipelines.harvest_reviews(tables.products_raw, pages, stored, ratings, run_ts, *limit)
        return job.reviews.filter("page_no = 40").count()

    assert late() > 0 and late() == late(40) and late(39) == 0
    assert extract.paginate_union(pages).count() == pages.count()
    assert extract.paginate_union(pages, 1).count() == pages.filter("page_no = 1").count()


def test_harvest_searches_only_pages_whose_reviews_are_taken(tables):
    """Products that cannot be read are dropped before their pages are parsed, not after (F3, F4)."""
    stored = tables.reviews_raw.filter("rating = 5")
    run_ts = F.lit("2025-08-05 12:00:00").cast("timestamp")
    ratings = tables.ratings_summary.withColumn("extracted_at", run_ts)
    pages = tables.review_pages.select("product_url", "html", "page_no")
    job = pipelines.harvest_reviews(tables.products_raw, pages, stored, ratings, run_ts)
    assert "LeftSemi" not in plan(job.reviews).split("posexplode")[0]
