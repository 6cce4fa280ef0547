"""Scoring inside the row: equal to the joined form, and without text in a shuffle."""

import pytest
from pyspark.sql import functions as F

from shelfsense.operators import merge, sentiment, stats
from shelfsense.plans import pipelines


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(df) -> list[str]:
    """Columns under every exchange of the plan, as text."""
    found = []

    def walk(node):
        if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
            found.append(node.output().toString())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.inputPlan())

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a", "Not very GOOD but never really terrible!! is it??"), (2, "a", "GREAT"), (3, "b", None), (4, "b", "  "),
        (5, None, "good"), (6, "", "bad"), (7, "c", "but good, hardly GOOD. not extremely good BAD!!!!!! ok???"),
        (8, "d", "I WAS NEVER HAPPY"), (9, "e", "not very great"), (10, "e", "great"), (11, "e", "word " * 3000 + "love"),
        (12, "f", "great ok\tbad"), (13, "f", "!good! 'bad' (ok)"),
    ]
    return spark.createDataFrame(rows, "seq bigint, review_id string, body string")


def test_in_row_equals_joined(tables, odd):
    lexicon = sentiment.carried_words(tables.words)
    for reviews in (odd, tables.reviews_raw.select("seq", "review_id", "body")):
        row = sentiment.scores_in_row(reviews, lexicon, F.col("body")).select("seq", "_scores.*")
        joined = sentiment.joined_scores(reviews, tables.words, "seq", "body")
        assert sorted(map(tuple, row.collect())) == sorted(map(tuple, joined.collect()))


@pytest.mark.parametrize("force", [False, True])
def test_in_place_equals_update(tables, odd, force):
    when = F.lit("2025-08-05").cast("timestamp")
    words = tables.words
    old = sentiment.sentiment_table(odd, words, "seq").select("seq", "sentiment_analysis")
    reviews = odd.join(old, "seq").withColumn(
        "sentiment_analysis", F.when(F.col("seq").isin(1, 8, 10), F.col("sentiment_analysis"))
    )
    updates = sentiment.sentiment_incremental(reviews, words, None, force, "review_id", when)
    want = merge.keyed_update(reviews, updates, "review_id")
    got = pipelines.score_reviews(reviews, words, force=force, run_ts=when)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_row_speaks_whatever_the_lexicon(tables, odd, monkeypatch):
    carried = sentiment.sentiment_incremental(odd, tables.words).drop("sentiment_updated_at")
    small = sorted(map(str, carried.collect()))
    monkeypatch.setattr(sentiment, "CARRIED_WORDS", 3)
    assert sentiment.carried_words(tables.words) is None
    joined = sentiment.sentiment_incremental(odd, tables.words).drop("sentiment_updated_at")
    assert sorted(map(str, joined.collect())) == small


def test_no_text_moves_and_nothing_is_sorted(tables):
    reviews = tables.reviews_raw
    scored = sentiment.sentiment_table(reviews, tables.words, "seq", keep=("product_url", "rating"))
    forced = sentiment.sentiment_incremental(reviews, tables.words, force=True)
    by_label = stats.sentiment_breakdown(scored)
    for df in (scored, forced, by_label):
        assert "SortAggregate" not in plan_of(df)
    after = pipelines.score_reviews(reviews, tables.words)
    for df in (forced, by_label, after.select("review_id", "body", "sentiment_analysis")):
        # The review table itself is made by joins of documents; scoring adds no exchange of its text.
        before = sum("body" in columns for columns in exchanged(reviews.select("review_id", "body", "seq")))
        assert sum("body" in columns for columns in exchanged(df)) <= before
