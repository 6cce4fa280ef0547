"""Tokenising and sentiment."""

import string

from pyspark.sql import functions as F

from ..functions import product as p
from ..functions import tokens
from ..functions.text import OTHER_SPACE, SPACE
from ..operators import joins, nlp, sentiment, stats
from . import sqlkit as q
from .registry import Tables, query

URL = "product_url"


# --- checking SQL -----------------------------------------------------------
def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chain(x: str, rules) -> str:
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(replacement)}, 'g')"
    return x


def sentences_sql(text: str) -> str:
    marked = _chain(f"' ' || {text}", tokens.SENTENCE_RULES)
    pieces = f"string_split({marked}, '{tokens.BREAK}')"
    stripped = f"list_transform({pieces}, lambda s: {q.strip('s')})"
    return f"list_filter({stripped}, lambda s: s <> '')"


def words_sql(text: str) -> str:
    marked = _chain(f"' ' || {text}", tokens.SENTENCE_RULES)
    spaced = _chain(marked, ((OTHER_SPACE, " "), *tokens.WORD_RULES))
    pieces = f"string_split(replace({spaced}, '{tokens.BREAK}', ' '), ' ')"
    kept = f"list_filter({pieces}, lambda w: w <> '')"
    cases = " ".join(
        f"WHEN {_lit(w)} THEN [substr(w, 1, {n}), substr(w, {n + 1})]"
        for w, n in tokens.JOINED_WORDS.items()
    )
    return f"flatten(list_transform({kept}, lambda w: CASE lower(w) {cases} ELSE [w] END))"


TEXT_USED = f"""CASE WHEN {q.strip("coalesce(body, '')")} <> '' THEN body END"""
FULL_TEXT = "CASE WHEN coalesce(title, '') <> '' THEN concat_ws(' ', title, body) ELSE body END"

_PUNCT = _lit(string.punctuation)
_UPPER = "t = upper(t) AND t <> lower(t)"
SCORES = f"""texts AS (
    SELECT seq, product_url, rating, body, {q.strip("body")} = '' AS blank,
      length(body) - length(replace(body, '!', '')) AS bangs,
      length(body) - length(replace(body, '?', '')) AS queries,
      list_filter(list_transform(string_split_regex({q.strip("body")}, '{SPACE}+'),
        lambda t: CASE WHEN length(trim(t, {_PUNCT})) > 2 THEN trim(t, {_PUNCT}) ELSE t END),
        lambda t: length(t) > 1) AS toks
    FROM reviews_raw),
  facts AS (
    SELECT seq, len(toks) AS n, len(list_filter(toks, lambda t: {_UPPER})) AS caps,
      list_position(list_transform(toks, lambda t: lower(t)), 'but') AS but_at FROM texts),
  toks AS (
    SELECT seq, unnest(toks) AS t, generate_subscripts(toks, 1) AS place FROM texts),
  known AS (
    SELECT toks.seq, place, t, lower(t) AS w, CAST(v.valence AS DOUBLE) AS valence,
      CAST(p.polarity AS DOUBLE) AS polarity, CAST(b.value AS DOUBLE) AS booster,
      CAST(g.value AS DOUBLE) AS negator, CAST(i.value AS DOUBLE) AS intensity
    FROM toks LEFT JOIN valence_lexicon v ON v.word = lower(t)
    LEFT JOIN polarity_lexicon p ON p.word = lower(t)
    LEFT JOIN modifiers b ON b.word = lower(t) AND b.kind = 'booster'
    LEFT JOIN modifiers g ON g.word = lower(t) AND g.kind = 'negator'
    LEFT JOIN modifiers i ON i.word = lower(t) AND i.kind = 'intensity'),
  near AS (
    SELECT *, lag(valence, 1) OVER w AS v1, lag(valence, 2) OVER w AS v2, lag(valence, 3) OVER w AS v3,
      lag(booster, 1) OVER w AS b1, lag(booster, 2) OVER w AS b2, lag(booster, 3) OVER w AS b3,
      lag(negator, 1) OVER w AS g1, lag(negator, 2) OVER w AS g2, lag(negator, 3) OVER w AS g3,
      lag(intensity, 1) OVER w AS i1
    FROM known WINDOW w AS (PARTITION BY seq ORDER BY place)),
  s0 AS (
    SELECT near.*, but_at, CASE WHEN caps > 0 AND caps < n AND {_UPPER}
      THEN valence + sign(valence) * 0.733 ELSE valence END AS x
    FROM near JOIN facts ON near.seq = facts.seq),
  s1 AS (SELECT *, CASE WHEN v1 IS NULL AND b1 IS NOT NULL THEN x + sign(x) * b1 * 1.0 ELSE x END AS x1 FROM s0),
  s1n AS (SELECT *, CASE WHEN v1 IS NULL AND g1 IS NOT NULL THEN x1 * g1 ELSE x1 END AS y1 FROM s1),
  s2 AS (SELECT *, CASE WHEN v2 IS NULL AND b2 IS NOT NULL THEN y1 + sign(y1) * b2 * 0.95 ELSE y1 END AS x2 FROM s1n),
  s2n AS (SELECT *, CASE WHEN v2 IS NULL AND g2 IS NOT NULL THEN x2 * g2 ELSE x2 END AS y2 FROM s2),
  s3 AS (SELECT *, CASE WHEN v3 IS NULL AND b3 IS NOT NULL THEN y2 + sign(y2) * b3 * 0.9 ELSE y2 END AS x3 FROM s2n),
  s3n AS (SELECT *, CASE WHEN v3 IS NULL AND g3 IS NOT NULL THEN x3 * g3 ELSE x3 END AS y3 FROM s3),
  final AS (
    SELECT seq, CAST(CASE WHEN place < but_at THEN y3 * 0.5 WHEN place > but_at THEN y3 * 1.5 ELSE y3 END AS DECIMAL(28,12)) AS v,
      CAST(CASE WHEN polarity IS NULL THEN NULL ELSE least(greatest(
        CASE WHEN g2 IS NOT NULL AND i1 IS NOT NULL THEN polarity * -0.5 / i1
          WHEN g1 IS NOT NULL THEN polarity * -0.5 WHEN i1 IS NOT NULL THEN polarity * i1
          ELSE polarity END, -1), 1) END AS DECIMAL(28,12)) AS pol
    FROM s3n),
  sums AS (
    SELECT seq, CAST(coalesce(sum(v), 0) AS DOUBLE) AS total,
      CAST(coalesce(sum(CASE WHEN v > 0 THEN v + 1 END), 0) AS DOUBLE) AS up,
      CAST(coalesce(sum(CASE WHEN v < 0 THEN v - 1 END), 0) AS DOUBLE) AS down,
      count(CASE WHEN v <> 0 THEN 1 END) AS charged,
      CAST(coalesce(sum(pol), 0) AS DOUBLE) AS pol_total, count(pol) AS pol_words
    FROM final GROUP BY seq),
  amped AS (
    SELECT x.seq, x.product_url, x.rating, x.blank, coalesce(f.n, 0) AS n, coalesce(total, 0) AS total,
      coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(charged, 0) AS charged,
      coalesce(pol_total, 0) AS pol_total, coalesce(pol_words, 0) AS pol_words,
      least(bangs, 4) * CAST(0.292 AS DOUBLE) + CASE WHEN queries <= 1 THEN CAST(0 AS DOUBLE)
        WHEN queries <= 3 THEN queries * CAST(0.18 AS DOUBLE) ELSE CAST(0.96 AS DOUBLE) END AS amp
    FROM texts x LEFT JOIN facts f ON x.seq = f.seq LEFT JOIN sums s ON x.seq = s.seq),
  masses AS (
    SELECT *, total + sign(total) * amp AS loud, CASE WHEN up > -down THEN up + amp ELSE up END AS lu,
      CASE WHEN up < -down THEN down - amp ELSE down END AS ld, n - charged AS flat FROM amped),
  raw_scores AS (
    SELECT seq, product_url, rating, blank, {q.rn("loud / sqrt(loud * loud + 15)", 4)} AS compound,
      CASE WHEN lu - ld + flat > 0 THEN {q.rn("lu / (lu - ld + flat)", 3)} ELSE 0.0 END AS positive,
      CASE WHEN lu - ld + flat > 0 THEN {q.rn("abs(ld) / (lu - ld + flat)", 3)} ELSE 0.0 END AS negative,
      CASE WHEN lu - ld + flat > 0 THEN {q.rn("flat / (lu - ld + flat)", 3)} ELSE 0.0 END AS neutral,
      CASE WHEN pol_words > 0 THEN pol_total / pol_words ELSE 0.0 END AS polarity
    FROM masses),
  fused AS (
    SELECT *, (compound + polarity) / 2 AS combined,
      least(greatest((1 - abs(compound - polarity) / 2) * 0.6 + abs((compound + polarity) / 2) * 0.4, 0), 1) AS conf
    FROM raw_scores),
  labelled AS (
    SELECT *, CASE WHEN combined >= 0.1 THEN 'positive' WHEN combined <= -0.1 THEN 'negative'
      ELSE 'neutral' END AS label FROM fused),
  scored AS (
    SELECT seq, product_url, rating, CASE WHEN blank THEN 'neutral' ELSE label END AS sentiment,
      CASE WHEN blank THEN 0.0 ELSE {q.rn("conf", 3)} END AS confidence_score,
      CASE WHEN NOT blank THEN {q.rn("combined", 3)} END AS combined_score,
      CASE WHEN NOT blank THEN {q.rn("compound", 3)} END AS compound,
      CASE WHEN NOT blank THEN positive END AS positive, CASE WHEN NOT blank THEN negative END AS negative,
      CASE WHEN NOT blank THEN neutral END AS neutral,
      CASE WHEN blank THEN 0.0 ELSE {q.rn("polarity", 3)} END AS textblob_polarity,
      CASE WHEN blank THEN 'no_text' ELSE 'vader_textblob_combined' END AS method
    FROM labelled)"""
FLAT = ("sentiment, confidence_score, combined_score, compound, positive, negative, neutral, "
        "textblob_polarity, method")


# --- tokens -----------------------------------------------------------------
@query("sentences", f"SELECT seq, array_to_string({sentences_sql('body')}, ' | ') AS sentences FROM reviews_raw")
def sentences(t: Tables):
    return t.reviews_raw.select(
        "seq", F.array_join(tokens.sentences(F.col("body")), " | ").alias("sentences")
    )


@query("words", f"SELECT seq, array_to_string({words_sql('body')}, ' ') AS words FROM reviews_raw")
def words(t: Tables):
    return t.reviews_raw.select(
        "seq", F.array_join(tokens.words(F.col("body")), " ").alias("words")
    )


@query(
    "array_counts",
    f"""SELECT seq, review_id, CAST(len({sentences_sql('body')}) AS INTEGER) AS sentences_count,
    CAST(len({words_sql('body')}) AS INTEGER) AS words_count, true AS updated
    FROM reviews_raw WHERE {q.strip('body')} <> ''""",
)
def array_counts(t: Tables):
    return nlp.nlp_result(nlp.nlp_incremental(t.reviews_raw), "seq")


@query(
    "nlp_enrich",
    f"""SELECT seq, review_id, array_to_string({sentences_sql('x')}, ' | ') AS sentences,
    CAST(len({words_sql('x')}) AS INTEGER) AS words_count, CASE WHEN x IS NOT NULL THEN true END AS nlp_concatenated,
    x AS nlp_text_used FROM (SELECT seq, review_id, CASE WHEN {q.strip(FULL_TEXT)} <> '' THEN {FULL_TEXT} END AS x
    FROM reviews_raw)""",
)
def nlp_enrich(t: Tables):
    enriched = nlp.nlp_enrich(t.reviews_raw, concatenate=True)
    size = F.when(F.col("words").isNotNull(), F.size("words"))
    return enriched.select(
        "seq", "review_id", F.array_join("sentences", " | ").alias("sentences"),
        size.alias("words_count"), "nlp_concatenated", "nlp_text_used",
    )


def _partly_tokenised(t: Tables):
    """Reviews of verified purchasers have been through an earlier run."""
    before = F.when(F.col("verified_purchaser"), F.array(F.lit("earlier run")))
    return t.reviews_raw.withColumn("sentences", before)


@query(
    "nlp_incremental",
    f"""SELECT seq, review_id, CAST(len({sentences_sql('body')}) AS INTEGER) AS sentences_count
    FROM reviews_raw WHERE NOT verified_purchaser AND {q.strip('body')} <> ''""",
)
def nlp_incremental(t: Tables):
    fresh = nlp.nlp_incremental(_partly_tokenised(t))
    return fresh.select("seq", "review_id", F.size("sentences").alias("sentences_count"))


_STOP = ", ".join(_lit(w) for w in tokens.STOP_WORDS)


@query(
    "top_keywords",
    f"""WITH {q.BY_URL}, uses AS (SELECT category, lower(w) AS word FROM (
        SELECT b.category, unnest({words_sql('r.body')}) AS w FROM reviews_raw r JOIN by_url b
        ON r.product_url = b.product_url WHERE {q.strip('r.body')} <> '')
      WHERE length(w) >= 3 AND lower(w) NOT IN ({_STOP})),
    counted AS (SELECT category, word, count(*) AS uses FROM uses GROUP BY category, word)
    SELECT category, word, uses, CAST(row_number() OVER (PARTITION BY category ORDER BY uses DESC, word) AS INTEGER)
    AS place FROM counted QUALIFY place <= 10""",
)
def top_keywords(t: Tables):
    lookup = t.products_raw.select("k", URL, p.category(F.col("title")).alias("category"))
    return nlp.top_keywords_by_product(t.reviews_raw, lookup, "category", 10)


# --- sentiment --------------------------------------------------------------
@query(
    "valence_scores",
    f"WITH {SCORES} SELECT seq, compound, positive, negative, neutral FROM raw_scores",
)
def valence_scores(t: Tables):
    scores = sentiment.raw_scores(t.reviews_raw, t.words, "seq")
    return scores.select("seq", "compound", "positive", "negative", "neutral")


@query("polarity_score", f"WITH {SCORES} SELECT seq, {q.rn('polarity', 6)} AS polarity FROM raw_scores")
def polarity_score(t: Tables):
    from ..functions.text import round_n

    scores = sentiment.raw_scores(t.reviews_raw, t.words, "seq")
    return scores.select("seq", round_n(F.col("polarity"), 6).alias("polarity"))


def _fused(t: Tables):
    return sentiment.fused_scores(sentiment.raw_scores(t.reviews_raw, t.words, "seq"))


@query("combined_score", f"WITH {SCORES} SELECT seq, {q.rn('combined', 6)} AS combined_score FROM fused")
def combined_score(t: Tables):
    from ..functions.text import round_n

    return _fused(t).select("seq", round_n(F.col("combined"), 6).alias("combined_score"))


@query("sentiment_label", f"WITH {SCORES} SELECT seq, label AS sentiment FROM labelled")
def sentiment_label(t: Tables):
    return _fused(t).select("seq", "sentiment")


@query("confidence", f"WITH {SCORES} SELECT seq, {q.rn('conf', 3)} AS confidence FROM fused")
def confidence(t: Tables):
    from ..functions.text import round_n

    return _fused(t).select("seq", round_n(F.col("confidence"), 3).alias("confidence"))


@query("sentiment_struct", f"WITH {SCORES} SELECT seq, {FLAT} FROM scored")
def sentiment_struct(t: Tables):
    return sentiment.flatten_sentiment(
        sentiment.sentiment_table(t.reviews_raw, t.words, "seq")
    )


def _partly_scored(t: Tables):
    """Reviews of verified purchasers carry a score of an earlier run."""
    from .. import schemas

    old = F.struct(
        *[
            (F.lit("neutral") if f.name == "sentiment" else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.SENTIMENT
        ]
    )
    return t.reviews_raw.withColumn(
        "sentiment_analysis", F.when(F.col("verified_purchaser"), old)
    )


@query(
    "sentiment_incremental",
    f"""WITH {SCORES} SELECT r.seq, r.review_id, CASE WHEN r.verified_purchaser THEN 'neutral' ELSE s.sentiment END
    AS sentiment, CASE WHEN r.verified_purchaser THEN NULL ELSE s.confidence_score END AS confidence_score
    FROM reviews_raw r JOIN scored s ON r.seq = s.seq""",
)
def sentiment_incremental(t: Tables):
    from ..plans.pipelines import score_reviews

    after = score_reviews(_partly_scored(t), t.words, key="seq")
    s = "sentiment_analysis"
    return after.select(
        "seq", "review_id", F.col(f"{s}.sentiment").alias("sentiment"),
        F.col(f"{s}.confidence_score").alias("confidence_score"),
    )


@query(
    "sentiment_forced",
    f"""WITH {SCORES} SELECT r.review_id, s.sentiment, s.combined_score FROM scored s
    JOIN (SELECT review_id, min(seq) AS seq FROM reviews_raw GROUP BY review_id) r ON r.seq = s.seq""",
)
def sentiment_forced(t: Tables):
    fresh = sentiment.sentiment_incremental(_partly_scored(t), t.words, force=True)
    s = "sentiment_analysis"
    return fresh.select(
        "review_id", F.col(f"{s}.sentiment").alias("sentiment"),
        F.col(f"{s}.combined_score").alias("combined_score"),
    )


@query(
    "sentiment_sample",
    f"""WITH {SCORES}, sample AS (SELECT seq, review_id, body FROM reviews_raw WHERE NOT verified_purchaser
      ORDER BY review_id, seq LIMIT 5)
    SELECT x.review_id, CASE WHEN length(x.body) > 100 THEN substr(x.body, 1, 100) || '...' ELSE x.body END AS preview,
      s.sentiment FROM sample x JOIN scored s ON x.seq = s.seq""",
)
def sentiment_sample(t: Tables):
    scored = sentiment.sentiment_sample(_partly_scored(t), t.words)
    return scored.select(
        "review_id", "preview", F.col("sentiment_analysis.sentiment").alias("sentiment")
    )


def scored_reviews(t: Tables, *keep: str):
    return sentiment.sentiment_table(t.reviews_raw, t.words, "seq", keep=keep)


@query(
    "sentiment_breakdown",
    f"""WITH {SCORES} SELECT sentiment, count(*) AS count, {q.avg('confidence_score')} AS avg_confidence,
    {q.avg('combined_score')} AS avg_combined_score FROM scored GROUP BY sentiment""",
)
def sentiment_breakdown(t: Tables):
    return stats.sentiment_breakdown(scored_reviews(t))


@query(
    "sentiment_stats",
    f"""WITH {SCORES}, parts AS (SELECT sentiment, count(*) AS n, {q.avg('confidence_score')} AS c FROM scored
      GROUP BY sentiment)
    SELECT CAST(sum(n) AS BIGINT) AS total_documents, CAST(sum(n) AS BIGINT) AS documents_with_sentiment,
      100.0::DOUBLE AS coverage_percentage,
      string_agg(sentiment || '=' || n, ',' ORDER BY n DESC, sentiment DESC) AS breakdown FROM parts""",
)
def sentiment_stats(t: Tables):
    found = stats.sentiment_stats(scored_reviews(t))
    label = F.transform(
        "sentiment_breakdown", lambda e: F.concat(e["_id"], F.lit("="), e["count"])
    )
    return found.select(
        "total_documents", "documents_with_sentiment", "coverage_percentage",
        F.array_join(label, ",").alias("breakdown"),
    )


@query(
    "sentiment_by_category",
    f"""WITH {SCORES}, {q.BY_URL} SELECT b.category, b.brand, s.sentiment, count(*) AS reviews,
    {q.avg('s.confidence_score')} AS avg_confidence, {q.avg('s.combined_score')} AS avg_combined_score,
    {q.avg('s.rating')} AS avg_rating FROM scored s JOIN by_url b ON s.product_url = b.product_url
    GROUP BY b.category, b.brand, s.sentiment""",
)
def sentiment_by_category(t: Tables):
    title = F.col("title")
    lookup = t.products_raw.select(
        "k", URL, p.brand(title).alias("brand"), p.category(title).alias("category")
    )
    scored = scored_reviews(t, URL, "rating")
    return stats.sentiment_by_category(
        joins.reviews_with_products(scored, lookup, "category", "brand")
    )
