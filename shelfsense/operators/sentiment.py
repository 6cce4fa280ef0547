"""Lexicon sentiment: a fold over the tokens of a row, or a join of tokens with word tables.

A lexicon of bounded size goes along with the plan as a table of hash buckets. A review is then
scored where it lies: its tokens look themselves up, the few that carry sentiment look at the
tokens before them, and the sums stay in the row. Nothing is exploded, sorted or shuffled.

A larger lexicon is joined. Every token carries its three predecessors, so neighbourhood rules
need no window, and partial aggregation folds a review to one row before the only shuffle, which
moves numbers and no text.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.html import bind, computed
from ..functions.sentiment import combined_score, confidence, sentiment_label, sentiment_struct
from ..functions.text import clamp, is_blank, preview, round_n, single_blanks
from ..session import measured
from .filters import limited_backlog, lowest_rows
from .joins import first_per_key, lookup_join
from .merge import keyed_update

EXACT = "decimal(28,12)"  # sums of decimals do not depend on the order of rows
EXACT_SUM = "decimal(36,12)"  # a sum of this and EXACT keeps its digits
REACH = 3
FACTS = ("valence", "polarity", "booster", "negator", "intensity")
#: A lexicon up to this many words and characters is part of the plan; a larger one is joined.
CARRIED_WORDS, CARRIED_CHARS = 20_000, 400_000


def word_table(valence: DataFrame, polarity: DataFrame, modifiers: DataFrame) -> DataFrame:
    """One row per word with everything the rules need to know about it."""
    blank = F.lit(None).cast("double")

    def modifier(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("value").cast("double")).alias(kind)

    kinds = ("booster", "negator", "intensity")
    rows = (
        valence.select(
            "word", F.col("valence").cast("double"), blank.alias("polarity"),
            *[blank.alias(k) for k in kinds],
        )
        .union(
            polarity.select(
                "word", blank.alias("valence"), F.col("polarity").cast("double"),
                *[blank.alias(k) for k in kinds],
            )
        )
        .union(
            modifiers.select(
                "word", blank.alias("valence"), blank.alias("polarity"),
                *[modifier(k) for k in kinds],
            )
        )
    )
    return rows.groupBy("word").agg(*[F.max(f).alias(f) for f in FACTS])


def sentiment_tokens(text: Column) -> Column:
    """White-space tokens without outer punctuation; short ones keep theirs, single
    characters are dropped."""

    def kept(pieces: Column) -> Column:
        bare = F.transform(pieces, lambda token: F.btrim(token, F.lit(string.punctuation)))
        return F.zip_with(pieces, bare, lambda token, inside: F.when(F.length(inside) > 2, inside).otherwise(token))

    return F.filter(bind(F.split(single_blanks(text), " ", -1), kept), lambda t: F.length(t) > 1)


def _is_caps(token: Column) -> Column:
    return (token == F.upper(token)) & (token != F.lower(token))


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _shifted(tokens: Column, by: int) -> Column:
    return F.concat(F.array_repeat(F.lit(None).cast("string"), by), tokens)


def token_rows(reviews: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per token with its place and predecessors; a blank review gives one row
    without a token."""
    body = F.coalesce(F.col(text), F.lit(""))
    per_review = reviews.select(
        key,
        *keep,
        is_blank(body).alias("blank"),
        _count_of(body, "!").alias("bangs"),
        _count_of(body, "?").alias("queries"),
        sentiment_tokens(body).alias("tokens"),
    ).withColumn("low", F.transform("tokens", lambda t: F.lower(t)))
    scalars = per_review.select(
        key, *keep, "blank", "bangs", "queries", "tokens", "low",
        F.size("tokens").alias("n_tokens"),
        F.nullif(F.array_position("low", "but"), F.lit(0)).alias("but_at"),
        (
            F.exists("tokens", lambda t: ~_is_caps(t)) & F.exists("tokens", _is_caps)
        ).alias("mixed_case"),
    )
    zipped = F.arrays_zip(
        F.col("tokens").alias("token"),
        F.col("low").alias("word"),
        *[_shifted(F.col("low"), d).alias(f"p{d}") for d in range(1, REACH + 1)],
    )
    return scalars.select(
        key, *keep, "blank", "bangs", "queries", "n_tokens", "but_at", "mixed_case",
        F.posexplode_outer(F.slice(zipped, F.lit(1), F.col("n_tokens"))).alias("at", "t"),
    ).select(
        key, *keep, "blank", "bangs", "queries", "n_tokens", "but_at", "mixed_case",
        (F.col("at") + 1).alias("at"), "t.*",
    )


def _with_facts(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Look the token up, then its predecessors, the latter only for sentiment words."""
    found = lookup_join(tokens, words.select("word", "valence", "polarity"), "word")
    scored = F.col("valence").isNotNull() | F.col("polarity").isNotNull()
    for d in range(1, REACH + 1):
        neighbour = words.select(
            F.col("word").alias(f"p{d}"),
            F.col("valence").isNotNull().alias(f"known{d}"),
            F.col("booster").alias(f"booster{d}"),
            F.col("negator").alias(f"negator{d}"),
            F.col("intensity").alias(f"intensity{d}"),
        )
        found = found.withColumn(f"p{d}", F.when(scored, F.col(f"p{d}")))
        found = lookup_join(found, neighbour, f"p{d}")
    return found


def _token_valence(found: DataFrame) -> DataFrame:
    v = F.col("v")
    emphasis = F.col("mixed_case") & _is_caps(F.col("token"))
    found = found.withColumn("v", F.col("valence")).withColumn(
        "v", F.when(emphasis, v + F.signum(v) * fixed.CAPS_BOOST).otherwise(v)
    )
    for d, decay in enumerate(fixed.DISTANCE_DECAY, start=1):
        counts = ~F.coalesce(F.col(f"known{d}"), F.lit(False))
        boost = F.when(counts, F.col(f"booster{d}"))
        found = found.withColumn(
            "v", F.when(boost.isNotNull(), v + F.signum(v) * boost * decay).otherwise(v)
        )
        negator = F.when(counts, F.col(f"negator{d}"))
        found = found.withColumn("v", F.when(negator.isNotNull(), v * negator).otherwise(v))
    return found.withColumn(
        "v",
        F.when(F.col("at") < F.col("but_at"), v * fixed.BUT_BEFORE)
        .when(F.col("at") > F.col("but_at"), v * fixed.BUT_AFTER)
        .otherwise(v)
        .cast(EXACT),
    )


def _token_polarity(found: DataFrame) -> DataFrame:
    """Polarity scaled by the word before; a negator may also stand before the
    intensifier, whose weight is then inverted."""
    scaled = _scaled_polarity(
        F.col("polarity"), F.col("intensity1"), F.col("negator1").isNotNull(), F.col("negator2").isNotNull()
    )
    return found.withColumn("pol", clamp(scaled, -1.0, 1.0).cast(EXACT))


def _scaled_polarity(polarity: Column, intensity: Column, near: Column, far: Column) -> Column:
    negation = fixed.POLARITY_NEGATION
    return (
        F.when(far & intensity.isNotNull(), polarity * negation / intensity)
        .when(near, polarity * negation)
        .when(intensity.isNotNull(), polarity * intensity)
        .otherwise(polarity)
    )


def _amplitude() -> Column:
    bangs, queries = F.col("bangs"), F.col("queries")
    loud = F.least(bangs, F.lit(fixed.BANG_CAP)) * fixed.BANG_STEP
    asking = (
        F.when(queries <= 1, F.lit(0.0))
        .when(queries <= fixed.QUERY_CAP, queries * fixed.QUERY_STEP)
        .otherwise(F.lit(fixed.QUERY_MAX))
    )
    return loud + asking


def carried_words(words: DataFrame) -> Column | None:
    """The lexicon as a constant: buckets of maps from word to facts, NULL facts left out.

    None where it is larger than CARRIED_WORDS or CARRIED_CHARS; no more than that is fetched.
    """
    rows = words.limit(CARRIED_WORDS + 1).select("word", F.xxhash64("word").alias("hash"), *FACTS).collect()
    rows = [row for row in rows if row["word"] is not None]
    if len(rows) > CARRIED_WORDS or sum(len(row["word"]) for row in rows) > CARRIED_CHARS:
        return None
    buckets: list[dict] = [{} for _ in range(1 << len(rows).bit_length())]
    for row in rows:
        facts = {name: row[name] for name in FACTS if row[name] is not None}
        buckets[row["hash"] % len(buckets)][row["word"]] = facts
    fields = ",".join(f"{name}:double" for name in FACTS)
    return F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,struct<{fields}>>>")


def _facts(lexicon: Column, word: Column) -> Column:
    bucket = F.pmod(F.xxhash64(word), F.size(lexicon)).cast("int")
    return F.try_element_at(F.get(lexicon, bucket), word)


def _hit_valence(hit: Column, mixed_case: Column, but_at: Column) -> Column:
    """Valence of one sentiment word, by its facts and those of the tokens before it."""
    steps = [
        lambda v: F.when(mixed_case & _is_caps(hit["token"]), v + F.signum(v) * fixed.CAPS_BOOST).otherwise(v)
    ]
    for d, decay in enumerate(fixed.DISTANCE_DECAY, start=1):
        before = hit[f"before{d}"]
        counts = before["valence"].isNull()
        steps += [
            lambda v, b=before, c=counts, x=decay: F.when(c & b["booster"].isNotNull(), v + F.signum(v) * b["booster"] * x).otherwise(v),
            lambda v, b=before, c=counts: F.when(c & b["negator"].isNotNull(), v * b["negator"]).otherwise(v),
        ]
    steps.append(
        lambda v: F.when(hit["at"] < but_at, v * fixed.BUT_BEFORE).when(hit["at"] > but_at, v * fixed.BUT_AFTER)
        .otherwise(v).cast(EXACT)
    )

    def run(value: Column, i: int) -> Column:
        return value if i == len(steps) else bind(steps[i](value), lambda v: run(v, i + 1))

    return run(hit["facts"]["valence"], 0)


def _hit_polarity(hit: Column) -> Column:
    one, two = hit["before1"], hit["before2"]
    scaled = _scaled_polarity(
        hit["facts"]["polarity"], one["intensity"], one["negator"].isNotNull(), two["negator"].isNotNull()
    )
    return clamp(scaled, -1.0, 1.0).cast(EXACT)


def _exact_total(values: Column) -> Column:
    start = F.lit(0).cast(EXACT_SUM)
    return F.aggregate(values, start, lambda total, v: (total + v).cast(EXACT_SUM)).cast("double")


def scores_in_row(reviews: DataFrame, lexicon: Column, text: Column) -> DataFrame:
    """``reviews`` with ``_scores`` (as ``raw_scores`` gives them) of ``text``; a narrow pass."""
    body = F.coalesce(text, F.lit(""))
    read = computed(reviews, {"_s1": F.struct(
        is_blank(body).alias("blank"), _count_of(body, "!").alias("bangs"), _count_of(body, "?").alias("queries"),
        sentiment_tokens(body).alias("tokens"),
    )})
    tokens = F.col("_s1.tokens")
    low = F.transform(tokens, lambda t: F.lower(t))
    read = computed(read, {"_s2": bind(low, lambda low: F.struct(
        F.transform(low, lambda word: _facts(lexicon, word)).alias("facts"), low.alias("low"),
    ))})
    facts = F.col("_s2.facts")
    scored = F.array_compact(F.transform(
        facts, lambda f, i: F.when(f["valence"].isNotNull() | f["polarity"].isNotNull(), i)
    ))

    def found(places: Column) -> Column:
        hits = F.transform(places, lambda i: F.struct(
            (i + 1).alias("at"), F.get(tokens, i).alias("token"), F.get(facts, i).alias("facts"),
            *[F.get(facts, i - d).alias(f"before{d}") for d in range(1, REACH + 1)],
        ))
        # Letter case matters only where there is something to score.
        mixed = (F.size(places) > 0) & F.exists(tokens, lambda t: ~_is_caps(t)) & F.exists(tokens, _is_caps)
        but_at = F.nullif(F.array_position("_s2.low", "but"), F.lit(0))
        return F.struct(hits.alias("hits"), mixed.alias("mixed"), but_at.alias("but_at"))

    read = computed(read, {"_s3": bind(scored, found)})
    hits, mixed, but_at = (F.col(f"_s3.{c}") for c in ("hits", "mixed", "but_at"))
    read = computed(read, {"_s4": F.struct(
        F.array_compact(F.transform(hits, lambda h: _hit_valence(h, mixed, but_at))).alias("v"),
        F.array_compact(F.transform(hits, _hit_polarity)).alias("pol"),
    )})
    v, pol = F.col("_s4.v"), F.col("_s4.pol")
    up, down = F.filter(v, lambda x: x > 0), F.filter(v, lambda x: x < 0)
    read = computed(read, {"_s5": F.struct(
        "_s1.blank", "_s1.bangs", "_s1.queries", F.size(tokens).alias("n_tokens"), _exact_total(v).alias("total"),
        _exact_total(F.transform(up, lambda x: x + 1)).alias("up"), _exact_total(F.transform(down, lambda x: x - 1)).alias("down"),
        F.size(F.filter(v, lambda x: x != 0)).alias("charged"), _exact_total(pol).alias("pol_total"), F.size(pol).alias("pol_words"),
    )})
    plain = [c for c in reviews.columns]
    # The last steps work on columns, so the row's own travel in a struct past equal names.
    whole = read.select(F.struct(*plain).alias("_row"), "_s5.*")
    return _finished(whole, "_row").select(
        "_row.*", F.struct("blank", "compound", "positive", "negative", "neutral", "polarity").alias("_scores")
    )


def raw_scores(
    reviews: DataFrame,
    words: DataFrame,
    key: str = "review_id",
    text: str = "body",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """compound, positive, negative, neutral and polarity per review.

    ``key`` must identify the row. ``keep`` lists further (small) columns to carry along.
    """
    lexicon = carried_words(words)
    if lexicon is not None:
        named = list(dict.fromkeys([key, *keep]))
        rows = scores_in_row(reviews.select(*dict.fromkeys([*named, text])), lexicon, F.col(text))
        return rows.select(*named, "_scores.*")
    return joined_scores(reviews, words, key, text, keep)


def joined_scores(
    reviews: DataFrame, words: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The scores by joins of tokens with a lexicon of any size."""
    found = _with_facts(token_rows(reviews, key, text, keep), words)
    found = _token_polarity(_token_valence(found))
    v = F.col("v")
    zero = F.lit(0).cast(EXACT)

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), zero).cast("double")

    folded = found.groupBy(key, *keep).agg(
        *[F.max(c).alias(c) for c in ("blank", "bangs", "queries", "n_tokens")],
        total(v).alias("total"),
        total(F.when(v > 0, v + 1)).alias("up"),
        total(F.when(v < 0, v - 1)).alias("down"),
        F.count(F.when(v != 0, v)).alias("charged"),
        total(F.col("pol")).alias("pol_total"),
        F.count("pol").alias("pol_words"),
    )
    return _finished(folded, key, *keep)


def _finished(folded: DataFrame, *named: str) -> DataFrame:
    """Scores from a review's counts and sums."""
    amp, total_, up, down = F.col("amp"), F.col("total"), F.col("up"), F.col("down")
    folded = (
        folded.withColumn("amp", _amplitude())
        .withColumn("total", total_ + F.signum(total_) * amp)
        .withColumns(
            {
                "loud_up": F.when(up > -down, up + amp).otherwise(up),
                "loud_down": F.when(up < -down, down - amp).otherwise(down),
                "flat": F.col("n_tokens") - F.col("charged"),
            }
        )
        .withColumn("mass", F.col("loud_up") - F.col("loud_down") + F.col("flat"))
    )

    def share(value: Column) -> Column:
        return F.when(F.col("mass") > 0, round_n(value / F.col("mass"), 3)).otherwise(
            F.lit(0.0)
        )

    return folded.select(
        *named,
        "blank",
        round_n(
            total_ / F.sqrt(total_ * total_ + F.lit(fixed.NORMALISER)), 4
        ).alias("compound"),
        share(F.col("loud_up")).alias("positive"),
        share(F.abs("loud_down")).alias("negative"),
        share(F.col("flat")).alias("neutral"),
        F.when(F.col("pol_words") > 0, F.col("pol_total") / F.col("pol_words"))
        .otherwise(F.lit(0.0))
        .alias("polarity"),
    )


def fused_scores(scores: DataFrame) -> DataFrame:
    """Add combined score, label and confidence to raw scores."""
    compound, polarity = F.col("compound"), F.col("polarity")
    combined = combined_score(compound, polarity)
    return scores.withColumns(
        {
            "combined": combined,
            "sentiment": sentiment_label(combined),
            "confidence": confidence(compound, polarity),
        }
    )


def sentiment_table(
    reviews: DataFrame,
    words: DataFrame,
    key: str = "review_id",
    text: str = "body",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """key, kept columns and the stored struct: a side table that carries no text."""
    scores = raw_scores(reviews, words, key, text, keep)
    struct = sentiment_struct(
        *[
            F.col(c)
            for c in ("blank", "compound", "positive", "negative", "neutral", "polarity")
        ]
    )
    return scores.select(key, *keep, struct.alias("sentiment_analysis"))


def flatten_sentiment(df: DataFrame) -> DataFrame:
    s = "sentiment_analysis"
    return df.select(
        *[c for c in df.columns if c != s],
        F.col(f"{s}.sentiment").alias("sentiment"),
        F.col(f"{s}.confidence_score").alias("confidence_score"),
        F.col(f"{s}.combined_score").alias("combined_score"),
        *[
            F.col(f"{s}.vader_scores.{part}").alias(part)
            for part in ("compound", "positive", "negative", "neutral")
        ],
        F.col(f"{s}.textblob_polarity").alias("textblob_polarity"),
        F.col(f"{s}.method").alias("method"),
    )


def sentiment_backlog_rows(
    reviews: DataFrame, limit: int | None = None, force: bool = False
) -> DataFrame:
    """Rows to score: those not scored yet (or all), with a review_id."""
    named = reviews.filter(F.col("review_id").isNotNull() & (F.col("review_id") != ""))
    if not force and "sentiment_analysis" in reviews.columns:
        return limited_backlog(named, "sentiment_analysis", limit)
    return named if limit is None else lowest_rows(named, limit, "review_id")


def with_sentiment(reviews: DataFrame, lexicon: Column, text: str = "body") -> DataFrame:
    """``reviews`` with the stored struct; a narrow pass."""
    struct = sentiment_struct(*[F.col(f"_scores.{c}") for c in RAW])
    scored = scores_in_row(reviews, lexicon, F.col(text))
    return scored.withColumn("sentiment_analysis", struct).drop("_scores")


def sentiment_sample(reviews: DataFrame, words: DataFrame, limit: int = 5, shown: int = 100) -> DataFrame:
    """The first ``limit`` rows without sentiment by review_id and ``seq``, previewed and scored."""
    todo = limited_backlog(reviews, "sentiment_analysis", limit, ["review_id", "seq"])
    sample = todo.select("seq", "review_id", "body", preview(F.col("body"), shown).alias("preview"))
    return sentiment_table(sample, words, "seq", keep=("review_id", "preview"))


RAW = ("blank", "compound", "positive", "negative", "neutral", "polarity")


def sentiment_incremental(
    reviews: DataFrame,
    words: DataFrame,
    limit: int | None = None,
    force: bool = False,
    key: str = "review_id",
    run_ts: Column | None = None,
) -> DataFrame:
    """Sentiment rows for the backlog, ready for ``keyed_update``.

    Of several rows with one review_id the first by ``seq`` speaks for it (by the hash of the
    body where there is no ``seq``). It is chosen among the scores, so only numbers are shuffled.
    """
    stamp = F.current_timestamp() if run_ts is None else run_ts
    todo = sentiment_backlog_rows(reviews, limit, force)
    if key != "review_id":
        return sentiment_table(todo, words, key).withColumn("sentiment_updated_at", stamp)
    place = F.col("seq") if "seq" in todo.columns else F.xxhash64("body")
    rows = todo.select("review_id", "body", place.alias("_place"))
    lexicon = carried_words(words)
    if lexicon is None:
        rows = first_per_key(rows, key, "_place")
        return sentiment_table(rows, words, key).withColumn("sentiment_updated_at", stamp)
    scored = scores_in_row(rows, lexicon, F.col("body")).select("review_id", "_place", "_scores.*")
    # Numbers and a flag, each the one of the first row: an aggregate that hashes, without sorting.
    firsts = scored.groupBy("review_id").agg(*[F.min_by(c, "_place").alias(c) for c in RAW])
    struct = sentiment_struct(*[F.col(c) for c in RAW])
    return firsts.select(key, struct.alias("sentiment_analysis"), stamp.alias("sentiment_updated_at"))


def score_in_place(
    reviews: DataFrame,
    lexicon: Column,
    force: bool = False,
    key: str = "review_id",
    run_ts: Column | None = None,
) -> DataFrame:
    """The review table with new sentiment, scored where the rows lie.

    The same rows as ``sentiment_incremental`` and ``keyed_update``. A review whose id no other row
    has takes its own score. Rows that share an id get the score of the first of them that was
    to be scored, from a table of those ids alone; reviews are joined with that, and moved
    only where it is too large to be broadcast.
    """
    stamp = F.current_timestamp() if run_ts is None else run_ts
    old = "sentiment_analysis" in reviews.columns
    named = F.coalesce(F.col("review_id"), F.lit("")) != ""
    todo = named if force or not old else named & F.col("sentiment_analysis").isNull()
    struct = sentiment_struct(*[F.col(f"_scores.{c}") for c in RAW])
    rows = scores_in_row(reviews, lexicon, F.when(todo, F.col("body"))).withColumns({"_todo": todo, "_new": struct})
    if key == "review_id":
        ids = reviews.groupBy("review_id").agg(
            F.count(F.lit(1)).alias("_rows"), F.min(F.when(todo, F.col("seq"))).alias("seq")
        ).where("_rows > 1 and seq is not null").drop("_rows")
        first = lookup_join(reviews.select("review_id", "seq", "body"), measured(ids, "repeated"), ["review_id", "seq"], "left_semi")
        scored = scores_in_row(first, lexicon, F.col("body")).select("review_id", struct.alias("_shared"))
        shared = measured(scored, "shared")
        rows = lookup_join(rows, shared, "review_id")
        rows = rows.withColumns({
            "_new": F.coalesce("_shared", "_new"), "_todo": F.col("_todo") | F.col("_shared").isNotNull()
        })
    values = {
        "sentiment_analysis": F.when(F.col("_todo"), F.col("_new")),
        "sentiment_updated_at": F.when(F.col("_todo"), stamp),
    }
    for name, value in values.items():
        values[name] = value.otherwise(F.col(name)) if name in reviews.columns else value
    return rows.withColumns(values).select(*reviews.columns, *[c for c in values if c not in reviews.columns])


def score_and_update(reviews: DataFrame, words: DataFrame, **options) -> DataFrame:
    """The review table with new sentiment set on the rows that lacked it."""
    return keyed_update(reviews, sentiment_incremental(reviews, words, **options))
