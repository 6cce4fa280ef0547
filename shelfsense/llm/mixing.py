"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed over the cells source x language x topic. The classes of each dimension are
those the targets name and one for all others, so the cells are bounded by the targets, however
many sources the data has. Raking scales the cells until the token shares of every dimension
meet its targets; factors held within what sampling can give become the probabilities with which
documents are kept.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

OTHER = "*"
DIMENSIONS = ("source", "lang", "topic")


class Mix(NamedTuple):
    """Token shares wanted by class. Classes not named keep their share of the data together."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, legal notices, noise, or prose."""
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    bars = F.length(body) - F.length(F.replace(body, F.lit("|")))
    marks = F.length(body) - F.length(F.translate(body, "#$%&*!", ""))
    return (
        F.when(bars * 4 > words, "table")
        .when(marks > words, "noise")
        .when(F.lower(body).rlike("licen[cs]e|copyright|all rights reserved"), "legal")
        .otherwise("prose")
    )


def rake(
    tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-12, limit: float | None = None
) -> np.ndarray:
    """Factors by which the cells of ``tokens`` meet the shares ``targets`` of each axis.

    Classes without tokens give their target to the others of their axis. Where zeros make the
    targets unreachable, the last round stands. With ``limit`` every round starts by lowering the
    factors above it.
    """
    shares = tokens / tokens.sum()
    fitted = shares.copy()
    wanted = []
    for axis, target in enumerate(targets):
        there = tokens.sum(axis=tuple(a for a in range(tokens.ndim) if a != axis)) > 0
        share = np.where(there, target, 0.0)
        wanted.append(share / share.sum() if share.sum() > 0 else np.where(there, 1 / there.sum(), 0.0))
    for _ in range(rounds):
        worst = 0.0
        if limit is not None:
            worst = max(worst, float((fitted - limit * shares).max()))
            fitted = np.minimum(fitted, limit * shares)
        for axis, share in enumerate(wanted):
            others = tuple(a for a in range(tokens.ndim) if a != axis)
            now = fitted.sum(axis=others)
            worst = max(worst, float(np.abs(now - share).max()))
            ratio = np.divide(share, now, out=np.zeros_like(share), where=now > 0)
            fitted = fitted * np.expand_dims(ratio, others)
        if worst < tolerance:
            break
    return np.divide(fitted, shares, out=np.zeros_like(fitted), where=tokens > 0)


def probabilities(tokens: np.ndarray, targets: list[np.ndarray], keep: float | None) -> np.ndarray:
    """Keep probability of each cell, with the targets met in expectation.

    Factors times the kept share of all tokens are the probabilities, so no factor may pass its
    reciprocal. The largest share for which such factors are found is taken, ``keep`` at most.
    """
    factors = rake(tokens, targets)
    if not (factors > 0).any():
        return np.zeros_like(factors)
    most = 1.0 if keep is None else keep
    share = min(most, 1 / factors.max())
    chance, low, high = share * factors, share, most
    for _ in range(10):
        if high - low < 0.005 * high:
            break
        middle = (low + high) / 2
        held = rake(tokens, targets, rounds=200, limit=1 / middle)
        if not (tokens * held).sum():
            high = middle
            continue
        held = held * rake(tokens * held, targets)  # the targets come first
        found = min(middle, 1 / held.max())
        if found > share:
            share, chance = found, found * held
        low, high = (middle, high) if found > 0.995 * middle else (low, middle)
    return np.minimum(1, chance)


def _cell_probabilities(counted: list, mix: Mix, keep: float | None) -> list[tuple]:
    """(source, lang, topic, weight, probability) of every cell that has documents."""
    classes = [[*sorted(getattr(mix, d)), OTHER] for d in DIMENSIONS]
    tokens = np.zeros([len(c) for c in classes])
    for row in counted:
        tokens[tuple(c.index(row[d]) for c, d in zip(classes, DIMENSIONS))] += row["tokens"]
    if not tokens.sum():
        return [(*(row[d] for d in DIMENSIONS), 1.0, 1.0) for row in counted]
    targets = []
    for axis, (names, dimension) in enumerate(zip(classes, DIMENSIONS)):
        now = tokens.sum(axis=tuple(a for a in range(3) if a != axis)) / tokens.sum()
        named = np.array([getattr(mix, dimension)[c] for c in names[:-1]])
        there = np.where(now[:-1] > 0, named, 0)
        scale = (1 - now[-1]) / there.sum() if there.sum() > 0 else 0
        targets.append(np.append(there * scale, now[-1]))
    factors = rake(tokens, targets)
    chance = probabilities(tokens, targets, keep)
    out = []
    for row in counted:
        place = tuple(c.index(row[d]) for c, d in zip(classes, DIMENSIONS))
        empty = tokens[place] == 0  # only documents without tokens: they weigh nothing
        out.append((
            *(row[d] for d in DIMENSIONS),
            1.0 if empty else float(factors[place]), 1.0 if empty else float(chance[place]),
        ))
    return out


def mixture(docs: DataFrame, mix: Mix, keep: float | None = None, seed: int = 1, keyed_by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Weight and sampling decision of every row of ``docs``: one output row per row.

    The columns ``keyed_by``, the classes ``source``, ``lang``, ``topic``, ``n_tokens``,
    ``weight`` (raking factor), ``probability`` and ``sampled``. The topic is the column of that
    name, or ``topic_of`` the text. Null classes and classes without a target are ``*``. A row is
    sampled if the hash of its id, or of its text where that is null, falls below the
    probability: equal rows share the decision and a repeated run repeats it. Rows without tokens
    weigh nothing; if no row has any, all stay. An empty table gives no rows. As many tokens stay
    as the targets allow, the share ``keep`` at most.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col("text"))
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    named = {
        d: F.when(value[d].isin(list(getattr(mix, d))), value[d]).otherwise(F.lit(OTHER)) for d in DIMENSIONS
    }
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), text))
    sized = stored(
        docs.select(
            F.struct(*keyed_by).alias("key"), *[named[d].alias(d) for d in DIMENSIONS],
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_tokens"),
            (F.shiftrightunsigned(place, 11) / float(1 << 53)).alias("place"),
        ),
        "mixture",
    )
    counted = sized.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).collect()
    schema = "source string, lang string, topic string, weight double, probability double"
    cells = docs.sparkSession.createDataFrame(_cell_probabilities(counted, mix, keep), schema)
    return sized.join(F.broadcast(cells), list(DIMENSIONS)).select(
        *[F.col("key")[k].alias(k) for k in keyed_by], *DIMENSIONS, "n_tokens", "weight", "probability",
        (F.col("place") < F.col("probability")).alias("sampled"),
    )
