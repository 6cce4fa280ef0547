"""Secrets in texts, with built-in functions only and no shuffle.

Two layers. Three fixed patterns give the base spans. Beside them, long strings of secret-like
characters are candidates: for each character class the Shannon entropy of a sliding window is
kept by incremental counts (the entering character's count goes up, the leaving one's down, and
the sum of c*log2(c) follows), and windows above the class's threshold that touch or overlap are
one span. The work is linear in a candidate, whatever its length. The allow list judges what a
span holds, piece by piece between separators, so that a harmless path does not hide a secret in
it; of a span that touches base spans the parts outside them stay.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import bind

# The base patterns. A match of ``assign`` counts if its value is long enough.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"


class CharClass(NamedTuple):
    """Characters of a class and the entropy in bits from which a window is a secret."""

    kind: str
    alphabet: str
    threshold: float


WINDOW = 20
CLASSES = (
    CharClass("entropy_hex", "0123456789abcdefABCDEF", 3.0),
    CharClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8,
    ),
)
#: A candidate that is one of these as a whole is no secret.
ALLOW_WHOLE = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9_/+-]*",  # numbers, dates, ranges
)
#: A span of which every piece is one of these is no secret.
ALLOW = (
    r"[a-z]{0,40}(?:[A-Z][a-z]{1,40}){0,20}[0-9]{0,4}",  # words and names in mixed case, perhaps numbered
    r"[A-Z]*[0-9]{0,4}", r"[0-9]*",
    r".*(?i:example|placeholder|changeme|xxxxx).*",
    r".*(?i:0123456789|1234567890|abcdefghij).*",  # alphabets
)
SEPARATORS = "[/_+-]+"

_SPAN = "array<struct<start:bigint,end:bigint,rank:int,kind:string>>"


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _matches(text: Column, pattern: str, keep) -> Column:
    """Places (start, end, found) of the matches that ``keep`` accepts, in order."""
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,end:bigint,found:string>>"
    begin = F.struct(_long(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["found"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        spans = F.when(keep(pair["found"]), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(found)), found,
        lambda g, m: F.struct(g.alias("gap"), m.alias("found")),
    )
    spans = F.aggregate(pairs, begin, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def _typed(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")
        ),
    )


def _counted(counts: Column, place: Column, by: int) -> Column:
    """The counts with one of them changed; a place of 0 changes none."""
    rest = F.slice(counts, place + 1, F.size(counts) - place)
    changed = F.concat(F.slice(counts, F.lit(1), place - 1), F.array(F.element_at(counts, place) + by), rest)
    return F.when(place > 0, changed).otherwise(counts)


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _windows(candidate: Column, chars: CharClass, width: int) -> Column:
    """Spans (start, end) in ``candidate`` whose windows reach the class's entropy."""
    pairs = "array<struct<start:bigint,end:bigint>>"
    zero = F.array_repeat(F.lit(0), len(chars.alphabet))
    begin = F.struct(
        zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("run"),
        _long(-1).alias("start"), _long(-1).alias("end"), F.array().cast(pairs).alias("spans"),
    )
    codes = F.transform(F.split(candidate, "", -1), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(chars.alphabet), c)))

    def closed(state: Column) -> Column:
        span = F.struct(state["start"].alias("start"), state["end"].alias("end"))
        return F.when(state["start"] >= 0, F.array_append(state["spans"], span)).otherwise(state["spans"])

    def entered(state: Column, code: Column) -> Column:
        """The counts and their sum with the entering character, before one leaves."""
        count = F.element_at(state["counts"], code["entering"])
        return F.struct(
            _counted(state["counts"], code["entering"], 1).alias("counts"),
            (state["total"] - _weight(count) + _weight(count + 1)).alias("total"),
        )

    def left(now: Column, leaving: Column) -> Column:
        count = F.element_at(now["counts"], F.greatest(leaving, F.lit(1)))
        return F.when(leaving > 0, F.struct(
            _counted(now["counts"], leaving, -1).alias("counts"),
            (now["total"] - _weight(count) + _weight(count - 1)).alias("total"),
        )).otherwise(now)

    def judged(state: Column, now: Column, code: Column) -> Column:
        run = state["run"] + 1
        high = (run >= width) & (math.log2(width) - now["total"] / width >= chars.threshold - 1e-9)
        low, end = code["at"] + 1 - width, code["at"] + 1
        joins = (state["start"] >= 0) & (low <= state["end"])
        return bind(F.struct(high.alias("high"), (high & joins).alias("joins")), lambda j: F.struct(
            now["counts"].alias("counts"), now["total"].alias("total"), F.least(run, F.lit(width)).alias("run"),
            F.when(j["joins"] | ~j["high"], state["start"]).otherwise(low).alias("start"),
            F.when(j["high"], end).otherwise(state["end"]).alias("end"),
            F.when(j["high"] & ~j["joins"], closed(state)).otherwise(state["spans"]).alias("spans"),
        ))

    def step(state: Column, code: Column) -> Column:
        outside = F.struct(
            zero.alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("run"),
            state["start"].alias("start"), state["end"].alias("end"), state["spans"].alias("spans"),
        )
        leaving = F.when(state["run"] >= width, code["leaving"]).otherwise(F.lit(0))
        inside = bind(entered(state, code), lambda one: bind(left(one, leaving), lambda now: judged(state, now, code)))
        return F.when(code["entering"] > 0, inside).otherwise(outside)

    steps = bind(codes, lambda known: F.transform(known, lambda c, i: F.struct(
        c.alias("entering"), F.coalesce(F.get(known, i - width), F.lit(0)).alias("leaving"), i.cast("bigint").alias("at"),
    )))
    return F.aggregate(steps, begin, step, closed)


def _outside(span: Column, base: Column) -> Column:
    """The parts (start, end) of a span that lie outside the base spans, which are in order."""
    kind = "array<struct<start:bigint,end:bigint>>"
    begin = F.struct(span["start"].alias("at"), F.array().cast(kind).alias("parts"))

    def part(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"))

    def step(state: Column, b: Column) -> Column:
        free = F.least(b["start"], span["end"])
        parts = F.when(free > state["at"], F.array_append(state["parts"], part(state["at"], free))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], b["end"]).alias("at"), parts.alias("parts"))

    touching = F.filter(base, lambda b: (span["start"] < b["end"]) & (b["start"] < span["end"]))
    return F.aggregate(touching, begin, step, lambda s: F.when(
        s["at"] < span["end"], F.array_append(s["parts"], part(s["at"], span["end"]))
    ).otherwise(s["parts"]))


def find_secrets(
    docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, width: int = WINDOW,
    allow: tuple[str, ...] = ALLOW, allow_whole: tuple[str, ...] = ALLOW_WHOLE,
) -> DataFrame:
    """Secrets in every row of ``docs`` (columns ``doc_id``, ``text``): one row per row.

    ``doc_id``, ``base`` and ``added``: arrays of (start, end, rank, kind) by start, then rank;
    code points from 0, end exclusive. Null and empty texts have none; a candidate shorter than
    the window has no window; equal rows give equal rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    value = F.regexp_extract
    base = F.concat(
        _typed(
            _matches(F.col("text"), ASSIGN, lambda m: F.length(value(m, ASSIGN, 1)) >= ASSIGN_VALUE),
            "assign", 0,
        ),
        _typed(_matches(F.col("text"), ACCESS, lambda m: F.lit(True)), "access", 1),
        _typed(_matches(F.col("text"), HEX, lambda m: F.lit(True)), "hex", 2),
    )
    letters = "".join(dict.fromkeys("".join(c.alphabet for c in classes)))
    one = "[" + "".join("\\" + c if c in "]\\^-[" else c for c in letters) + "]"
    candidate = f"(?<!{one}){one}{{{width},}}"
    whole = "^(?:" + "|".join(allow_whole or (r"(?!)",)) + ")$"
    piece = "^(?:" + "|".join(allow or (r"(?!)",)) + ")$"
    found = _matches(F.col("text"), candidate, lambda m: ~m.rlike(whole))

    def secret(candidate: Column, span: Column) -> Column:
        inside = F.substring(candidate, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.exists(F.split(inside, SEPARATORS, -1), lambda p: ~p.rlike(piece))

    def spans_of(hit: Column) -> Column:
        def moved(chars: CharClass, rank: int) -> Column:
            kept = F.filter(_windows(hit["found"], chars, width), lambda s: secret(hit["found"], s))
            placed = F.transform(kept, lambda s: F.struct(
                (hit["start"] + s["start"]).alias("start"), (hit["start"] + s["end"]).alias("end")
            ))
            free = F.flatten(F.transform(placed, lambda s: _outside(s, F.col("base"))))
            return _typed(free, chars.kind, rank)

        parts = [moved(chars, 3 + n) for n, chars in enumerate(classes)]
        return F.concat(*parts) if parts else F.array().cast(_SPAN)

    added = F.flatten(F.transform(F.col("found"), spans_of))
    return (
        rows.select("doc_id", F.sort_array(base).alias("base"), found.alias("found"))
        .select("doc_id", "base", F.sort_array(added).alias("added"))
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span found, overlapping ones as one, replaced by ``mark``.

    Texts without a span, null and empty ones among them, and all other columns stay as they are;
    so do repeated rows. An empty table gives no rows.
    """
    begin = F.struct(_long(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row")["text"]

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    found = find_secrets(docs.select(F.struct("*").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), F.sort_array(F.concat("base", "added")).alias("spans")
    )
    rest = F.aggregate(
        "spans", begin, step,
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return found.select(
        *[
            F.when(F.size("spans") > 0, rest).otherwise(text).alias(c) if c == "text" else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )
