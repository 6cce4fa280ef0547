"""Benchmark decontamination on word windows, with built-in functions only.

The distinct windows of all benchmark items form a hash set that is broadcast when its counted
size is within ``BROADCAST_WINDOWS``; beyond it, hashes meet in a shuffled join. Every document is
cut into words once, each word position gives the hash of the window that starts there, and the
hash set is probed in the same stage: only hits leave it. A hit counts after its words have been
compared with those of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that are sent to all executors (about 150 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 400_000
WINDOW = 10
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(word: Column) -> Column:
    plain = F.lower(word)
    return F.when(plain == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    parts = F.split(F.coalesce(text, F.lit("")), _GAP + "+")
    return F.transform(F.filter(parts, lambda w: w != ""), _ascii_lower)


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``window``, ``wide``, ``window_hash``, ``items``.

    An item of fewer than ``width`` words is one window; one without words has none. An item
    without id goes by the empty id.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        words_of(F.col("text")).alias("words"),
    ).where(F.size("words") > 0)
    wide = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - wide + 1)
    return (
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, wide))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .select(
            "window", F.size("window").alias("wide"), F.xxhash64("window").alias("window_hash"), "items"
        )
    )


def _window_hits(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Verified occurrences: ``doc_id``, ``text_hash``, ``start`` (from 1), ``wide``, ``items``."""
    windows = benchmark_windows(benchmark, width)
    sizes = {row["wide"]: row["n"] for row in windows.groupBy("wide").agg(F.count("*").alias("n")).collect()}
    small = sum(sizes.values()) <= BROADCAST_WINDOWS
    words = docs.where(F.col("text") != "").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )

    def probes(wide: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - wide + 1)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, wide)))
        return F.when(F.size("words") >= wide, hashes).otherwise(F.array().cast("array<bigint>"))

    hits = None
    for wide in sorted(sizes) or [width]:
        of_width = windows.where(F.col("wide") == wide)
        grams = words.withColumn("probes", probes(wide)).select(
            "doc_id", "text_hash", "words", F.posexplode_outer("probes").alias("before", "probe")
        )
        start = F.col("before") + 1
        if small:
            # An equality of arrays would become a join key, made for every probe.
            here, there = F.slice("words", start, wide), F.col("window")
            same = (F.col("probe") == F.col("window_hash")) & (here >= there) & (here <= there)
            found = grams.join(F.broadcast(of_width), same)
        else:
            likely = grams.drop("words").join(of_width, F.col("probe") == F.col("window_hash"))
            own = words.select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "words")
            found = likely.join(
                own.dropDuplicates(["own_id", "own_hash"]),
                F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")),
            ).where(F.slice("words", start, wide) == F.col("window"))
        found = found.select("doc_id", "text_hash", start.alias("start"), "wide", "items")
        hits = found if hits is None else hits.unionByName(found)
    return hits


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Benchmark words in every row of ``docs`` (columns ``doc_id``, ``text``): one row per row.

    ``doc_id``, ``text_hash``, ``n_words``, ``n_hit`` (words inside any window), ``spans``
    (sorted structs ``start``, ``wide`` of the windows found; words counted from 1), ``items``
    (ids as text, sorted) and ``contaminated``. Null and empty texts have no words. Rows that
    repeat an id with another text are told apart by the text's hash. An empty benchmark hits
    nothing; other columns are ignored.
    """
    per_doc = (
        _window_hits(docs, benchmark, width)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", "wide"))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "spans", "items")
    )
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"),
    )
    same = rows.doc_id.eqNullSafe(per_doc.hit_id) & (rows.text_hash == per_doc.hit_hash)

    def covered(state: Column, span: Column) -> Column:
        end = span["start"] + span["wide"]
        fresh = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct(
            F.greatest(state["end"], end).cast("bigint").alias("end"),
            (state["n"] + fresh).cast("bigint").alias("n"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    n_hit = F.coalesce(F.aggregate("spans", start, covered, lambda s: s["n"]), F.lit(0).cast("bigint"))
    return (
        rows.join(per_doc, same, "left")
        .select(
            "doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,wide:int>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, remove: str = "documents"
) -> DataFrame:
    """``docs`` without benchmark text, with all their columns.

    ``remove="documents"`` leaves out every contaminated row; ``remove="spans"`` keeps the rows
    and takes the words of the windows, each with what separates it from the word before, out of
    the text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    hits = (
        _window_hits(docs, benchmark, width)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "wide")).alias("hit_spans"))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hit_spans")
    )
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_hash")
    )
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_hash") == F.col("hit_hash"))
    if remove == "documents":
        return rows.join(hits, same, "left_anti").select("row.*")
    pieces = F.regexp_extract_all("row.text", F.lit(_GAP + "*[^" + _GAP[1:] + "+"), F.lit(0))
    tail = F.regexp_extract("row.text", _GAP + r"*\z", 0)
    kept = F.filter(
        pieces,
        lambda p, i: ~F.exists(
            "hit_spans", lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["wide"])
        ),
    )
    text = F.when(F.col("hit_spans").isNull(), F.col("row.text")).otherwise(
        F.concat(F.concat_ws("", kept), tail)
    )
    return rows.join(hits, same, "left").select(
        *[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
