"""Jaccard join of word shingles with token-combination prefixes.

Shingles fall into two classes by a frequency sketch. They are ordered rare first, the rare ones by
the sketch's counts, then by hash, so that what many sets share comes late. A set of n shingles can miss at most ``n - ceil(t * n)`` of them in a set it links with,
so its prefix is the shortest one that cannot be destroyed by so many misses: a rare shingle is
an index entry by itself and costs one miss; frequent shingles are dealt into groups of about 16
per set, entries are pairs within a group, and a group of m costs m - 1 misses. Of two linked sets
the one whose prefix ends first keeps an entry, and the other one has it too (Xiao et al. 2008,
Wang et al. 2016), so no link is lost whatever the sketch says; it only decides what is cheap.

The smaller one of two linked sets misses still fewer of its shingles, so an entry counts only where
it is in such a shorter ("early") prefix of one of its sets. Entries of nearly the same sets are
merged, as a pair need not meet more than once.

Equal sets are one class from the start. Entries are then verified in rounds: every member is
compared with a few pivots of its entries, so a round makes no more pairs than a multiple of the
index rows. Members that are already in one component need not be compared. When a round settles
little or little is left, members outside an entry's largest component meet the others, so a large
group of near copies is never paired with itself: both sides lie in chunks of bounded size, whose
bitmaps are compared as arrays, and a pair is a row only where these do not refute it.

Pairs are first compared by parity bitmaps, which are as wide as their sets are large: a bit that
differs stands for a shingle that only one of the sets has. Only the pairs that these cannot
refute, which are little more than the links, have their sets sent to each other. Sets are made
from the texts where they are needed and never stored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, key_filter, may_contain, small_batches, stored
from .shingles import _Q, batch_words, byte_slices, mix, shingles, text_buffers

SKETCH_BITS = 20
#: A sketch cell is frequent from this many shingles above the mean cell, or three standard
#: deviations of a cell of chance hits where those are more.
FREQUENT = 24
GROUP = 16
BAND = 1.25
#: Pivot rounds go on while more pairs than this are left per index row and a round settles at
#: least a quarter of them. A pair is counted once per entry its sets share.
PAIRS_PER_ENTRY = 8
SETTLED = 0.25
#: Pivots of an entry in a round.
PIVOTS = 4
#: About so many members of an entry are compared with as many others at a time.
CHUNK = 256
#: Words of 64 bits of the smallest bitmap. A bitmap has at least as many bits as its set shingles.
BITMAP = 8
#: Index entries written together by a task.
BATCH = 50_000
#: Bytes of text whose shingles a task makes at once.
RUN = 1 << 19
#: Cells of a sketch that are added up together.
PART_BITS = 14


def _shingled(batches, size: int):
    """Ids, set sizes and shingles (set after set, each sorted) of runs of texts."""
    for batch in (part for whole in batches for part in byte_slices(whole, 1, RUN)):
        raw, offsets = text_buffers(batch.column(1))
        words, limits = batch_words(raw, offsets)
        sets = [shingles(words[a:b], size) for a, b in zip(limits[:-1], limits[1:])]
        counts = np.array([len(s) for s in sets], dtype=np.int64)
        yield batch.column(0), counts, np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _cut(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(counts)[:-1])


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``n`` and ``shingles`` of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        import pyarrow as pa

        for ids, counts, flat in _shingled(batches, size):
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(flat.view(np.int64))
            )
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), lists], ["doc_id", "n", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n bigint, shingles array<bigint>")


def described_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id``, ``n``, ``set_key`` (128 bits over the set) and ``bitmap`` of every row.

    Besides, rows without ``n`` hold the sketch of a task's shingles in parts: ``part``, ``cells``.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        import pyarrow as pa

        names = ["doc_id", "n", "set_key", "bitmap", "part", "cells"]
        sketch, ids = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), None
        for ids, counts, flat in _shingled(batches, size):
            sketch += np.bincount(flat >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch)).astype(np.uint32)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in _cut(flat, counts)]
            limits, maps = parity_bitmaps(counts, flat)
            maps = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32)), pa.array(maps))
            none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(keys, pa.binary()), maps, *none], names)
        if ids is not None:
            parts = [part.tobytes() for part in sketch.reshape(-1, 1 << PART_BITS)]
            none = [pa.nulls(len(parts), t) for t in (ids.type, pa.int64(), pa.binary(), pa.list_(pa.int64()))]
            places = pa.array(np.arange(len(parts), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*none, places, pa.array(parts, pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n bigint, set_key binary, bitmap array<bigint>, part int, cells binary"
    )


def parity_bitmaps(counts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the sets that lie one after the other in ``flat``: whether an odd number of a
    set's shingles falls on a bit. Widths are powers of two, so a wider bitmap folds by XOR."""
    words = BITMAP << np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / (64 * BITMAP))).astype(np.int64))
    limits = np.append(0, np.cumsum(words))
    place = (flat & np.repeat(64 * words - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(64 * limits[:-1], counts) + place, minlength=64 * limits[-1]) & 1
    return limits, np.packbits(odd.astype(bool)).view(np.int64)


def _lists(column):
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    base = offsets[0]
    return [flat[a - base : b - base] for a, b in zip(offsets[:-1], offsets[1:])]


def cell_levels(described: DataFrame) -> tuple[np.ndarray, int]:
    """The level of every sketch cell, and from which level its shingles are frequent.

    The sketch counts the shingles of all texts; the tasks' sketches are added part by part.
    """

    def work(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[part] = sums.get(part, 0) + np.frombuffer(cells.as_buffer(), dtype=np.uint32).astype(np.int64)
        for part, hits in sums.items():
            used = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array((part << PART_BITS) + used), pa.array(hits[used])], ["cell", "hits"])

    parts = described.where("cells is not null").select("part", "cells").repartition("part")
    counted = stored(parts.mapInArrow(work, "cell bigint, hits bigint"), "cells")
    mean = (counted.agg(F.sum("hits")).first()[0] or 0) / (1 << SKETCH_BITS)
    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    # At most one row per cell, whatever the corpus.
    rows = counted.select(F.col("cell").cast("int"), F.least(F.lit(1 << 16), "hits").cast("int").alias("hits")).toArrow()
    levels[rows["cell"].to_numpy()] = level(rows["hits"].to_numpy())
    del rows
    return levels, int(level(mean + max(FREQUENT, 3 * mean**0.5)))


def level(hits):
    """Hits of a cell on a scale of sixteen steps per doubling."""
    return np.minimum(255, np.round(16 * np.log2(1 + np.asarray(hits, dtype=float)))).astype(np.uint8)


def set_entries(tokens: np.ndarray, frequent: np.ndarray, percent: int, levels: np.ndarray | None = None, need: int | None = None) -> np.ndarray:
    """Index entries of one set: sorted distinct hashes, flags of the frequent ones, and levels by
    which the rare ones are ordered before their hashes. ``need``: the misses that the prefix is for
    and one more."""
    n = len(tokens)
    need = need or n + (-n * percent) // 100 + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        if levels is not None:
            rare = rare[np.argsort(levels[~frequent], kind="stable")]
        return mix(rare[:need])
    often, out = tokens[frequent], [mix(rare)]
    left = need - len(rare)
    band = int(np.floor(np.log(n) / np.log(BAND) + 1e-9))
    # Linked sets differ by a factor of 100 / percent at most, so they have a band in common.
    apart = int(np.ceil(np.log(100 / percent) / np.log(BAND) - 1e-9))
    for key in range(band, band + max(1, apart) + 1):
        groups = max(1, int(BAND**key) // GROUP)
        group = (mix(often) % np.uint64(groups)).astype(np.int64)
        worth = np.ones(len(often), dtype=np.int64)
        worth[np.unique(group, return_index=True)[1]] = 0
        cut = int(np.searchsorted(np.cumsum(worth), left)) + 1
        order = np.argsort(group[:cut], kind="stable")
        token, group = often[:cut][order], group[:cut][order]
        step = 1
        while step < len(token):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            out.append(mix(token[:-step][same] * _Q + token[step:][same] + np.uint64(key + 1)))
            step += 1
    return np.unique(np.concatenate(out))


def early_need(n: int, percent: int) -> int:
    """``need`` of the smaller one of two linked sets: with t, it has 2t / (1 + t) of its size in common."""
    return n + (-2 * n * percent) // (100 + percent) + 1


def entries(docs: DataFrame, levels: np.ndarray, often: int, percent: int, size: int = 5) -> DataFrame:
    """``entry``, ``rid``, ``n`` and ``early``: the index entries of every text's set."""
    kind = dict(docs.dtypes)["doc_id"]

    def packed(ids, made):
        import pyarrow as pa

        at, n, found, early = zip(*made)
        sizes = [len(f) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(found).view(np.int64)),
                ids.take(pa.array(np.repeat(at, sizes))),
                pa.array(np.repeat(n, sizes)),
                pa.array(np.concatenate(early)),
            ],
            ["entry", "rid", "n", "early"],
        )

    def work(batches):
        for ids, counts, flat in _shingled(batches, size):
            made, rows = [], 0
            for at, tokens in enumerate(_cut(flat, counts)):
                n = len(tokens)
                if not n:
                    continue
                own = levels[tokens >> np.uint64(64 - SKETCH_BITS)]
                found = set_entries(tokens, own >= often, percent, own)
                first = set_entries(tokens, own >= often, percent, own, early_need(n, percent))
                made.append((at, n, found, np.isin(found, first)))
                rows += len(found)
                if rows >= BATCH:
                    yield packed(ids, made)
                    made, rows = [], 0
            if made:
                yield packed(ids, made)

    return docs.select("doc_id", "text").mapInArrow(work, f"entry bigint, rid {kind}, n bigint, early boolean")


def shared_entries(made: DataFrame) -> DataFrame:
    """``entry``, ``rid`` and ``n`` of the entries that can show a link.

    Entries whose holders have the same smallest id by two hashes are merged: near copies share
    many entries with nearly the same holders, so most of these become one.
    """
    whole = Window.partitionBy("entry")
    least = [F.min(F.xxhash64(F.lit(k), "rid")).over(whole).alias(f"least{k}") for k in (0, 1)]
    held = made.select("rid", "n", *least, F.max("early").over(whole).alias("any"), F.count(F.lit(1)).over(whole).alias("holders"))
    merged = held.where("holders > 1 and any").select(F.xxhash64("least0", "least1").alias("entry"), "rid", "n")
    return merged.distinct()


def apart_at_least(left: np.ndarray, right: np.ndarray) -> int:
    """Shingles that at least one set has alone, by their bitmaps; the wider one is folded."""
    width = min(len(left), len(right))
    left, right = (np.bitwise_xor.reduce(m.view(np.uint64).reshape(-1, width), axis=0) for m in (left, right))
    return int(np.bitwise_count(left ^ right).sum())  # of signed numbers it would count absolute values


def _likely(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bitmaps do not refute: linked sets differ in few enough shingles."""
    left = maps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    right = maps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    kind = dict(maps.dtypes)["doc_id"]

    def work(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            apart = np.fromiter(
                map(apart_at_least, _lists(batch.column("ma")), _lists(batch.column("mb"))), np.int64, len(na)
            )
            # common >= t * union means union - common <= (1 - t) / (1 + t) * (na + nb).
            few = (100 + percent) * apart <= (100 - percent) * (na + nb)
            yield batch.select(["a", "b"]).take(np.flatnonzero(few))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(work, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    used = pairs.select(F.col("a").alias("rid")).union(pairs.select("b"))
    wanted = shingle_sets(may_contain(docs, "doc_id", key_filter(used, "rid")), size)
    left = wanted.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = wanted.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .withColumn("common", common)
        .where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
        .select("a", "b").distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id points at one id, which points nowhere: then nothing is left to do."""
    ends = edges.selectExpr("u as id", "1 as tail", "0 as head").union(edges.selectExpr("v", "0", "1"))
    roles = ends.groupBy("id").agg(F.sum("tail").alias("tails"), F.max("head").alias("head"))
    return roles.where("tails > 1 or tails = 1 and head = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``rid`` and ``label`` (smallest id of its component) of every linked id.

    Large and small stars in turn (Kiveris et al. 2014): every id points at the smallest id it
    knows of, until all are stars. Neighbours are never gathered; a hub is a minimum per key.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(),
        "edges",
    )
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past = edges, large
        edges = stored(small.union(least).where("u != v").distinct(), "edges")
        for table in past:
            discard(table)
    tops = edges.select(F.col("u").alias("rid"), F.col("v").alias("label"))
    return tops.union(tops.select(F.col("label").alias("rid"), "label")).groupBy("rid").agg(F.min("label").alias("label"))


class _Corpus(NamedTuple):
    """What links are decided by: the texts, and ``doc_id``, ``n`` and ``bitmap`` of their sets."""

    docs: DataFrame
    maps: DataFrame
    size: int
    percent: int


def _links(likely: DataFrame, corpus: _Corpus) -> DataFrame:
    kept = stored(likely, "pairs")
    found = stored(_verified(kept, corpus.docs, corpus.size, corpus.percent), "links")
    discard(kept)
    return found


def _relabelled(open_entries: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with the components of all links; entries within one component are left out."""
    labels = stored(components(links), "labels")
    named = stored(
        open_entries.drop("label").join(labels, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "entries"
    )
    several = named.groupBy("entry").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h")
    kept = stored(named.join(several.select("entry"), "entry"), "entries")
    for table in (labels, named, open_entries):
        discard(table)
    return kept


def _groups(open_entries: DataFrame) -> DataFrame:
    """Of every entry with several components: the largest one, and the pairs between components."""
    return open_entries.groupBy("entry", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("entry").agg(
        F.count(F.lit(1)).alias("labels"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("inner"),
        F.max(F.struct("m", "label"))["label"].alias("main"),
    ).where("labels > 1")


def _pairs_left(open_entries: DataFrame) -> int:
    return int(_groups(open_entries).agg(F.sum((F.col("all") * F.col("all") - F.col("inner")) / 2)).first()[0] or 0)


def _pivot_pairs(open_entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every set with the pivots of its entries, of another component and a fitting size.

    Pivots go by a hash of their ids, another one in every turn, so that the sets of a group choose
    the same few.
    """
    order = [
        F.min(F.struct(F.xxhash64(F.lit(PIVOTS * turn + k), "rid"), F.col("rid").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("nb")))
        for k in range(PIVOTS)
    ]
    pivots = open_entries.groupBy("entry").agg(F.array(*order).alias("p")).select("entry", F.inline("p")).select(
        "entry", "b", "label_b", "nb"
    )
    fits = 100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")
    met = open_entries.join(pivots, "entry").where((F.col("label") != F.col("label_b")) & fits)
    return met.select(F.least("rid", "b").alias("a"), F.greatest("rid", "b").alias("b")).distinct()


def _compared(left, right, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two chunks, each (n, label code, beside, bitmaps), of the pairs to verify."""
    n, label, beside, maps = left
    m, other, _, others = right
    out = []
    widths, wide = (np.array([len(x) for x in y]) for y in (maps, others))
    for v, w in {(v, w) for v in widths for w in wide if v <= 2 * w and w <= 2 * v} if percent >= 50 else {(v, w) for v in widths for w in wide}:
        rows, columns = np.flatnonzero((widths == v) & beside), np.flatnonzero(wide == w)
        if not len(rows):
            continue
        least = min(v, w)
        a, b = (
            np.bitwise_xor.reduce(np.stack([x[i].view(np.uint64) for i in places]).reshape(len(places), -1, least), axis=1)
            for x, places in ((maps, rows), (others, columns))
        )
        step = max(1, (1 << 18) // (least * len(columns)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            sizes = n[some][:, None], m[columns][None, :]
            apart = np.bitwise_count(a[at : at + step][:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
            fit = (100 + percent) * apart <= (100 - percent) * (sizes[0] + sizes[1])
            fit &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            fit &= label[some][:, None] != other[columns][None, :]
            i, j = np.nonzero(fit)
            out.append((some[i], columns[j]))
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *(pair[k] for pair in out)]) for k in (0, 1))


def _remaining_pairs(open_entries: DataFrame, corpus: _Corpus) -> DataFrame:
    """The members beside their entry's main component with all others, unless bitmaps refute the pair."""
    kind, percent = dict(open_entries.dtypes)["rid"], corpus.percent
    main = _groups(open_entries).select("entry", "main", F.ceil(F.col("all") / CHUNK).alias("chunks"))
    rows = open_entries.join(main, "entry").join(corpus.maps.withColumnRenamed("doc_id", "rid"), ["rid", "n"])
    member = F.struct("rid", "n", "label", (F.col("label") != F.col("main")).alias("beside"), "bitmap")
    chunk = F.pmod(F.xxhash64("rid"), "chunks").alias("chunk")
    chunks = stored(rows.groupBy("entry", chunk).agg(F.collect_list(member).alias("members")), "chunks")
    left = chunks.where(F.exists("members", lambda m: m["beside"])).select("entry", F.col("members").alias("l"))
    both = left.join(chunks.select("entry", F.col("members").alias("r")), "entry").select("l", "r")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(len(batch)):
                sides = [pa.RecordBatch.from_struct_array(batch.column(c)[at].values) for c in ("l", "r")]
                labels = pa.concat_arrays([s.column("label") for s in sides]).dictionary_encode().indices.to_numpy()
                codes = np.split(labels, [len(sides[0])])
                found = _compared(
                    *((s.column("n").to_numpy(), code, s.column("beside").to_numpy(zero_copy_only=False), _lists(s.column("bitmap")))
                      for s, code in zip(sides, codes)),
                    percent,
                )
                yield pa.RecordBatch.from_arrays([s.column("rid").take(pa.array(f)) for s, f in zip(sides, found)], ["a", "b"])

    met = both.mapInArrow(work, f"a {kind}, b {kind}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(docs: DataFrame, described: DataFrame, size: int, percent: int) -> DataFrame:
    """``rid`` and ``label`` of sets that link with a different set; ``docs`` has one text of each."""
    shared = shared_entries(entries(docs, *cell_levels(described), percent, size))
    open_entries = stored(shared.withColumn("label", F.col("rid")), "entries")
    maps = may_contain(described.where("n > 0"), "doc_id", key_filter(open_entries, "rid")).select("doc_id", "n", "bitmap")
    corpus = _Corpus(docs, stored(maps, "maps"), size, percent)
    bound = max(1, int(PAIRS_PER_ENTRY * open_entries.count()))
    ids = dict(docs.dtypes)["doc_id"]
    links = docs.sparkSession.createDataFrame([], f"a {ids}, b {ids}")
    turn, before, pairs = 0, None, _pairs_left(open_entries)
    while pairs > bound and (before is None or pairs <= (1 - SETTLED) * before):
        likely = _likely(_pivot_pairs(open_entries, turn, percent), corpus.maps, percent)
        links = links.union(_links(likely, corpus))
        open_entries = _relabelled(open_entries, links)
        turn, before, pairs = turn + 1, pairs, _pairs_left(open_entries)
    if pairs:
        # A row of what is compared is a pair of chunks.
        with small_batches(docs.sparkSession, 8):
            links = links.union(_links(_remaining_pairs(open_entries, corpus), corpus))
    return components(links)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of a Jaccard similarity of
    ``percent`` or more. Texts without words (null and empty ones) have no shingles and are their
    own component. Rows that repeat an id are one document. Rows with a null id are in the
    component of an equal set or else in none (null). Shingles are compared as 64-bit hashes of
    their words. An empty table gives no rows; other columns are ignored. ``docs`` is read several
    times, as sets are made again where they are compared.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, size, percent)


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    described = stored(described_sets(docs, size), "sets")
    sets = described.where("n is not null")
    full = sets.where("n > 0")
    classes = stored(full.groupBy("n", "set_key").agg(F.min("doc_id").alias("rid")), "classes")
    ids = classes.where("rid is not null").select("rid")
    # The filter lets some copies through as well; they are then linked like any other pair.
    alone = may_contain(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", key_filter(ids, "rid"))
    twice = classes.select(F.col("rid").alias("a")).join(
        full.where("doc_id is not null").select("doc_id", "n", "set_key").distinct()
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"),
        F.col("a") == F.col("doc_id"), "left_semi",
    )
    linked = stored(_linked(alone, described, size, percent), "components")
    repeated = full.where("doc_id is not null").select("doc_id", "n", "set_key").join(classes, ["n", "set_key"]).join(
        twice.distinct(), F.col("doc_id") == F.col("a"), "left_semi"
    ).where("doc_id != rid").select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    repeated = stored(repeated, "repeated")
    if not repeated.isEmpty():
        linked = stored(
            components(linked.select(F.col("rid").alias("a"), F.col("label").alias("b")).union(repeated)), "components"
        )
    placed = (
        full.select("doc_id", "n", "set_key").join(classes, ["n", "set_key"]).join(linked, "rid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rid").alias("component_id"))
    )
    return placed.union(sets.where("n = 0").select("doc_id", "n", "doc_id"))
