"""Exact duplicates by counting quotient filters, confirmed on the bytes.

1. Every text is normalised and given a 64-bit fingerprint and its SHA-256 (one narrow pass).
2. Each partition builds a counting quotient filter: a fingerprint's high bits are its quotient,
   the rest its remainder; remainders stand sorted in the run of their quotient, with counts.
   The runs are cut into blocks of neighbouring quotients.
3. Blocks with the same quotients merge by their sorted remainders. Nothing is lost: quotient
   and remainder give back the fingerprint. A fingerprint repeated by a third of all rows is one
   entry with a count, so no block grows with the number of copies.
4. Only rows whose fingerprint was counted more than once are compared byte by byte, by grouping
   on the text itself. A bounded bitmap keeps the other texts out of the shuffle, and the copies
   of one partition are combined before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_filter, may_contain, stored

#: About this many fingerprints share a block of a merged filter.
BLOCK_ENTRIES = 1 << 16
FILTER_SCHEMA = "block int, quotients binary, runs binary, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    """``text`` with every run of space, tab and line breaks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class QuotientFilter:
    """Exact counting quotient filter over 64-bit fingerprints, with ``bits`` quotient bits.

    ``quotients``: those in use, ascending; ``runs``: number of remainders of each;
    ``remainders``: ascending within a run; ``counts``: occurrences of each.
    """

    def __init__(self, bits, quotients, runs, remainders, counts):
        self.bits, self.quotients, self.runs = bits, quotients, runs
        self.remainders, self.counts = remainders, counts

    @classmethod
    def of(cls, bits: int, prints: np.ndarray, counts: np.ndarray | None = None):
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[: len(prints)])
        total = np.add.reduceat(counts, first) if len(first) else counts
        prints = prints[first]
        shift = np.uint64(64 - bits)
        quotients, runs = np.unique(prints >> shift, return_counts=True)
        return cls(bits, quotients, runs, prints & ((np.uint64(1) << shift) - np.uint64(1)), total)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Runs of equal quotients joined, remainders in order, counts added."""
        return cls.of(
            filters[0].bits,
            np.concatenate([f.fingerprints() for f in filters]),
            np.concatenate([f.counts for f in filters]),
        )

    def fingerprints(self) -> np.ndarray:
        return (np.repeat(self.quotients, self.runs) << np.uint64(64 - self.bits)) | self.remainders

    def blocks(self, block_bits: int):
        """The filter cut at the high bits of its quotients, as rows of FILTER_SCHEMA."""
        block = self.quotients >> np.uint64(self.bits - block_bits)
        limits = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
        ends = np.append(0, np.cumsum(self.runs))
        for low, high in zip(limits[:-1], limits[1:]):
            inside = slice(ends[low], ends[high])
            yield (
                int(block[low]),
                self.quotients[low:high].tobytes(), self.runs[low:high].tobytes(),
                self.remainders[inside].tobytes(), self.counts[inside].tobytes(),
            )

    @classmethod
    def from_row(cls, bits: int, quotients, runs, remainders, counts):
        u, i = np.uint64, np.int64
        return cls(
            bits, np.frombuffer(quotients, u), np.frombuffer(runs, i),
            np.frombuffer(remainders, u), np.frombuffer(counts, i),
        )


def partition_filters(prints: DataFrame, bits: int, block_bits: int) -> DataFrame:
    """A quotient filter of the column ``fingerprint`` of every partition, in blocks."""

    def build(batches):
        import pyarrow as pa

        whole = None
        for batch in batches:
            got = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = QuotientFilter.of(bits, got)
            whole = part if whole is None else QuotientFilter.merged([whole, part])
        if whole is not None and len(whole.quotients):
            rows = list(zip(*whole.blocks(block_bits)))
            kinds = [pa.int32()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)],
                ["block", "quotients", "runs", "remainders", "counts"],
            )

    return prints.select("fingerprint").mapInArrow(build, FILTER_SCHEMA)


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """``fingerprint`` and ``copies`` of every fingerprint that occurs more than once."""
    block_bits = max(8, (prints.count() // BLOCK_ENTRIES).bit_length())
    bits = block_bits + 12

    def merge(rows):
        import pandas as pd

        whole = QuotientFilter.merged(
            [
                QuotientFilter.from_row(bits, *row)
                for row in rows[["quotients", "runs", "remainders", "counts"]].itertuples(index=False)
            ]
        )
        again = whole.counts > 1
        return pd.DataFrame(
            {
                "fingerprint": whole.fingerprints()[again].view(np.int64),
                "copies": whole.counts[again],
            }
        )

    return (
        partition_filters(prints, bits, block_bits)
        .groupBy("block")
        .applyInPandas(merge, "fingerprint bigint, copies bigint")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts: one row per row of ``docs`` (columns ``doc_id``, ``text``).

    ``doc_id``, ``keep_id`` (smallest id of the group), ``group_size``, ``kept``,
    ``text_sha256`` of the normalised text. Null text counts as empty and empty texts are equal
    to each other. A null id loses against any other; a group of null ids has ``keep_id`` null
    and keeps them all. Rows that repeat an id together with its text are one document and share
    ``kept``. An empty table gives no rows; other columns are ignored.
    """
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    prints = stored(
        body.select(
            "doc_id", F.xxhash64("body").alias("fingerprint"), F.sha2("body", 256).alias("text_sha256")
        ),
        "fingerprints",
    )
    again = stored(repeated_fingerprints(prints), "repeated")
    suspects = may_contain(
        body.withColumn("fingerprint", F.xxhash64("body")), "fingerprint",
        key_filter(again, "fingerprint"),
    )
    groups = (
        suspects.groupBy("fingerprint", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("fingerprint", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return prints.join(groups, ["fingerprint", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, with all their columns."""
    stay = exact_groups(docs).where("kept").select("doc_id", "text_sha256").distinct()
    body_hash = F.sha2(normalised(F.col("text")), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), body_hash.alias("text_sha256"))
    match = rows.doc_id.eqNullSafe(stay.doc_id) & (rows.text_sha256 == stay.text_sha256)
    return (
        rows.join(stay, match, "left_semi").dropDuplicates(["text_sha256"]).select("row.*")
    )
