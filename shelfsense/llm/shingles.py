"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A text is lower-cased in A-Z and cut at runs of space, tab and ``\\n \\v \\f \\r``. A word's hash
is a polynomial over random byte values modulo 2**64; a shingle's hash mixes those of its
words. All of it is array work over the UTF-8 bytes of a batch, with no per-word Python.
"""

from __future__ import annotations

import numpy as np

# Texts are hashed in runs of about this many bytes, cut between words.
CHUNK = 1 << 20
_SEED = 20240817


def _tables():
    rng = np.random.default_rng(_SEED)
    byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    byte[ord("A") : ord("Z") + 1] = byte[ord("a") : ord("z") + 1]
    gap = np.zeros(256, dtype=bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return byte, gap


BYTE, GAP = _tables()
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words raw[start:end]; work space is proportional to the run."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        high = ends[to - 1]
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(BYTE[raw[low:high]] * _powers(_P, high - low), out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (total[e] - total[s]) * _powers(_P_INVERSE, high - low)[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64))


def batch_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a batch, and where each text's words begin.

    ``raw``: the UTF-8 bytes of the texts one after the other; ``offsets``: their limits.
    """
    solid = np.zeros(len(raw) + 1, dtype=bool)
    solid[:-1] = ~GAP[raw]
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = solid[:-1]
    before[offsets] = False  # no word runs over the limit of two texts
    starts = np.flatnonzero(solid & ~before)
    after = np.append(solid[1:], False)
    after[offsets[offsets > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return _hash_words(raw, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; all its words where it has fewer than ``size``."""
    n = len(words)
    if n == 0:
        return words
    wide = min(n, size)
    total = np.zeros(n - wide + 1, dtype=np.uint64)
    for j, weight in enumerate(_powers(_Q, wide)):
        total += words[j : n - wide + 1 + j] * weight
    return np.unique(mix(total + np.uint64(wide)))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of an Arrow string column; a null has none."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, limits, data = column.buffers()
    offsets = np.frombuffer(limits, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_slices(batch, column: int, limit: int = 2 * CHUNK):
    """``batch`` in runs of rows whose texts have about ``limit`` bytes at most; a longer text is
    a run of its own. Keeps the work space of a run small whatever the batch holds."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
