"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1. An n-gram is bound by
multiplying the vectors of its letters, each permuted (rolled) by its place in the n-gram. A text
is the bundle (sum) of its n-grams, a language the bundle of its texts. The language whose
prototype has the largest cosine with the text's bundle is the answer.

Texts are handled in numpy, a few hundred KB at a time: the bundle of many texts is the product
of their n-gram counts with the vectors of the n-grams that occur. Learning sends per task one
vector per language, exploded into numbers so that they are summed before and after the shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import byte_slices

DIMENSIONS = 1024
GRAM = 3
#: Letters share this many random vectors; those of the Latin blocks have one each.
SLOTS = 1024
_OWN = 592
_SEED = 7
#: Characters of text that are turned into bundles together.
CHUNK = 1 << 18
UNKNOWN = "und"


class Profiles(NamedTuple):
    """Languages in alphabetical order and their prototypes, one unit vector each."""

    languages: list[str]
    prototypes: np.ndarray


def _slot(point: int) -> int:
    char = chr(point)
    if not char.isalpha():
        return 0
    low = ord(char.lower()[0])
    return low if low < _OWN else _OWN + low % (SLOTS - _OWN)


class Encoder:
    """Bundles of texts. Built once per task."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        signs = np.random.default_rng(_SEED).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1
        self.rolled = [np.roll(signs, gram - 1 - i, axis=1).astype(np.int8) for i in range(gram)]
        self.slots = np.zeros(0x10000, dtype=np.int16)
        known = np.zeros(0x10000, dtype=bool)
        self._known = known

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        high = points >= 0x10000
        basic = np.where(high, 0, points) if high.any() else points
        fresh = np.flatnonzero(np.bincount(basic, minlength=1) > 0)
        for point in fresh[~self._known[fresh]]:
            self.slots[point] = _slot(int(point))
            self._known[point] = True
        out = self.slots[basic]
        for point in np.unique(points[high]):
            out[points == point] = _slot(int(point))
        return out

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the n-grams of all texts (one row each) and the text each belongs to.

        Words are framed by gaps; n-grams run over the words of a text but not over its end.
        """
        found = [self.symbols(text) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in found])
        gap = np.zeros(1, dtype=np.int16)
        run = np.concatenate([y for x in found for y in (gap, x)] + [gap])
        owner = np.append(owner, len(texts))
        keep = np.append(True, (run[1:] != 0) | (run[:-1] != 0) | (owner[1:] != owner[:-1]))
        run, owner = run[keep], owner[keep]
        n = len(run) - self.gram + 1
        if n < 1:
            return np.zeros((0, self.gram), np.int16), np.zeros(0, np.int64)
        table = np.lib.stride_tricks.sliding_window_view(run, self.gram)
        # The last n-gram of a text may end on the gap that opens the next one.
        whole = (owner[:n] == owner[self.gram - 2 : self.gram - 2 + n]) & (table != 0).any(axis=1)
        whole &= (table[:, 1:] != 0).any(axis=1) if self.gram > 1 else True
        return table[whole], owner[:n][whole]

    def bundles(self, texts: list[str], owners: np.ndarray, n: int) -> np.ndarray:
        """``n`` bundles; text i is added to bundle ``owners[i]``."""
        table, owner = self.grams(texts)
        if not len(owner):
            return np.zeros((n, self.dimensions), dtype=np.float32)
        present = np.flatnonzero(np.bincount(table.ravel()))
        compact = np.zeros(SLOTS, dtype=np.int64)
        compact[present] = np.arange(len(present))
        key = np.zeros(len(table), dtype=np.int64)
        for i in range(self.gram):
            key = key * len(present) + compact[table[:, i]]
        if len(present) ** self.gram <= 1 << 22:
            used = np.flatnonzero(np.bincount(key))
            place = np.zeros(used[-1] + 1, dtype=np.int64)
            place[used] = np.arange(len(used))
            column = place[key]
        else:
            used, column = np.unique(key, return_inverse=True)
        counts = np.bincount(
            np.asarray(owners)[owner] * len(used) + column, minlength=n * len(used)
        ).reshape(n, len(used))
        bound = np.ones((len(used), self.dimensions), dtype=np.int8)
        rest = used
        for i in reversed(range(self.gram)):
            bound *= self.rolled[i][present[rest % len(present)]]
            rest = rest // len(present)
        return counts.astype(np.float32) @ bound.astype(np.float32)

    def pieces(self, texts):
        """Lists of (index, part of text) of about CHUNK characters; long texts in several parts."""
        out, size = [], 0
        for index, text in enumerate(texts):
            for at in range(0, len(text), CHUNK):
                # Parts overlap so that no n-gram is lost; a run of gaps counts once anyway.
                part = text[max(0, at - self.gram + 1) : at + CHUNK] if at else text[:CHUNK]
                out.append((index, part))
                size += len(part)
                if size >= CHUNK:
                    yield out
                    out, size = [], 0
        if out:
            yield out


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes from every row of ``labelled`` (columns ``text``, ``lang``); nulls are left out."""

    def work(batches):
        import pyarrow as pa

        encoder, sums = Encoder(dimensions), {}
        for batch in (part for whole in batches for part in byte_slices(whole, 0)):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names = sorted(set(langs))
            place = {name: i for i, name in enumerate(names)}
            for part in encoder.pieces(texts):
                owners = np.array([place[langs[i]] for i, _ in part])
                got = encoder.bundles([t for _, t in part], owners, len(names)).astype(np.float64)
                for name, row in zip(names, got):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            kinds = [pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), kinds[0]), pa.array([v.tolist() for v in sums.values()], kinds[1])],
                ["lang", "bundle"],
            )

    rows = (
        labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(work, "lang string, bundle array<double>")
        .select("lang", F.posexplode("bundle").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .collect()  # languages times dimensions
    )
    languages = sorted({row["lang"] for row in rows})
    table = np.zeros((len(languages), dimensions))
    for row in rows:
        table[languages.index(row["lang"]), row["place"]] = row["value"]
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return Profiles(languages, table / np.where(length > 0, length, 1))


def identify(docs: DataFrame, profiles: Profiles, dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every row of ``docs``: the columns ``keep``, ``lang_pred`` and ``score``.

    ``score`` is the cosine with the prototype of ``lang_pred``, not below 0. A text that is null
    or has no letter is ``und`` with score 0, and so is every text when nothing was learned. Equal
    cosines go to the language first in the alphabet; long texts are read whole, in parts.
    """
    languages = profiles.languages
    prototypes = profiles.prototypes.astype(np.float32)
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def work(batches):
        import pyarrow as pa

        encoder = Encoder(dimensions)
        for batch in (part for whole in batches for part in byte_slices(whole, len(keep))):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            bundle_of: dict[int, np.ndarray] = {}
            for part in encoder.pieces(texts):
                indexes = sorted({i for i, _ in part})
                place = {i: k for k, i in enumerate(indexes)}
                owners = np.array([place[i] for i, _ in part])
                got = encoder.bundles([t for _, t in part], owners, len(indexes))
                for i, row in zip(indexes, got):
                    bundle_of[i] = bundle_of[i] + row if i in bundle_of else row
                done = [i for i in bundle_of if i < indexes[-1]]
                _decide(done, bundle_of, languages, prototypes, names, scores)
            _decide(list(bundle_of), bundle_of, languages, prototypes, names, scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return docs.select(*keep, "text").mapInArrow(work, f"{schema}, lang_pred string, score double")


def _decide(done, bundle_of, languages, prototypes, names, scores) -> None:
    """Writes the answer for finished texts and forgets their bundles."""
    if not done or not languages:
        return
    rows = np.stack([bundle_of.pop(i) for i in done])
    length = np.linalg.norm(rows, axis=1)
    cosine = rows @ prototypes.T / np.where(length > 0, length, 1)[:, None]
    best = cosine.argmax(axis=1)
    for k, i in enumerate(done):
        if length[k] > 0:
            names[i] = languages[best[k]]
            scores[i] = min(1.0, max(0.0, float(cosine[k, best[k]])))
