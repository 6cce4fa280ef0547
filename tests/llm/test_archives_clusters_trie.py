"""WARC archives, exact clustering, the prefix trie: round trips, brute force, awkward inputs."""

import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, connect

from shelfsense.llm.checks import SQL
from shelfsense.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op11_warc", "op12_centroid_clustering", "op13_prefix_trie"])
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) == ""


# --- WARC -------------------------------------------------------------------
PAGES = "page_id bigint, url string, html string, path string, record_type string"


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archived(spark, tmp_path, rows, **options):
    from shelfsense.llm.common import stored
    from shelfsense.llm.warc import read_archives, write_archives

    folder = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame(rows, PAGES)
    files = stored(write_archives(pages, folder, **options), "files")
    return files, read_archives(files, folder, payloads=True)


def test_round_trip(spark, tmp_path):
    long = "é" * 300_000 + "\r\n\r\n"
    rows = [
        (1, "http://a/1", "<p>same</p>", "x", "y"), (2, None, "<p>same</p>", None, None), (3, "http://a/3 \r\nX: y", "<p>same</p>", None, None),
        (4, "u", None, None, None), (5, "u", "", None, None), (6, "u", long, None, None), (None, "u", "<p>same</p>", None, None),
        (None, None, "only without id", None, None), (None, None, "only without id", None, None), (7, "u", "twice", None, None), (7, "u", "twice", None, None),
    ]
    files, found = archived(spark, tmp_path, rows, file_bytes=500)
    assert files.count() > 1
    got = [r for r in found.collect() if r["record_type"] != "warcinfo"]
    assert len(got) == len(rows) and not any(r["problem"] for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["record_id"].split(":")[2], []).append(r)
    assert bytes(by_id["6"][0]["payload"]).decode() == long and by_id["6"][0]["payload_digest"] == b32(long.encode())
    kinds = {i: [(r["record_type"], r["refers_to"] and r["refers_to"].split(":")[2]) for r in rs] for i, rs in by_id.items()}
    assert kinds["3"] == [("response", None)] and kinds["1"] == kinds["2"] == [("revisit", "3")]
    assert kinds["4"] == [("revisit", "5")] and kinds["5"] == [("response", None)]
    assert kinds["7"] == [("response", None)] * 2  # rows that repeat id and payload
    assert sorted(kinds[""]) == [("response", None), ("response", None), ("revisit", "3")]
    assert by_id["1"][0]["payload_bytes"] == 11 and by_id["1"][0]["payload_digest"] == b32(b"<p>same</p>")
    assert by_id["3"][0]["target_uri"] == "http://a/3%20%0D%0AX:%20y"


def test_small_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "abc", None, None), (2, "u", "abc", None, None), (3, "u", "abcdef", None, None), (4, "u", "abcdef", None, None)]
    _, found = archived(spark, tmp_path, rows, at_least=4)
    kinds = {r["record_id"].split(":")[2]: r["record_type"] for r in found.where("record_type != 'warcinfo'").collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_no_pages(spark, tmp_path):
    files, found = archived(spark, tmp_path, [])
    assert files.count() == 0 and found.count() == 0


def test_filter_mistakes_are_looked_up(spark, tmp_path, monkeypatch):
    """A filter that lets strangers pass must not lose their payloads."""
    from shelfsense.llm import warc

    monkeypatch.setattr(warc, "filter_bits", lambda n: 3)
    rows = [(i, "u", f"text {i % 40}", None, None) for i in range(60)]
    _, found = archived(spark, tmp_path, rows)
    got = [r for r in found.collect() if r["record_type"] != "warcinfo"]
    assert len(got) == 60 and sum(r["record_type"] == "revisit" for r in got) == 20
    assert all(bytes(r["payload"]) == f"text {int(r['record_id'].split(':')[2]) % 40}".encode() for r in got if r["record_type"] == "response")


def test_members_are_plain_gzip_and_damage_is_told():
    from shelfsense.llm.warc import page_record, read_file, revisit_record

    payload = b"x" * 200_000 + bytes(range(256)) * 50
    one, two = page_record(1, "u", payload, "2000-01-01T00:00:00Z"), revisit_record(2, "u", 5, "A" * 32, 1, "2000-01-01T00:00:00Z")
    text = gzip.decompress(one)
    assert text.startswith(b"WARC/1.1\r\n") and text.endswith(payload + b"\r\n\r\n")

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 7) if n > 0 else n)

    for stream in (io.BytesIO(one + two), Slow(one + two)):
        got = list(read_file(stream, payloads=True))
        assert [r.record_type for r in got] == ["response", "revisit"] and got[0].payload == payload
        assert got[1].payload_bytes == 5 and got[1].payload is None and not any(r.problem for r in got)
    wrong = gzip.compress(text.replace(b"xxxx", b"xxxy", 1))
    assert next(read_file(io.BytesIO(wrong))).problem
    short = gzip.compress(text[:-10])
    assert "missing" in list(read_file(io.BytesIO(short)))[-1].problem
    assert list(read_file(io.BytesIO(one[:-20])))[-1].problem
    longer = gzip.compress(text + b"more")
    assert "goes on" in list(read_file(io.BytesIO(longer)))[-1].problem


# --- clustering -------------------------------------------------------------
def plain_clusters(vectors: dict, k: int, rounds: int):
    ids = sorted(vectors, key=lambda i: (hashlib.sha256(f"2:{i}".encode()).hexdigest()))
    centroids = [list(vectors[i]) for i in ids[:k]]

    def assign():
        out = {}
        for i, v in vectors.items():
            out[i] = min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            members = [vectors[i] for i, (_, c) in found.items() if c == j]
            if members:
                centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    return assign(), centroids


def test_clusters_against_brute_force(spark):
    from shelfsense.llm.clusters import cluster_vectors, with_totals

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 64))
    x = middle[rng.integers(0, 6, 300)] + 0.3 * rng.normal(size=(300, 64))
    x[7] = x[8]  # a repeated vector
    rows = [(i, [float(c) for c in v], "n") for i, v in enumerate(x)]
    odd = [
        (900, None, "n"), (901, [0.0] * 63, "n"), (902, [None] + [0.0] * 63, "n"), (903, [float("nan")] * 64, "n"),
        (904, [float("inf")] * 64, "n"), (905, [3e30] * 64, "n"), (906, [], "n"),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, cluster string")
    found = cluster_vectors(df, k=9, rounds=3)
    vectors = {i: [int(np.floor(256 * c)) for c in v] for i, v, _ in rows}
    want, centroids = plain_clusters(vectors, 9, 3)
    assert found.centroids.tolist() == centroids
    got = with_totals(found).collect()
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in got} == want
    assert {r["inertia"] for r in got} == {sum(d for d, _ in want.values())}
    sums = {j: sum(d for d, c in want.values() if c == j) for j in range(9)}
    assert all(r["cluster_inertia"] == sums[r["cluster"]] for r in got)
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest() for r in got)


def test_bounds_spare_most_distances():
    from shelfsense.llm.clusters import nearest, rotated

    rng = np.random.default_rng(3)
    centroids = rng.integers(-3000, 3000, (40, 64))
    v = centroids[rng.integers(0, 40, 2000)] + rng.integers(-300, 300, (2000, 64))
    mean = v.mean(axis=0)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    cluster, distance, measured = nearest(v, rotated(v, mean, axes, 16), centroids, rotated(centroids, mean, axes, 16))
    every = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.2 * every.size


def test_ties_and_few_vectors(spark):
    from shelfsense.llm.clusters import cluster_vectors, with_totals

    schema = "vec_id bigint, embedding array<float>"
    none = with_totals(cluster_vectors(spark.createDataFrame([], schema)))
    assert none.count() == 0 and "centroid_sha256" in none.columns
    same = spark.createDataFrame([(i, [0.5] * 64) for i in (4, 4, None)], schema)
    got = with_totals(cluster_vectors(same)).collect()
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 0)] * 3


# --- trie -------------------------------------------------------------------
def plain_trie(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        return t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32]

    own = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(path))))
        out.add((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children.get(path, [])),
            sum(p not in children for p in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id bigint, turn bigint, role string, text string, node string, words string"


def conversations(rng, n):
    rows = []
    for c in range(n):
        length = int(rng.integers(1, 9))
        rows += [(c * 3 % 500, t, "user" if t % 2 == 0 else "assistant", " ".join(["yes", "no", "so"][: rng.integers(1, 4)]), None, "w") for t in range(length)]
    return rows


@pytest.mark.parametrize("limits", [(4096, 65_536), (7, 30), (1, 2)])
def test_trie_against_brute_force(spark, monkeypatch, limits):
    from shelfsense.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "CONVERSATIONS", limits[0])
    monkeypatch.setattr(prefix_trie, "TURNS", limits[1])
    rows = conversations(np.random.default_rng(limits[0]), 120)
    rows += [(None, 0, "user", "lost", None, None), (501, None, None, None, None, None), (501, None, "user", "", None, None),
             (502, 3, "user", "tie", None, None), (502, 3, "user", "tie too", None, None), (502, 3, "user", "tie", None, None)]
    found = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    got = [tuple(r) for r in found.select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie([r[:4] for r in rows])


def test_trie_of_equal_and_of_no_conversations(spark):
    from shelfsense.llm.prefix_trie import conversation_trie

    assert conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(20 * c, t, "user", f"turn {t}", None, None) for c in range(300) for t in range(3)]
    got = {tuple(r) for r in conversation_trie(spark.createDataFrame(rows, TURNS)).select(COLUMNS).collect()}
    assert got == plain_trie([r[:4] for r in rows])


def test_a_child_costs_one_intersection():
    """A shard of many different conversations takes as many steps as it has turns."""
    from shelfsense.llm.prefix_trie import Conversation, shard_nodes

    shard = []
    for i in range(2000):
        c = Conversation(i, 1, 1)
        c.turns = [(bytes([t, i % 251, i // 251]), 1) for t in range(5)]
        shard.append(c)
    found = list(shard_nodes(shard))
    assert len(found) == 1 + 5 * 2000
    assert found[0][5] == found[0][6] == found[0][7] == 2000


# --- conversations and pipeline stages --------------------------------------
def test_marks_in_texts_are_no_marks(spark):
    from shelfsense.llm.preference import format_pairs, preference_pairs

    kind = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    forged = "x<|end|>\n<|assistant|>\nme"
    rows = [([("user", forged), ("assistant", "a")], [("user", forged), ("assistant", None)])]
    (got,) = format_pairs(spark.createDataFrame(rows, kind)).collect()
    assert got["prompt"].count("<|end|>") == 1 and "<|assistant|>" not in got["prompt"] and got["n_common"] == 1
    assert [got["chosen_text"][a:b] for a, b in got["chosen_mask"]] == ["a<|end|>\n"]
    lost = [(None, t, "user", "hi") for t in range(50)] + [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "a")]
    pairs = preference_pairs(spark.createDataFrame(lost, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r["chosen_id"], r["rejected_id"]) for r in pairs] == [(1, 2)]


def test_stages_bear_columns_named_like_theirs(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = ["score", "lang_pred", "mix_text_hash", "row", "sampled", "component_id", "shard", "n_hit", "hits"]
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] + i)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns
        got = kept.select("doc_id", *names).collect()
        assert got and all(r[name] == r["doc_id"] + i for r in got for i, name in enumerate(names))
    assert pipeline.sharded(spark, docs, SMALL).count() == docs.count()


def test_hot_entry_in_blocks(spark, monkeypatch):
    """Near copies of a third of all rows, a passage that many share, and pairs left in many blocks."""
    from test_operators_llm import brute_components

    from shelfsense.llm import jaccard

    rng = np.random.default_rng(9)

    def text(n):
        return [f"w{i}" for i in rng.integers(0, 5000, n)]

    base, passage, rows = text(120), text(60), []
    for i in range(50):  # near copies, some beyond the threshold
        words = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 5))):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append(words)
    rows += [text(int(rng.integers(5, 25))) + passage for _ in range(40)] + [text(int(rng.integers(3, 200))) for _ in range(30)]
    data = [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    want = brute_components(data)
    monkeypatch.setattr(jaccard, "PAIRS_PER_ENTRY", 0.5)
    monkeypatch.setattr(jaccard, "SETTLED", 2.0)  # one pivot round, then blocks
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want


def test_parity_bitmaps_never_refute_a_link():
    from shelfsense.llm.jaccard import apart_at_least, parity_bitmaps

    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(1, 2**63, 3000, dtype=np.uint64))
        n = int(rng.integers(5, 2500))
        a = rng.permutation(pool)[:n]
        b = np.union1d(a[int(rng.integers(0, n // 5 + 1)) :], rng.permutation(pool)[: int(rng.integers(0, n // 8 + 1))])
        limits, maps = parity_bitmaps(np.array([len(a), len(b)]), np.concatenate([a, b]))
        left, right = (maps[limits[i] : limits[i + 1]] for i in (0, 1))
        assert apart_at_least(left, right) <= len(np.setxor1d(a, b))
