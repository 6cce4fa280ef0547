"""The training-data operators: brute force, literal rows, held-out accuracy, awkward inputs."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, entry string"
LONG = " ".join(f"word{i}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 3, "x", "y"),
        (1, "Alpha beta gamma delta epsilon zeta", "en", "a", 3, "x", "y"),
        (2, "alpha  BETA gamma delta epsilon zeta", None, None, None, None, None),
        (None, "no id here at all", "en", "b", 1, None, None), (None, None, None, None, None, None, None),
        (3, "", "de", "a", 0, None, None), (4, None, "fr", "b", None, None, None), (5, LONG, "en", "a", 1, None, None),
        (6, LONG + " end", "en", "a", 1, None, None), (7, "12 34", "en", "a", 1, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_language_held_out(spark, odd, none):
    from shelfsense.llm.language import identify, learn
    from shelfsense.llm.queries import op1_language_id

    got = op1_language_id(spark, SMALL).join(documents(spark).select("doc_id", "lang", "text"), "doc_id")
    rows = got.where("held_out and lang is not null and length(text) > 40").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    profiles = learn(documents(spark))
    found = identify(odd, profiles).collect()
    assert len(found) == 10
    assert [r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 7)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in found)
    assert identify(none, profiles).count() == 0
    assert {r["lang_pred"] for r in identify(odd, learn(none)).collect()} == {"und"}


def test_bundle_is_sum_of_bound_ngrams():
    import numpy as np

    from shelfsense.llm.language import Encoder

    encoder = Encoder(64)
    got = encoder.bundles(["ab c"], np.array([0]), 1)[0]
    run = [0, *encoder.symbols("ab c"), 0]
    want = np.zeros(64)
    for i in range(len(run) - 2):
        gram = run[i : i + 3]
        if any(gram[1:]):
            vector = np.ones(64)
            for k, symbol in enumerate(gram):
                vector = vector * encoder.rolled[k][symbol]
            want += vector
    assert (got == want).all()


BASE = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"),
)


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            size = len(m.group(1)) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_base_spans(spark, odd, none):
    from shelfsense.llm.queries import op2_secret_scan
    from shelfsense.llm.secrets import find_secrets

    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark).collect()}
    for r in op2_secret_scan(spark, SMALL).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
    assert find_secrets(odd).count() == 10 and find_secrets(none).count() == 0


def test_toxicity_held_out(spark, odd, none):
    from shelfsense.llm.toxicity import score, train

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs.where(~held), labels.where(~held))
    rows = score(docs.where(held), model).join(labels, "doc_id").where("toxic is not null").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) >= 0.95 * len(rows)
    found = score(odd, model).collect()
    assert len(found) == 10 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in score(odd, train(docs.limit(0), labels)).collect()} == {0.0}
    assert score(none, model).count() == 0


def test_exact_dedup_odd(odd, none):
    from shelfsense.llm.exact_dedup import exact_groups

    rows = exact_groups(odd).collect()
    assert len(rows) == 10 and exact_groups(none).count() == 0
    empty = [r for r in rows if r["doc_id"] in (3, 4)]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(3, 3)}


def test_contamination_odd(spark, odd, none):
    from shelfsense.llm.decontaminate import contamination, decontaminate

    items = spark.createDataFrame(
        [(1, "beta gamma"), (2, None), (None, ""), (3, " ".join(LONG.split()[5:25]))], "item_id bigint, text string"
    )
    rows = contamination(odd, items).collect()
    assert len(rows) == 10
    assert sorted((r["doc_id"], r["n_hit"]) for r in rows if r["n_hit"]) == [(1, 2), (1, 2), (2, 2), (5, 20), (6, 20)]
    assert contamination(none, items).count() == 0 and contamination(odd, items.limit(0)).count() == 10
    assert decontaminate(odd, items).columns == odd.columns
    assert decontaminate(odd, items).count() == 5
    assert decontaminate(odd, items, remove="spans").count() == 10


def test_shards(spark, odd, none):
    from shelfsense.llm.queries import op6_sharding
    from shelfsense.llm.sharding import ring_shards

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents(spark).collect()}
    slots = {}
    for r in op6_sharding(spark, SMALL).collect():
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(i, [])) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert ring_shards(odd, 3).count() == 10 and ring_shards(none, 3).count() == 0


def test_raking(spark, odd, none):
    import numpy as np

    from shelfsense.llm.mixing import Mix, mixture, rake

    rng = np.random.default_rng(1)
    cells, targets = rng.random((3, 4, 2)), [np.array([0.2, 0.3, 0.5]), np.full(4, 0.25), np.array([0.9, 0.1])]
    fitted = cells / cells.sum() * rake(cells, targets)
    for axis, want in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(a for a in range(3) if a != axis)), want)
    mix = Mix({"a": 1.0}, {"en": 0.5, "de": 0.5}, {"prose": 1.0})
    assert mixture(odd, mix).count() == 10 and mixture(none, mix).count() == 0


def test_sampled_shares_with_hot_source(spark):
    """A source with a third of the tokens and scarce languages: the sampled rows have the target shares."""
    from shelfsense.llm.mixing import DIMENSIONS, Mix, mixture

    i, part = F.col("id"), lambda k: F.xxhash64(F.lit(k), "id") % 100
    docs = spark.range(40_000).select(
        i.alias("doc_id"), F.repeat(F.lit("word "), 10).alias("text"),
        F.when(i % 3 == 0, "src0").otherwise(F.concat(F.lit("src"), (1 + i % 4).cast("string"))).alias("source"),
        F.when(F.abs(part(1)) < 70, "en").when(F.abs(part(1)) < 90, "de").otherwise("es").alias("lang"),
        F.when(F.abs(part(2)) < 90, "prose").otherwise("table").alias("topic"),
    )
    mix = Mix(
        {"src0": 0.04, "src1": 0.24, "src2": 0.24, "src3": 0.24, "src4": 0.24},
        {"en": 0.4, "de": 0.4, "es": 0.2}, {"prose": 0.8, "table": 0.2},
    )
    for keep in (None, 0.95, 0.2):
        rows = mixture(docs, mix, keep=keep).where("sampled").cache()
        kept = rows.count()
        assert kept <= 40_000 * ((keep or 1) + 0.01)
        assert kept >= 40_000 * (min(keep or 1, 0.35) - 0.01)  # de outside src0 allows 0.37 at most; scaling the largest factor to 1 gives less
        for dimension in DIMENSIONS:
            shares = {r[0]: r["count"] / kept for r in rows.groupBy(dimension).count().collect()}
            assert shares == pytest.approx(getattr(mix, dimension), abs=0.012)


def brute_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if x]
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b]) if label[a] < label[b] else 0
                if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                    label[b] = label[a]
                    changed = True
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def test_jaccard_components(spark, odd, none):
    from shelfsense.llm.jaccard import near_duplicates

    docs = documents(spark)
    want = brute_components((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, near_duplicates(docs).collect())) == want
    assert any(i != c for i, _, c in want)
    got = {(r["doc_id"], r["component_id"]) for r in near_duplicates(odd).collect()}
    assert got == {(1, 1), (2, 1), (None, None), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)}
    assert near_duplicates(odd).count() == 10 and near_duplicates(none).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_prefix_entries_lose_no_link(share):
    """Whatever is called frequent, two sets of similarity 0.8 or more have a common entry."""
    import numpy as np

    from shelfsense.llm.jaccard import set_entries
    from shelfsense.llm.shingles import mix

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 200))
        pool = np.unique(rng.integers(1, 2**63, 2 * n + 2, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:n])
        rest = np.setdiff1d(pool, a)
        less = int(rng.integers(0, n // 5 + 1))
        b = np.union1d(rng.permutation(a)[less:], rest[: int(rng.integers(0, n // 5 + 1))])
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        often = [(mix(x) >> np.uint64(11)) < share * 2.0**53 for x in (a, b)]
        assert len(np.intersect1d(set_entries(a, often[0], 80), set_entries(b, often[1], 80)))


@pytest.mark.parametrize("percent", [30, 50, 70, 80])
def test_entries_at_any_threshold(percent):
    """Sets of very different sizes, all shingles frequent: a linked pair has a common entry."""
    import numpy as np

    from shelfsense.llm.jaccard import set_entries

    rng = np.random.default_rng(5)
    for n in (20, 85, 86, 90, 200, 500):
        b = np.unique(rng.integers(1, 2**63, n * 100 // percent, dtype=np.uint64))
        for less in (0, 1, 2):
            a = np.sort(rng.permutation(b)[: min(len(b), n + less)])
            if 100 * len(a) < percent * len(b):
                continue
            made = [set_entries(x, np.ones(len(x), dtype=bool), percent) for x in (a, b)]
            assert len(np.intersect1d(*made))


PAGE = """<html><body><nav><a href=x>Home</a> <a href=y>News</a></nav><div class="sidebar">Side text</div>
<article><h1>Fish &amp; chips</h1><p>First  paragraph of
the text, long enough to count.</p><p>Second paragraph, with a <a href=z>link</a> inside it.</p></article>
<div class="comments"><p>First!</p></div><footer>About us</footer><script>var x = 1</script></body></html>"""


def test_html(spark):
    from shelfsense.llm.html_text import extract_pages

    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (2, "u", "", "x"), (3, "u", "<div>" * 5000, "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect()]
    text = "Fish & chips\nFirst paragraph of the text, long enough to count.\nSecond paragraph, with a link inside it."
    assert sorted(got, key=str) == sorted(
        [(1, text, len(text)), (None, "", 0), (2, "", 0), (3, "", 0), (1, text, len(text))], key=str
    )
    assert extract_pages(pages.limit(0)).count() == 0


def test_html_without_article():
    """Unmarked blocks of links and teasers beside the text are left out, short text is not."""
    from shelfsense.llm.html_text import main_text

    text = [f"Paragraph {i} of the story goes on for long enough to be taken for running text." for i in range(5)]
    story = "".join(f"<p>{t}</p>" for t in text)
    links = "<div class=c1><ul>" + "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(8)) + "</ul></div>"
    teasers = "<div class=c2>" + "".join(
        f"<div><a href=/t{i}>A teaser title {i}</a><span>more about it</span></div>" for i in range(4)
    ) + "</div>"
    for page in (
        f"<div id=content>{story}</div>{links}", f"{links}<div id=content>{story}</div>{teasers}",
        f"<div><div>{teasers}{links}</div><div id=content>{story}</div></div>",
    ):
        assert main_text(f"<html><body>{page}</body></html>").split("\n") == text
    page = f"<html><body>{links}<h1>Title</h1><div><p>Short.</p><div>{story}</div></div><p>By <a href=/me>me</a></p></body></html>"
    assert main_text(page).split("\n") == ["Title", "Short.", *text, "By me"]
    two = f"<html><body>{links}<div>{story}</div>{teasers}<div>{story}</div></body></html>"
    assert main_text(two).split("\n") == text + text
    assert main_text(f"<html><body>{story}</body></html>").split("\n") == text


def test_html_marked_wrappers():
    """A mark on a wrapper, or a word inside a class, does not drop the text; real marks still do."""
    from shelfsense.llm.html_text import main_text

    text = [f"Paragraph {i} of the story goes on for long enough to be taken for running text." for i in range(5)]
    story = "".join(f"<p>{t}</p>" for t in text)
    aside = "<div class=site-footer>About us</div><div class='cookie-banner'>We use cookies.</div>"
    for name in ("layout with-sidebar", "no-sidebar", "has-header", "widget", "social", "main-nav social"):
        for inner in (f"<article>{story}</article>", f"<div id=content>{story}</div>"):
            page = f"<html><body>{aside}<div class='{name}'><div class=widget>{inner}<div class=sidebar>Side</div></div></div></body></html>"
            assert main_text(page).split("\n") == text, (name, inner)
    head = "<div class=article-header><h1>Title</h1></div>"
    replies = "<div class=comments>" + "<article><p>I think that this is a very good story.</p></article>" * 20 + "</div>"
    for around in ("article", "main"):
        page = f"<html><body><div class=header>Shop</div><{around}>{head}{story}<div class=share>Share</div></{around}>{replies}</body></html>"
        assert main_text(page).split("\n") == ["Title", *text]
    assert main_text(f"<html><body><form>{story}</form><nav>Menu</nav></body></html>").split("\n") == text
    assert main_text(f"<html><body><div hidden>{story}</div><p>Seen.</p></body></html>") == "Seen."
    assert main_text("<html><body><nav><a href=x>Home</a></nav></body></html>") == ""


def test_preference(spark):
    from shelfsense.llm.preference import format_pairs, preference_pairs

    kind = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = [([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no"), ("user", "why")]), (None, None)]
    first, empty = format_pairs(spark.createDataFrame(rows, kind)).collect()
    assert (first["n_common"], first["prompt"]) == (1, "<|user|>\nhi<|end|>\n")
    assert first["rejected_text"] == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n"
    for side, said in (("chosen", "yes"), ("rejected", "no")):
        assert [first[f"{side}_text"][a:b] for a, b in first[f"{side}_mask"]] == [said + "<|end|>\n"]
    assert first["usable"] and not empty["usable"] and empty["prompt"] == ""
    turns = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (None, None, None, None)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = preference_pairs(turns).collect()
    assert [(r["kind"], r["chosen_id"], r["rejected_id"]) for r in got] == [("opening", 1, 2)]
    assert preference_pairs(turns.limit(0)).count() == 0


def test_pipeline(spark, odd, none):
    import corpus_pipeline as pipeline

    docs = documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        assert stage(spark, odd, SMALL).columns == odd.columns and stage(spark, none, SMALL).count() == 0
        if name == "near_copies":
            rows = brute_components((r["doc_id"], r["text"]) for r in docs.collect())
            assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in rows if i == c]
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert pipeline.run(spark, SMALL).count() == docs.count()
