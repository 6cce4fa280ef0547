"""Entropy spans against a plain sliding window, the allow list, long candidates."""

import base64
import math
import random
import re
import time

import pytest

from shelfsense.llm import secrets

CODE = random.Random(3)


def token(n, letters=secrets.CLASSES[1].alphabet):
    return "".join(CODE.choice(letters) for _ in range(n))


def plain_spans(text, base):
    found = set()
    letters = "".join(dict.fromkeys("".join(c.alphabet for c in secrets.CLASSES)))
    for m in re.finditer("[" + re.escape(letters) + "]{20,}", text):
        if any(re.fullmatch(p, m[0]) for p in secrets.ALLOW_WHOLE):
            continue
        for rank, chars in enumerate(secrets.CLASSES, start=3):
            spans = []
            for at in range(len(m[0]) - 19):
                window = m[0][at : at + 20]
                if any(c not in chars.alphabet for c in window):
                    continue
                entropy = -sum(window.count(c) / 20 * math.log2(window.count(c) / 20) for c in set(window))
                if entropy >= chars.threshold - 1e-9:
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = at + 20
                    else:
                        spans.append([at, at + 20])
            for a, b in spans:
                pieces = re.split(secrets.SEPARATORS, m[0][a:b])
                if all(any(re.fullmatch(p, piece) for p in secrets.ALLOW) for piece in pieces):
                    continue
                places = [i for i in range(m.start() + a, m.start() + b) if not any(s <= i < e for s, e in base)]
                runs = []
                for i in places:
                    if runs and runs[-1][1] == i:
                        runs[-1][1] = i + 1
                    else:
                        runs.append([i, i + 1])
                found |= {(s, e, rank, chars.kind) for s, e in runs}
    return found


def test_spans_against_brute_force(spark):
    texts = [
        "plain words only, nothing to see here", "deploy/example/" + token(40), "key " + token(30) + " and " + token(60) + ".",
        token(25, "0123456789abcdef") + token(25), "aB" * 15, "x" * 50, "abcdefghijklmnopqrstuvwxyz0123456789",
        "token = " + token(30) + "/" + token(25), "Q" + token(20, "0123456789abcdef") + "Z" + token(30), token(40, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "2024-01-02/2024-03-04_12345678", "123e4567-e89b-12d3-a456-426614174000", "/usr/local/share/applications/someName12",
        "é" * 5 + token(33) + "é" + token(19), token(300), "MyVeryLongCamelCaseClassNameWithoutDigits", "",
    ] + [token(CODE.randint(15, 80), secrets.CLASSES[CODE.randint(0, 1)].alphabet + CODE.choice(["", "-/_"])) for _ in range(60)]
    rows = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for row in rows:
        base = [(s["start"], s["end"]) for s in row["base"]]
        assert {tuple(s) for s in row["added"]} == plain_spans(texts[row["doc_id"]], base), texts[row["doc_id"]]
    found = {row["doc_id"]: row["added"] for row in rows}
    assert found[1] and found[2] and found[9] and not any(found[i] for i in (0, 4, 5, 6, 10, 11, 12, 15, 16))


def test_redaction_leaves_no_part_of_a_secret(spark):
    secret = "Ab" + token(18, "0123456789abcdef") + "Zq" + token(20)
    docs = spark.createDataFrame([(1, f"use {secret} now", "k"), (2, None, "k"), (3, "clean", None)], "doc_id int, text string, row string")
    got = {r["doc_id"]: (r["text"], r["row"]) for r in secrets.redact(docs).collect()}
    assert got[2] == (None, "k") and got[3] == ("clean", None)
    assert re.fullmatch(r"use (\[secret\])+ now", got[1][0])


@pytest.mark.parametrize("size", [20_000, 400_000])
def test_long_candidates_take_linear_time(spark, size):
    text = base64.b64encode(random.Random(size).randbytes(size)).decode().rstrip("=")
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    begin = time.perf_counter()
    row = secrets.find_secrets(df).first()
    assert time.perf_counter() - begin < 10 + size / 10_000
    assert [tuple(s)[:2] for s in row["added"]] == [(0, len(text))]
