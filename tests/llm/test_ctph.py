import hashlib
import random
from statistics import mean

import numpy as np
import pytest

from quire.llm import ctph


def expected(rows):
    """Edited texts in descending id order; ids are distinct here."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc_id, text) in enumerate(order):
        t, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[doc_id] = (t, t[: len(t) - half] + after[:half], after)
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "'x' AS next", "0 AS to")
    want = expected(rows)
    out = ctph.edited_likeness(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        text, edited, after = want[r.doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(text), ctph.fingerprint(edited))
        assert r.near_edited == ctph.compare([r.fingerprint], [r.edited_fingerprint])[0]
        assert r.near_next == ctph.compare([r.fingerprint], [ctph.fingerprint(after)])[0]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    return out


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(ctph, "BUCKET_ROWS", 30)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(spark, [(r.doc_id * 3 - 500, r.text) for r in docs.collect()])
    long = [r for r in out if r.n_chars > 500]
    assert mean(r.near_edited for r in long) > 0.4 > 0.1 > mean(r.near_next for r in long)


@pytest.mark.parametrize("size", [1, 5])
def test_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(ctph, "BUCKET_ROWS", size)
    texts = [None, "", "a", "é😀", "aaaa" * 900, "ab", "x" * 64, "y", "\n", "b" * 3]
    check(spark, [(i if i < 9 else None, t) for i, t in enumerate(texts)])
    check(spark, [(4, "alone in the table")])
    assert ctph.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert len(ctph.edited_likeness(twice).collect()) == 3


def test_similarity_is_edit_distance_by_a_table():
    rng = random.Random(3)
    left, right = [], []
    for _ in range(60):
        a = "".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 65)))
        b = "".join(c for c in a if rng.random() > 0.2) + "".join(rng.choice("ABCD") for _ in range(rng.randrange(0, 9)))
        left.append(a)
        right.append(b[:64] or "A")
    for a, b, got in zip(left, right, ctph.similarity(left, right)):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = d[i - 1, j - 1] if x == y else 1 + min(d[i - 1, j], d[i, j - 1])
        k = min(ctph.COMMON, len(a), len(b))
        common = any(a[i : i + k] in b for i in range(len(a) - k + 1))
        assert got == pytest.approx((1 - d[-1, -1] / (len(a) + len(b))) if common else 0)


def test_insertion_moves_few_pieces():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900))
    near = text[:2000] + "INSERTED WORDS " + text[2000:]
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(900))
    a, b, c = map(ctph.fingerprint, (text, near, other))
    assert ctph.compare([a], [b])[0] > 0.9 and ctph.compare([a], [c])[0] == 0
    assert ctph.compare([a], [a])[0] == 1 and ctph.fingerprint(str(text)) == a
