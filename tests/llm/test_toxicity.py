"""Held-out accuracy on the given tables, unseen misspellings, and odd rows."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.runtime import table

DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs = table(spark, DIR, "documents")
    return docs.count(), {r.doc_id: r for r in toxicity.score(docs, table(spark, DIR, "labels")).collect()}


def test_held_out_accuracy(spark, scored):
    n, rows = scored
    assert len(rows) == n
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    lang = {r.doc_id: r.lang for r in table(spark, DIR, "documents").select("doc_id", "lang").collect()}
    marks = [(rows[r.doc_id].predicted, r.toxic, lang[r.doc_id]) for r in table(spark, DIR, "labels").collect() if rows[r.doc_id].held_out]
    assert np.mean([p for p, y, _ in marks if not y]) <= 0.01
    # the other languages have some 40 toxic examples each to learn from here
    assert np.mean([p for p, y, g in marks if y and g == "en"]) >= 0.8


def test_learning_sees_no_held_out_row(spark):
    found = toxicity.sample(table(spark, DIR, "documents"), table(spark, DIR, "labels")).select("doc_id", "toxic").collect()
    assert found and all(crc32(str(r.doc_id).encode()) % 3 != 1 for r in found)
    assert {r.toxic for r in found} == {0, 1}


def test_unseen_misspellings_share_ngrams():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    bad = ["worthless", "disgusting", "pathetic"]
    texts, labels = [], []
    for k in range(900):
        body = list(rng.choice(words, 40))
        if k % 3 == 0:
            body[5] = bad[k % 9 // 3]
        texts.append(" ".join(body))
        labels.append(int(k % 3 == 0))
    model = toxicity.train([toxicity.bag(t) for t in texts], np.array(labels))
    plain = " ".join(rng.choice(words, 40))
    assert model.score(plain) < 0.5
    for word in ("worthlesss", "disgustingg", "patheticc", "WORTHLESS!", "wworthless"):
        assert model.score(f"{plain} {word}") > 0.7


def test_a_long_text_is_read_whole_and_alike_in_parts(monkeypatch):
    text = "eine Zeile mit Wörtern\tund 1 Zahl " * 500
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "_CHUNK", 97)
    parts = toxicity.bag(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_ngrams_are_those_of_words():
    words, plain = " ab wörter ", []
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        plain += [words[i : i + n] for i in range(len(words) - n + 1) if " " not in words[i + 1 : i + n - 1]]
    assert sum(map(len, toxicity.grams("AB--Wörter"))) == len(plain)
    assert [len(b) for b in toxicity.bag("")] == [len(b) for b in toxicity.bag(None)] == [0, 0]


def test_odd_rows(spark):
    rows = [(1, "vile words here"), (2, "calm words there"), (3, None), (4, ""), (None, "calm"), (2, "calm words there"), (5, " .,! ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("score", F.lit(1))
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, marks).collect()
    assert len(found) == len(rows)
    same = {(r.doc_id, r.score) for r in found}
    assert len(same) == 6 and len({s for i, s in same if i in (3, 4, 5)}) == 1
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    none = toxicity.score(docs, marks.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score(docs.where("false"), marks).collect() == []
