import re
from collections import defaultdict

import pytest

from quire.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weight[s]
            left -= target[s] if over else 0
        free -= over or free
    return target


def check(spark, docs):
    rows = mixing.mix(docs).collect()
    texts = docs.collect()
    assert len(rows) == len(texts)
    assert sorted(r.size for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for d in texts)
    source = {d.doc_id: d.source for d in texts}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    assert all(r.source_size == size[source[r.doc_id]] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source"))


def test_skewed_small_and_null_sources(spark):
    rows = [(i, "w " * (i % 9), "big") for i in range(5000)] + [(6000 + i, "a b c", s) for i, s in enumerate(["a", "b", None, "é", None])]
    rows += [(7000, None, "none"), (7001, "", "a")]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS shard"))


def test_quotients_are_the_highest(spark):
    rows = [(i, c) for i, c in enumerate([53, 24, 23, 1, 0, 100, 100, 7])]
    for seats in (0, 1, 2, 5, 8, 30, 101):
        claims = spark.createDataFrame([(*r, seats) for r in rows], "no long, claim long, seats long")
        got = {r.no: r.quota for r in mixing.apportion(claims, [], "claim", "seats", "no").collect()}
        want = dict.fromkeys(range(len(rows)), 0)
        for _ in range(seats):
            want[max(want, key=lambda i: (rows[i][1] / (2 * want[i] + 1), -i))] += 1
        assert got == want


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None)], schema)).collect()] == [0]
    twice = mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], schema)).collect()
    assert sum(r.taken for r in twice) == 4


def test_mixed_documents_have_the_taken_words(spark):
    rows = [(i, f" a{i}  b{i}\n" + "".join(f"w{k} " for k in range(i % 40)), ["x", "y", None][i % 3], "en", 0) for i in range(300)] + [(900, None, "x", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    found, whole = defaultdict(int), {r[0]: r[1] for r in rows}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words = r.text.split()
        found[r.doc_id] += len(words)
        assert r.n_chars == len(r.text) and set(words) <= set(whole[r.doc_id].split())
    assert found == taken
    assert mixing.mixed(docs.limit(0)).collect() == []
