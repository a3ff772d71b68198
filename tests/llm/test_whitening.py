"""Whitened embeddings against numpy on all rows, and exact integer sums."""

import numpy as np
import pytest

from quire.llm import whitening
from quire.runtime import table

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    far = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = x - s / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    return far, centred @ u / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def compared(spark, rows, **more):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA), **more).collect()
    return {(r.vec_id, r.component): r for r in found}, found


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.geomspace(1, 0.1, 12)
    vectors = [list(map(float, np.float32(v))) for v in base] + [list(map(float, np.float32(base[0])))] * 150
    by, found = compared(spark, list(enumerate(vectors)))
    far, z, shares = brute(vectors)
    assert len(found) == len(vectors) * 8
    for c in range(8):
        mine = np.array([by[i, c + 1].whitened for i in range(len(vectors))])
        assert np.allclose(mine, z[:, c], atol=1e-9) or np.allclose(mine, -z[:, c], atol=1e-9)
        assert all(abs(by[i, c + 1].explained / shares[c] - 1) < 1e-10 for i in (0, 77))
    assert [by[i, 1].deviation for i in range(len(vectors))] == far
    assert {r.n for r in found} == {450}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_each_distinct_vector_once(spark):
    vectors = [[0.0, 1.0], [0.0, 1.0], [1.0, 0.5], [2.0, 3.0]]
    by, found = compared(spark, list(enumerate(vectors)), weights="one")
    _, z, _ = brute([vectors[0], *vectors[2:]])
    assert {r.n for r in found} == {3}
    assert np.allclose(np.abs([by[i, 1].whitened for i in (1, 2, 3)]), np.abs(z[:, 0]))
    assert by[0, 1].whitened == by[1, 1].whitened


def test_given_tables(spark):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    found = whitening.whiten(rows).collect()
    assert len(found) == 8 * rows.count()
    assert found[0].identity_error < 1e-9


def test_hot_vectors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_ROWS", 10)
    monkeypatch.setattr(whitening, "HOT_SHARE", 5)
    vectors = [[1.0, 2.0]] * 60 + [[0.0, 1.0], [3.0, -1.0], [2.0, 2.0]]
    by, found = compared(spark, list(enumerate(vectors)))
    far, z, _ = brute(vectors)
    assert len(found) == len(by) == 2 * len(vectors)
    assert [by[i, 1].deviation for i in range(len(vectors))] == far
    assert np.allclose(np.abs([by[i, 2].whitened for i in range(len(vectors))]), np.abs(z[:, 1]))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [0.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = whitening.whiten(docs.selectExpr("*", "1 AS x", "2 AS key", "3 AS w", "4 AS rows")).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == [(False, 7, 1), (False, 7, 1), (False, 7, 2), (False, 7, 2), (False, 8, 1), (False, 8, 2), (True, 0, 1), (True, 0, 2)]
    # all lie on one line: the second component has no variance
    assert {(r.whitened, r.explained) for r in found if r.component == 2} == {(0.0, 0.0)}
    assert whitening.whiten(docs.where("vec_id < 6")).collect() == []
    alone = whitening.whiten(docs.where("vec_id = 8")).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in alone] == [(1, 0, 0.0, 0.0)] * 2


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.5, 1.0])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() if r.component == 1}
    assert found[1].deviation is None and abs(found[1].whitened - -found[2].whitened) < 1e-9
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, SCHEMA), weights="two")
