"""Style factoring against a plain recursive walk, and its inverse."""

import random
from collections import Counter

import pytest

from quire.operators import factoring

PROPERTIES = ["font", "size", "bold"]


def plain(children, leaves):
    """Styles by wrapper, and what each leaf keeps; wrappers are visited outermost first."""
    below = lambda w: [x for x in leaves if x["wrapper"] == w] + [x for c in children.get(w, []) for x in below(c)]
    refs, taken, seen = {}, {}, Counter()

    def visit(w, frozen, matched):
        extent = sorted(below(w), key=lambda x: x["place"])
        keys = [p for p in PROPERTIES if p not in frozen and extent and all(x[p] is not None for x in extent)]
        groups = {}
        for x in extent:
            if keys and x["leaf"] not in matched:
                groups.setdefault(tuple((p, x[p]) for p in keys), []).append(x["leaf"])
        best = max(((len(v), -list(groups).index(t), t) for t, v in groups.items() if len(v) > 1), default=None)
        if best:
            refs[w] = best[2]
            seen[best[2]] += best[0]
            for i in groups[best[2]]:
                taken[i] = keys
            frozen, matched = frozen | set(keys), matched | set(groups[best[2]])
        for c in children.get(w, []):
            visit(c, frozen, matched)

    for root in children[None]:
        visit(root, frozenset(), frozenset())
    first = {}
    for k, t in enumerate(sorted(refs, key=int)):
        first.setdefault(refs[t], k)
    order = {t: f"s{n}" for n, t in enumerate(sorted(seen, key=lambda t: (-seen[t], first[t])), 1)}
    return {w: order[t] for w, t in refs.items()}, {order[t]: dict(t) for t in order}, {x["leaf"]: {p: None if p in taken.get(x["leaf"], ()) else x[p] for p in PROPERTIES} for x in leaves}


@pytest.mark.parametrize("seed", range(2))
def test_factor_and_resolve(spark, seed):
    rng = random.Random(seed)
    wrappers, leaves, expected = [], [], {}
    for doc in range(6):
        parents, children = {}, {None: []}
        for w in range(8):
            parents[w] = None if w == 0 or rng.random() < 0.2 else rng.randrange(w)
        order = []

        def number(w, order=order, parents=parents):
            order.append(w)
            for c in (c for c in parents if parents[c] == w):
                number(c)

        for w in (w for w in parents if parents[w] is None):
            number(w)
        name = {w: k for k, w in enumerate(order)}
        for w in order:
            children.setdefault(None if parents[w] is None else str(name[parents[w]]), []).append(str(name[w]))
            wrappers.append((doc, str(name[w]), None if parents[w] is None else str(name[parents[w]]), name[w]))
        own = [{"doc": doc, "leaf": f"{w}-{k}", "wrapper": str(w), "place": w * 10 + k, "font": rng.choice("aab"), "size": rng.choice([9.0, 9.0, 10.5, None]) if rng.random() < 0.2 else 9.5, "bold": rng.choice([True, False])} for w in range(8) for k in range(rng.randrange(4))]
        leaves += own
        expected[doc] = plain(children, own)
    wdf = spark.createDataFrame(wrappers, "doc int, wrapper string, parent string, place int")
    ldf = spark.createDataFrame([tuple(x.values()) for x in leaves], "doc int, leaf string, wrapper string, place int, font string, size double, bold boolean")
    styles, refs, rest = factoring.factor(wdf, ldf, PROPERTIES)
    found = {d: ({}, {}, {}) for d in expected}
    for r in refs.collect():
        found[r.doc][0][r.wrapper] = r.style
    for r in styles.collect():
        found[r.doc][1][r.style] = {p: r[p] for p in PROPERTIES if r[p] is not None}
    for r in rest.collect():
        found[r.doc][2][r.leaf] = {p: r[p] for p in PROPERTIES}
    assert found == expected
    back = factoring.resolve(wdf, rest, styles, refs, PROPERTIES).select(ldf.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ldf.collect()), key=lambda r: r)


def test_nothing_to_factor(spark):
    wdf = spark.createDataFrame([(1, "a", None, 0)], "doc int, wrapper string, parent string, place int")
    ldf = spark.createDataFrame([(1, "x", "a", 1, "f"), (1, "y", "a", 2, "g"), (1, "z", "a", 3, None)], "doc int, leaf string, wrapper string, place int, font string")
    styles, refs, rest = factoring.factor(wdf, ldf, ["font"])
    assert styles.collect() == refs.collect() == []
    assert sorted(r.font or "" for r in rest.collect()) == ["", "f", "g"]
    cycle = spark.createDataFrame([(1, "a", "b", 0), (1, "b", "a", 1)], "doc int, wrapper string, parent string, place int")
    with pytest.raises(ValueError):
        factoring.chains(cycle, "doc", "wrapper", "parent")


def test_few_lineage_cuts(spark, monkeypatch):
    """A forest of four levels is written as often as one of a single level."""
    written = []
    monkeypatch.setattr(factoring, "materialize", lambda df, cut=factoring.materialize: written.append(1) or cut(df))
    wdf = spark.createDataFrame([(1, str(k), str(k - 1) if k else None, k) for k in range(4)], "doc int, wrapper string, parent string, place int")
    ldf = spark.createDataFrame([(1, f"x{k}", str(k % 4), k, "ff" if k < 2 else "g") for k in range(8)], "doc int, leaf string, wrapper string, place int, font string")
    refs = factoring.factor(wdf, ldf, ["font"])[1]
    assert [tuple(r) for r in refs.collect()] == [(1, "0", "s1")] and len(written) <= 7


def test_large_documents_are_joined(spark, monkeypatch):
    rows = [(d, str(k), str(k // 2) if k > 1 else None) for d, n in ((1, 9), (2, 2), (None, 2)) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "doc int, wrapper string, parent string")
    found = sorted(map(repr, factoring.chains(df, "doc", "wrapper", "parent").collect()))
    assert "Row(doc=1, wrapper='9', chain=['1', '2', '4', '9'])" in found and len(found) == len(rows)
    monkeypatch.setattr(factoring, "HELD", 4)
    assert sorted(map(repr, factoring.chains(df, "doc", "wrapper", "parent").collect())) == found
