"""Projected graphs against a recursive walk, and canonical JSON."""

import hashlib
import json
import random

import pytest

from pyspark.sql import functions as F

from quire.operators import projection


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(nodes):
    """Nodes and edges of one document by recursion: nodes are (node, parent, place, kind, content, shared)."""
    found, edges = set(), set()

    def face(n):
        kids = sorted((m for m in nodes if m[1] == n[0]), key=lambda m: m[2])
        tokens, reached = [], []
        for m in kids:
            own, below = face(m)
            if m[5]:
                tokens.append(json.dumps({"ref": sha(own)}, separators=(",", ":")))
                reached.append((sha(own), (m[2],)))
            else:
                tokens.append(own)
                reached += [(to, (m[2], *way)) for to, way in below]
        text = f'{{"children":[{",".join(tokens)}],"content":{n[4]},"kind":{json.dumps(n[3])}}}'
        if n[5] or n[1] is None:
            found.add((sha(text), n[3], text))
            edges.update((sha(text), to, way) for to, way in reached)
        return text, reached

    for n in nodes:
        if n[1] is None:
            face(n)
    return found, edges


@pytest.mark.parametrize("seed", range(2))
def test_project(spark, seed):
    rng = random.Random(seed)
    rows, found, edges = [], set(), set()
    for doc in range(5):
        nodes = [(str(k), None if k == 0 else str(rng.randrange(k)), k, rng.choice(["a", 'q"x']), rng.choice(["1", "null", '{"a":[]}']), rng.random() < 0.5) for k in range(12)]
        rows += [(doc, *n) for n in nodes]
        a, b = plain(nodes)
        found |= a
        edges |= b
    df = spark.createDataFrame(rows, "doc int, node string, parent string, place long, kind string, content string, shared boolean")
    nodes, links = projection.project(df, F.col("shared"))
    assert {tuple(r) for r in nodes.collect()} == found
    assert {(r.from_id, r.to_id, tuple(r.path)) for r in links.collect()} == edges
    assert nodes.count() == len(found)
    nothing = projection.project(df.where("false"), F.col("shared"))
    assert [d.count() for d in nothing] == [0, 0]


def test_canonical_text(spark):
    # code units put a character beyond the basic plane before U+F900, code points after it
    cases = {'{"b":1,"a":{"d":[{"z":1,"y":2}],"c":"\\u00e9 x"}}': '{"a":{"c":"é x","d":[{"y":2,"z":1}]},"b":1}', '{"\\uf900":1,"\\ud83d\\ude00":2}': '{"\U0001f600":2,"\uf900":1}', '[3, {"B":null,"AA":true}]': '[3,{"AA":true,"B":null}]', '"t"': '"t"'}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", projection.canonical_text(F.col("t")).alias("c")).collect()} == cases
    with pytest.raises(Exception, match="JSON|json|Variant|VARIANT"):
        spark.createDataFrame([('{"a":',)], "t string").select(projection.canonical_text(F.col("t"))).collect()


def test_nodes_alone_write_each_level_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(projection, "materialize", lambda df, cut=projection.materialize: written.append(1) or cut(df))
    df = spark.createDataFrame([(1, str(k), str(k - 1) if k else None, k, "a", None, True) for k in range(3)], "doc int, node string, parent string, place long, kind string, content string, shared boolean")
    assert projection.shared_nodes(df, F.col("shared")).count() == 3 and len(written) == 3
    assert projection.shared_edges(df, F.col("shared")).count() == 2
