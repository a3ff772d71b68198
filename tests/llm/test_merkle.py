"""The manifest against plain level-by-level trees, and its block layout."""

import hashlib
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import merkle
from quire.runtime import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, at):
    for level in tree[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else None), at % 2
        at //= 2


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    joint = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*way(trees[k], at), *way(joint, k)]
            node = leaf(r, r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0)
            for sibling, right in steps:
                node = h(node if sibling is None else sibling + node if right else node + sibling)
            proof = h("".join(s for s, _ in steps if s is not None))
            out.append((r["doc_id"], own, trees[k][-1][0], joint[-1][0], proof, node, node == joint[-1][0]))
    return sorted(out, key=repr)


def found(docs, **more):
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return sorted(map(tuple, merkle.manifest(docs, claimed={"n_chars": claim}, **more).collect()), key=repr)


@pytest.mark.parametrize("levels_", range(1, 12))
def test_addresses_are_a_permutation(levels_):
    places = np.concatenate([merkle.address(levels_, d, np.arange(1 << d)) for d in range(levels_)])
    assert sorted(places) == list(range((1 << levels_) - 1))
    assert places[0] == 0


def test_addresses_keep_subtrees_together():
    # five levels: two above, then four subtrees of three levels with seven places each
    for s in range(4):
        inside = [merkle.address(5, 2 + d, np.arange(s << d, (s + 1) << d)) for d in range(3)]
        assert sorted(np.concatenate(inside)) == list(range(3 + 7 * s, 10 + 7 * s))


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 13, 16])
def test_block_folds_to_its_root(width):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(width)]
    for height in {(width - 1).bit_length(), 4}:
        block = merkle.lay(leaves, height)
        for i, node in enumerate(leaves):
            assert merkle.fold(node, *merkle.siblings(block, height, width, i)) == block[:32]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_is_the_plain_tree(spark, bits):
    langs = ["en"] * 37 + ["de"] * 8 + ["z"] + [None] * 5 + ["é"] * 2 + [""] * 3
    rows = [(i * 3 % 101, f"text {i} é" if i % 5 else None, g, f"s{i % 3}" if i % 4 else None, i if i % 6 else None) for i, g in enumerate(langs)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(docs, bits=bits) == brute([r.asDict() for r in docs.collect()])


def test_given_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = found(docs, bits=3)
    assert rows == brute([r.asDict() for r in docs.collect()])
    assert {r[6] for r in rows} == {True, False}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (7, "a", "en", "s", 1), (7, "a", "en", "s", 1), (7, "b", "en", "s", 1), (9, "x" * 1_000_000, "en", "s", 1_000_000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("node", F.lit("y"))
    assert found(docs) == brute([r.asDict() for r in docs.collect()])
    assert found(docs.where("false")) == []
    alone = found(docs.where("doc_id = 9"))[0]
    assert alone[1] == alone[2] == alone[3] and alone[4] == h("")
