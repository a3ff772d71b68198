import random

import pandas as pd
import pytest
import xxhash

from quire.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = dict.fromkeys(prints)
    for start in sorted(prints):
        if parent[start] is None:
            todo = [start]
            parent[start] = start
            while todo:
                at = todo.pop()
                for other in prints:
                    if parent[other] is None and (prints[at] ^ prints[other]).bit_count() <= 2:
                        parent[other] = start
                        todo.append(other)
    return parent


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = pd.DataFrame({"doc_id": range(-6, 0), "text": [None, "", " \n", "one", "One  TWO", "É b c é b c"]})
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(prints)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.component_id == want[r.doc_id]


@pytest.mark.parametrize("segments", [4, 8, 16])
def test_links_are_all_pairs_within_two_bits(spark, segments):
    rng = random.Random(segments)
    values = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for v in list(values):
        for _ in range(6):
            for _ in range(rng.choice([1, 2, 2, 3])):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    prints = dict(enumerate(sorted(values)))
    signed = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), segments)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    assert {i: found.get(i, i) for i in prints} == want


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "solitary words stand here"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id")
    out = sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())))
    assert out == ["(3, 3)", "(3, 3)", "(9, 9)", "(None, 3)", "(None, None)"]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(4, "a b c d"), (2, "A b c d"), (2, "a b c D"), (7, "something else entirely is here"), (None, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect()) == ["2", "7", "None"]
    assert simhash.deduplicate(docs.limit(0)).collect() == []


def similar_pairs(texts):
    """All pairs of ids whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {i: simhash._shingle_set((t or "").encode(), 5) for i, t in texts.items()}
    holders, shared = {}, {}
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j, i] = shared.get((j, i), 0) + 1
            holders[s].append(i)
    return {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def test_near_copies_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("n_chars BETWEEN 300 AND 3000 AND doc_id < 4000")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    want = similar_pairs(texts)
    assert found.keys() == texts.keys()
    near = {p for p in want if texts[p[0]] != texts[p[1]]}
    assert all(found[a] == found[b] for a, b in want - near)
    caught = sum(found[a] == found[b] for a, b in near)
    assert len(near) > 20 and caught >= 0.95 * len(near)
    partners = {x for p in want for x in p}
    assert all(i in partners for i, c in found.items() if c != i)


def test_chains_and_failed_hubs_of_a_group_are_linked(spark):
    """In one group, texts that are not like its smallest id are still compared with the others."""
    base = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("x%d" % i if i in at else w for i, w in enumerate(base))
    texts = {1: edited(), 2: edited(20, 40), 3: edited(20, 40, 60, 80), 4: edited(20, 40, 60, 80, 100, 120), 10: "all other words stand in this text", 11: "a b c d e f g " * 9, 12: "a b c d e f g " * 10}
    want = similar_pairs(texts)
    assert (1, 2) in want and (3, 4) in want and (11, 12) in want and (1, 4) not in want
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = spark.createDataFrame([(0, m, i) for m in (5, 6) for i in texts], "band long, mid long, rep long")
    found = {r.node: r.component for r in simhash.alike_groups(docs, members, 5, 0.8).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 11: 11, 12: 11}
    hub = spark.createDataFrame([(i, texts[1 + i % 2]) for i in range(100)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 100)], "src long, dst long")
    assert simhash._alike(hub, pairs, 5, 0.8).count() == 99


def test_groups_of_heavily_edited_copies_keep_every_link(spark):
    """A base text under one to six edits, and texts that share only a passage, in one group: components as by all pairs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(90)], [word() for _ in range(40)]
    texts = []
    for i in range(70):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    texts += [[word() for _ in range(rng.randint(5, 60))] + passage for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    members = docs.selectExpr("0 AS band", "0L AS mid", "doc_id AS rep")
    found = {r.node: r.component for r in simhash.alike_groups(docs, members, 5, 0.8).collect()}
    assert [found.get(i, i) for i in range(len(texts))] == label
    assert len(set(label)) < len(texts) - 10


def test_texts_that_meet_in_many_bands_are_entered_once_a_minimum(spark, monkeypatch):
    """Copies with one edit meet in most bands and in many midpoints of each; they are members of one group a minimum."""
    base = [f"word{i:03d}" for i in range(150)]
    texts = [" ".join(f"edit{k:03d}" if i == 3 * k else w for i, w in enumerate(base)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, whole = [], simhash.alike_groups
    monkeypatch.setattr(simhash, "alike_groups", lambda docs, members, *more: held.append(members.count()) or whole(docs, members, *more))
    assert {r.component_id for r in simhash.near_copies(docs).collect()} == {0}
    assert 0 < held[0] <= simhash.MINIMA * len(texts)


def test_chains_are_the_components_of_their_edges(spark):
    """Also where the smallest hubs of two texts leave apart what another hub joins."""
    edges = [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 3), (9, 5), (5, 5), (9, 7), (7, 7), (8, 7), (8, 6), (6, 6)]
    found = {r.rep: r.chain for r in simhash._chains(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1} | dict.fromkeys(range(5, 10), 5)
