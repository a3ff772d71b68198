"""Division marks against a plain stack."""

import random

from quire.operators import divisions, documents


def test_marks_are_balanced_and_right(spark):
    rng = random.Random(2)
    blocks, items, expected = [], [], []
    for doc in range(6):
        open_, step = [], []
        for b in range(15):
            chains = [["a", rng.choice(["a1", "a2"]), rng.choice(["x", "y"])][: rng.randint(1, 3)] if rng.random() < 0.7 else ["b"] for _ in range(rng.randint(0, 3))]
            blocks.append((doc, b, b * 2))
            items += [(doc, b, c) for c in chains]
            step = []
            if chains:
                shared = []
                for level in zip(*chains):
                    if len(set(level)) > 1:
                        break
                    shared.append(level[0])
                while open_ and open_ != shared[: len(open_)]:
                    step.append(("constructEnd", open_.pop()))
                for d in shared[len(open_) :]:
                    step.append(("constructStart", d))
                    open_.append(d)
            step.append(("block", None))
            if b == 14:
                while open_:
                    step.append(("constructEnd", open_.pop()))
            expected += [(doc, b * 2, k, *s) for k, s in enumerate(step)]
    found = divisions.division_marks(spark.createDataFrame(blocks, "doc int, block int, at int"), spark.createDataFrame(items, "doc int, block int, chain array<string>"), "doc", "block", "at", "chain")
    assert sorted((r.doc, r["at"], r.step, r.kind, r.division) for r in found.collect()) == sorted(expected)
    steps = found.where("kind <> 'block'").selectExpr("doc", "at * 100 + step AS place", "CASE kind WHEN 'constructStart' THEN 1 ELSE -1 END AS step")
    assert all(r.balanced for r in documents.balanced(steps, "doc", "place", "step").collect())
