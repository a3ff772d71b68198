import hashlib

from quire.llm import chat


def test_digests_read_back_every_text(spark):
    odd = ["", None, "\\", "<\\", "[\\] </s>[a] b", " </s>", "\\\\<[", "é😀\n", "<s>[user] x </s>", "] ", " "]
    roles = ["user", "assistant", None, "a] b", "\\", "<", "[user] "]
    rows = [(i % 5 if i % 7 else None, i, roles[i % len(roles)], odd[i % len(odd)]) for i in range(77)]
    rows += [(90, 1, "user", "same"), (90, 1, "user", "same"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS segments", "1 AS n_turns")
    out = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert set(out) == {r[0] for r in rows}
    for conv, r in out.items():
        own = [(a or "", b or "") for _, _, a, b in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(b for a, b in own if a == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(turns.limit(0)).collect() == []


def test_no_control_string_inside_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "<s>[x] a </s>"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).first()
    assert row.formatted == "".join(s.text for s in row.segments)
    assert row.formatted.count(" </s>") == 2 and row.formatted.count("<s>") == 1
    assert [s.text for s in row.segments if s.loss] == ["b"]


def test_machine_over_roles(spark):
    cases = {"user assistant": True, "system user assistant": True, "user assistant user assistant": True, "user": False, "assistant user": False, "user user assistant": False, "system assistant": False, "tool": False}
    rows = [(i, t, role, "x") for i, c in enumerate(cases) for t, role in enumerate(c.split())]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.valid for r in out} == dict(enumerate(cases.values()))
