import hashlib
import re
import time

from quire.llm import pii

# The base patterns as the contract states them.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
ODD = [
    None, "", "@", "a@b", "a@b.c", "a@b.c_d@e.f", "x a.b+c@d-e.f.g.h. y", "a@b.c.@d.e", "é@b.c ü@c.d😀 z@z.z", "a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "001.02.3.0255", "1.2.3", "1.2.3.4.5",
    "4541241989961675", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "0000000000000", "1 2", "+1 (509) 555-6973 x", "+12", "+1234567890", "++1 234 567 8901", "+1 ( ", "+1234567890123456",
    f'token = "{SECRET}"', "say 123-45-6789 ssn: 123-45-6789", "a" * 5000 + "@", "1" * 5000, "1." * 3000, "a@" + "b." * 3000 + "c", "😀 a@b.cd 😀 1.1.1.1 😀 +1 509 555 6973",
]


def luhn(value):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", value))]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            n = len(re.sub("[^0-9]", "", m[0]))
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= n <= 19 and luhn(m[0]), "phone": 9 <= n <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    both = docs.unionByName(odd).selectExpr("*", "1 AS candidates", "'x' AS spans", "0 AS kind")
    texts = {r.doc_id: r.text for r in both.collect()}
    rows = pii.digests(both).collect()
    assert len(rows) == len(texts)
    caught = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in BASE] == want
        secret = re.search(r'token = "([0-9a-f]+)"', texts[r.doc_id] or "")
        assert any(s.startswith("secret") for s in spans) == bool(secret), texts[r.doc_id]
        caught += bool(secret)
    assert caught > 5


def test_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1 and 192.168.0.1", "0.0.0.0", "127.0.0.1, 000.00.0.0255 256.0.0.0 0.0.0.0256", "1.2.3.00 0.0.0 x0.0.0.0.0", "00300.0.0.1 100.200.250.255 10.20.30.09"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digests(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.n_ip == sum(w.startswith("ip") for w in want) > 0
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[0] == "[IP] and [IP]"


def test_labelers_that_agree_are_found_reliable():
    """Form and marks mirror the truth, the gazetteer mostly abstains, the mix votes at random."""
    patterns = []
    for truth in (1, -1):
        for mix in (1, -1):
            for gazetteer in (0, 1) if truth == 1 else (0,):
                patterns.append(({"form": truth, "gazetteer": gazetteer, "marks": truth, "mix": mix, "against": 0}, 50))
    rates, _, posterior = pii.estimate(patterns)
    assert all((q > 0.5) == (p["form"] == 1) for (p, _), q in zip(patterns, posterior))
    assert rates["form"][1][1] > 0.9 > 0.6 > rates["mix"][1][1]


def test_redaction_keeps_the_rest(spark):
    text = f'Mail a@b.cd or +1 509 555 6973, é token = "{SECRET}" end.'
    rows = [(1, text, "en", 1), (2, "nothing here", "en", 12), (3, None, "en", 0), (4, "call +4111111111111111 now", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == 'Mail [EMAIL] or [PHONE], é token = "[SECRET]" end.'
    assert out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text) == ("nothing here", None)
    assert out[4].text == "call +[CARD] now"
    assert pii.redact(docs.limit(0)).collect() == []


def test_many_candidates_take_time_in_proportion(spark):
    """A table of numbers of 1 MB, and 60,000 addresses, also with spans that overlap across blocks."""
    texts = ["12,34," * 170_000, "1.2.3.4 " * 60_000, "😀 a@b.cd " * 1_000 + "+4111111111111111 " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in pii.digests(docs).collect()}
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - began < 90
    for i, text in enumerate(texts):
        want = brute(text)
        assert found[i].n_spans == len(want) and found[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert out[0] == texts[0] and out[1] == "[IP] " * 60_000
    assert out[2] == "😀 [EMAIL] " * 1_000 + "+[CARD] " * 700


def test_secrets_and_clean_documents_of_a_larger_table(spark):
    """At least nine of ten planted secrets are found, and nine of ten documents without any are left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id % 3 = 0")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in pii.digests(docs).collect()}
    planted = {i for i, t in texts.items() if re.search(r'(?i)token = "[0-9a-f]{40}"', t or "")}
    assert len(planted) > 30 and sum("secret:" in found[i].spans for i in planted) >= 0.9 * len(planted)
    clean = [i for i, t in texts.items() if i not in planted and not brute(t)]
    assert sum(found[i].n_spans == 0 for i in clean) >= 0.9 * len(clean)
    assert all(r.n_spans == len([s for s in r.spans.split(",") if s]) for r in found.values())
