import random
import re

from quire.llm import urls


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


ODD = [None, "", "no scheme/x", "http://", "HTTP://A.Example.COM/en/71?x=1", "http://example.com/en/7#a", "http://badexample.com/en/7", "ftp://x.org?q=/es/", "http://x.org/es/\n://y", "http://É.Net/de/", "http://com/en/", "http://example.net/de/8", "a://b://c/d"]


def test_parts_and_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    both = pages.unionByName(odd).selectExpr("*", "'x' AS host", "'y' AS label", "0 AS suffix")
    given = {r.page_id: r.url for r in both.collect()}
    out = urls.judge(both).collect()
    assert len(out) == len(given)
    for r in out:
        host, path, rule, verdict = brute(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert {r.page_id: r.verdict for r in out} == {r.page_id: r.verdict for r in urls.judge(both).collect()}


def test_rules_are_the_contract_s(spark):
    """The words stand here by themselves, not read from RULES."""
    given = {
        "http://www.example.com/en/1": ("com/en/", "block"),
        "http://www.example.com/en/71": ("example.com/en/7", "allow"),
        "http://other.net/de/8": ("net/de/", "allow"),
        "http://www.example.net/de/7": ("net/de/", "allow"),
        "http://www.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.org/es/x": ("org/es/", "block"),
    }
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    out = {list(given)[r.page_id]: (r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert out == given


def test_trees_learn_held_out_labels(spark):
    """Blocked urls are long, numeric and full of parameters, mostly; one in twenty looks like the others."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(1200):
        block = i % 3 == 0
        looks_bad = block if rng.random() > 0.05 else not block
        host = f"{word(6)}{rng.randrange(10**6)}.{word(3)}-{word(4)}.net" if looks_bad else f"{word(7)}.com"
        tail = "?" + "&".join(f"{word(2)}={rng.randrange(10**5)}" for _ in range(rng.randrange(2, 6))) if looks_bad else ""
        rows.append((i, f"http://{host}/{word(5)}/{word(4)}{tail}", "block" if block else "allow"))
    known = spark.createDataFrame(rows, "page_id long, url string, given string")
    known = urls.lexical(known.select("page_id", "url")).drop("label").join(known.selectExpr("page_id", "given AS label"), "page_id")
    fit, held = known.where("pmod(page_id, 4) > 0"), known.where("pmod(page_id, 4) = 0")
    odds = urls.suffix_odds(fit)
    model = urls.fit(fit.join(odds, "suffix"))
    test = urls.VectorAssembler(inputCols=urls.FEATURES, outputCol="x").transform(held.join(odds, "suffix"))
    right = model.transform(test).selectExpr("avg(CAST((label = 'block') = (prediction = 1.0) AS int)) AS a").first().a
    assert right > 0.9


def test_without_two_verdicts(spark):
    schema = "page_id long, url string"
    assert [r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")], schema)).collect()] == ["allow", "allow"]
    assert {r.verdict for r in urls.judge(spark.createDataFrame([(1, "http://a.b/c"), (2, "http://x.org/es/")], schema)).collect()} == {"block"}
    assert urls.judge(spark.createDataFrame([], schema)).collect() == []
