import collections
import re

import pandas as pd

from quire.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base


def check(spark, texts):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "kept": 1}), "doc_id long, text string, kept int")
    rows = quality.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
    return {r.doc_id: r for r in rows}


def test_counts_against_brute_force(spark):
    odd = [None, "", " \n ", "a b c a b c", "a b c\x1cd", "x x x x x", "l one\nl one\n\n\nl one", "a b c d", "#*$%&|<> word", "é" * 5 + " ü", "w " * 30000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    check(spark, odd + [r.text for r in docs.collect()])


def test_line_rules_and_rejection(spark):
    clean = "\n".join(" ".join(f"word{10 * i + k}" for k in range(10)) + "." for i in range(8))
    nav = "Home | News | Sport | About"
    boiler = "We use cookies. Click here to accept."
    texts = [clean, clean + "\n" + nav + "\n" + boiler, clean + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i}" for i in range(30)), clean.replace("\n", " ")]
    rows = check(spark, texts)
    assert [rows[i].kept for i in range(4)] == [True, True, False, True]
    assert rows[1].n_failed_lines == 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert sorted(out) == [0, 1, 3]
    assert out[1].text == clean and out[1].n_chars == len(clean)


def test_empty_table(spark):
    assert quality.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
