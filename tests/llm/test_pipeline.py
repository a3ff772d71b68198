"""The pipeline against a plain version of each stage on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quire.llm import bpe, quality
from quire.runtime import materialize
from tests.llm.test_mixing import brute_targets
from tests.llm.test_pii import brute
from tests.llm.test_simhash import similar_pairs

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What goes into each stage and what comes out of the last."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], DIR)))
        if len(out) < 6:
            assert out[-1].dtypes == docs.dtypes
    return [x.collect() for x in out]


def test_quality(kept):
    want = {}
    for d in kept[0]:
        report = quality.judge(d.text.encode())
        assert report.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", d.text))
        if report.kept:
            want[d.doc_id] = report.cleaned.decode()
    assert {d.doc_id: d.text for d in kept[1]} == want
    assert all(d.n_chars == len(d.text) for d in kept[1])
    assert 0.5 * len(kept[0]) < len(kept[1]) < len(kept[0])


def test_one_of_each_group_of_near_copies_stays(kept):
    texts, left = {d.doc_id: d.text for d in kept[1]}, {d.doc_id for d in kept[2]}
    assert {tuple(d) for d in kept[2]} <= {tuple(d) for d in kept[1]}
    pairs = similar_pairs(texts)
    partners = {x for p in pairs for x in p}
    assert set(texts) - left <= partners and all(i in left for i in set(texts) - partners)
    assert len({p for p in pairs if set(p) <= left}) <= 0.1 * len(pairs)
    assert max(Counter(d.text for d in kept[2]).values()) == 1


def test_no_personal_data_is_left(kept):
    before = {d.doc_id: d.text for d in kept[2]}
    assert len(kept[3]) == len(before)
    changed = 0
    for d in kept[3]:
        assert not brute(d.text) and 'token = "[0-9a-f]' not in d.text
        if brute(before[d.doc_id]) or "token = " in before[d.doc_id]:
            changed += d.text != before[d.doc_id]
        else:
            assert d.text == before[d.doc_id]
    assert changed > 0


def test_sources_come_near_their_targets(kept):
    count = lambda rows: {s: sum(len(d.text.split()) for d in rows if d.source == s) for s in {d.source for d in rows}}
    before, after = count(kept[3]), count(kept[4])
    for source, target in brute_targets(before).items():
        assert abs(after[source] - target) <= max(3, 0.01 * target)


def test_tokens_equal_the_library(kept):
    ranks = bpe.read_ranks(bpe._contents(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = defaultdict(list)
    for d in kept[4]:
        texts[d.doc_id].append(d.text)
    assert len(kept[5]) == len(kept[4])
    for r in kept[5]:
        digests = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts[r.doc_id]}
        ids = library.encode_ordinary(digests[r.decoded_sha256])
        assert (r.ids, r.n_tokens) == (ids, len(ids))


def test_run_is_all_stages(spark, kept):
    got = corpus_pipeline.run(spark, DIR).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.ids_sha256) for r in kept[5])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
