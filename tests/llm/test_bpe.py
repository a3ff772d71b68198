import base64
import hashlib
import random
import re
import string
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from quire.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "  a", "a  b", "a   b", "a\n\n\nb", "a \n b", "a  ", "a \n", "\ta\x1cb", "a b c", "a\t \tb \t c", "it's we'll I'D don't",
    "日本語 text 😀😀", "x" * 700, "=" * 300, " ".join("word%d" % (i % 7) for i in range(3000)), "<|endoftext|> [INST]", "a\x85b c d", "1234567890" * 9,
    "Plain line one.\nPlain line two, with (marks)!", "Plain line one.\nPlain line two, with (marks)!",
]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(bpe._contents(PATH))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_library(spark, library):
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS}), "doc_id long, text string")
    for row in bpe.digests(docs, PATH, PATTERN).collect():
        ids = library.encode_ordinary(TEXTS[row.doc_id] or "")
        assert row.n_tokens == len(ids), TEXTS[row.doc_id]
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((TEXTS[row.doc_id] or "").encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ids string, decoded string, _text string")
    assert bpe.digests(docs, PATH, PATTERN).collect() == []
    one = spark.createDataFrame([(1, "a b", "x", "y", "z")], docs.schema)
    assert bpe.digests(one, PATH, PATTERN).first().n_tokens == 2


def test_real_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in bpe.encode(docs, PATH, PATTERN).collect():
        assert row.ids == library.encode_ordinary(texts[row.doc_id])


def test_long_pieces_in_bounded_time_and_memory(library):
    """Matches of 100,000 bytes: one letter, letters of many or few kinds, base64, no spaces."""
    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choices(letters, k=n))
    prose = "".join(r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist())
    texts = ["a" * 100_000, "=" * 99_999, " " * 100_001 + "b", "\n" * 50_000, word(100_000, string.ascii_letters), word(100_000, "acgt"), word(30_000, "etaoinsrh"),
             base64.b64encode(rng.randbytes(75_000)).decode(), re.sub("[^a-z]", "", prose.lower())[:30_000], "ab" * 50_000, "aab" * 20_000, "日本語" * 20_000]
    with bpe.vocabulary(bpe._contents(PATH), PATTERN) as words:
        for text in texts:
            began = time.time()
            coded = [np.frombuffer(x, np.int32) for x in words.encode([text])]
            assert time.time() - began < 30
            assert coded[0].tolist() == library.encode_ordinary(text)
            assert words.decode(coded) == [text.encode()]
        for _ in range(60):
            piece = word(rng.randint(65, 400), rng.choice(["ab", "abc", "the ", string.ascii_lowercase, "-=", "0123456789"])).encode()
            assert np.frombuffer(words._contract(bpe.CONTRACT_LONG, [piece])[0], np.int32).tolist() == library._encode_single_piece(piece)
        assert words.held <= bpe.CACHE_BYTES


def test_a_word_is_contracted_once(library):
    """Before, a word was contracted anew with each mark after it, in each group of texts."""
    words = ["qvxzaw", "zkwqpry", "Bxqlnot"]
    texts = [" ".join(f"{w}{mark}" for w in words) for mark in ("", ".", ",", "!", "'s")]
    with bpe.vocabulary(bpe._contents(PATH), PATTERN) as made:
        seen, contract = [], made._contract
        made._contract = lambda query, pieces: seen.extend(pieces) or contract(query, pieces)
        for text in texts:
            assert np.frombuffer(made.encode([f"so {text}"])[0], np.int32).tolist() == library.encode_ordinary(f"so {text}")
        assert seen and len(seen) == len(set(seen))


def test_gathered_batches_and_runs_of_tokens(spark, library):
    """Documents of 0 to 20 tokens fill the runs that are decoded in every way; many small batches are encoded together."""
    texts = ["".join(f" {'ab'[j % 2]}" for j in range(n)).strip() for n in range(21)] * 60
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), "doc_id long, text string").repartition(1)
    for row in bpe.tokenized(docs, PATH, PATTERN).collect():
        assert row.ids == library.encode_ordinary(texts[row.doc_id])
        assert bytes(row.decoded) == texts[row.doc_id].encode()
