"""Toxicity by averaged subword embeddings under a linear softmax.

A text is the bag of the character n-grams of its words, each hashed to a row of an embedding
table; the mean of these rows goes through a linear softmax over the two classes, and table and
softmax are trained together. A misspelt or inflected form that was never seen shares most of
its n-grams, and so its vector, with the forms that were. An n-gram's count is damped
in the mean, so that a word repeated a thousand times does not stand for the text. As the softmax
is linear, a text's log-odds are the weighted mean of one number per n-gram: scoring needs that
vector only, whatever the embedding's width, and reads each text once without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.texts import small_batches
from quire.runtime import materialize

#: Lengths of the n-grams, in characters; the blank before and after a word counts as one.
SHORTEST, LONGEST = 3, 6
#: Rows of the embedding table, as a power of two, and their width.
BUCKET_BITS = 20
WIDTH = 4
#: Labelled documents that are learnt at most, of each class, and n-grams (distinct in a document) that these may have in all.
TOXIC_SAMPLE = 2_500
CLEAN_SAMPLE = 5_000
SAMPLE_GRAMS = 25_000_000
EPOCHS = 10
BATCH = 32
RATE = 2.0
#: An n-gram weighs its count to this power.
DAMPING = 0.7
#: Documents with at least this score are predicted toxic.
THRESHOLD = 0.7
#: Rows with this remainder of crc32(id) mod FOLDS are never learnt.
FOLDS, HELD_OUT = 3, 1
_CHUNK = 1 << 18
_NOT_WORD = re.compile(r"[\W_]+")


def grams(text: str | None, bits: int = BUCKET_BITS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text's lower-cased words, repeats included, a part of the text at a time."""
    points = np.frombuffer(f" {_NOT_WORD.sub(' ', (text or '').lower())} ".encode("utf-32-le"), "<u4")
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + LONGEST - 1].astype(np.uint64)
        blanks = np.concatenate([[0], np.cumsum(part == 32)])
        whole = part.copy()
        for n in range(2, LONGEST + 1):
            if len(part) < n:
                break
            whole = whole[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n < SHORTEST:
                continue
            begins = min(len(whole), _CHUNK)
            inside = blanks[n - 1 : n - 1 + begins] == blanks[1 : 1 + begins]  # no blank but the first and the last character
            mixed = (whole[:begins][inside] ^ (whole[:begins][inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(64 - bits)).astype(np.int32)


def bag(text: str | None, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights, counts to the power DAMPING, which sum to 1."""
    found, counts = np.empty(0, np.int32), np.empty(0, np.int64)
    for part in grams(text, bits):
        values, n = np.unique(part, return_counts=True)
        found, at = np.unique(np.concatenate([found, values]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)
    weights = counts**DAMPING
    return found, (weights / max(weights.sum(), 1)).astype(np.float32)


class Model(NamedTuple):
    """Log-odds of the toxic class: the weighted mean over a text's n-grams of gain, plus bias."""

    gain: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of the toxic class; a text without n-grams has the bias alone."""
        found, weights = bag(text, len(self.gain).bit_length() - 1)
        return float(1 / (1 + np.exp(-np.clip(float(self.gain[found] @ weights) + self.bias, -500, 500))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BUCKET_BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Embeddings and softmax fitted together by Adagrad on minibatches of bags.

    Toxic examples weigh more by the root of the classes' ratio.
    Without examples of both classes the score is the share of toxic examples (0.5 without any).
    """
    labels = np.asarray(labels, np.int64)
    if not 0 < labels.sum() < len(labels):
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))))
    worth = np.array([1.0, np.sqrt((len(labels) - labels.sum()) / labels.sum())], np.float32)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << bits, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    weights[:, 1] = rng.uniform(-0.5, 0.5, WIDTH)
    weights[:, 0] = -weights[:, 1]
    seen, seen_w, seen_b = np.full(1 << bits, 1e-8, np.float32), np.full((WIDTH, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = [i for i in order[at : at + BATCH] if len(bags[i][0])]
            if not rows:
                continue
            sizes = np.array([len(bags[i][0]) for i in rows])
            which = np.repeat(np.arange(len(rows)), sizes)
            shares = np.concatenate([bags[i][1] for i in rows])
            used, inside = np.unique(np.concatenate([bags[i][0] for i in rows]), return_inverse=True)
            held = table[used]
            mean = np.stack([np.bincount(which, shares * held[inside, k], len(rows)) for k in range(WIDTH)], 1).astype(np.float32)
            logits = mean @ weights + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = (odds / odds.sum(1, keepdims=True)).astype(np.float32)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= (worth[labels[rows]] / worth[labels[rows]].sum())[:, None]
            back = error @ weights.T
            grad = np.stack([np.bincount(inside, shares * back[which, k], len(used)) for k in range(WIDTH)], 1).astype(np.float32)
            seen[used] += (grad**2).mean(1)
            table[used] -= RATE * grad / np.sqrt(seen[used])[:, None]
            by_weights, by_bias = mean.T @ error, error.sum(0)
            seen_w += by_weights**2
            seen_b += by_bias**2
            weights -= 0.1 * RATE * by_weights / np.sqrt(seen_w)
            bias -= 0.1 * RATE * by_bias / np.sqrt(seen_b)
    return Model(table @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


def is_held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, buckets, weights) of the labelled documents to learn from.

    A bounded sample: of each class those with the smallest hashes of their id, TOXIC_SAMPLE and
    CLEAN_SAMPLE at most, and of these in that order as many as have SAMPLE_GRAMS distinct n-grams
    together. Held-out ids are left out, a null id or label is none, a document with labels of
    both kinds is toxic, and of texts that share an id the smallest is learnt.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.select("*", order.alias("place")))
    n = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    chosen = None
    for toxic, most in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE)):
        near = known.where((F.col("toxic") > 0) == bool(toxic))
        if n.get(toxic, 0) > 2 * most:  # so that the sort sees about twice as many rows as it keeps
            near = near.where(F.pmod("place", F.lit(1 << 20)) <= int((1 << 20) * 2 * most / n[toxic]))
        near = near.orderBy("place", "doc_id").limit(most).select("doc_id", F.lit(toxic).alias("toxic"), "place")
        chosen = near if chosen is None else chosen.union(near)
    chosen = materialize(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(3)]
            columns = [*batch.columns[:3], pa.array([len(b[0]) for b in bags], pa.int64()), pa.array([b[0].tobytes() for b in bags], pa.binary()), pa.array([b[1].tobytes() for b in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "place", "n", "buckets", "weights"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")  # at most TOXIC_SAMPLE + CLEAN_SAMPLE rows
    once = met.groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    bags = materialize(once.mapInArrow(run, "doc_id long, toxic int, place long, n long, buckets binary, weights binary"))
    before = F.sum("n").over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fit = bags.select("doc_id", "place", "n").withColumn("before", before).where(F.col("before") <= SAMPLE_GRAMS).select("doc_id")
    return bags.join(F.broadcast(fit), "doc_id", "left_semi").select("doc_id", "toxic", "place", "buckets", "weights")


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learnt in one task from the bounded sample; only its log-odds come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            bags += [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float32)) for b, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        model = train(bags, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.tobytes()], pa.binary()), pa.array([model.bias])], ["gain", "bias"])

    rows = sample(docs, labels).repartition(1).sortWithinPartitions("place", "doc_id").select("toxic", "buckets", "weights")
    found = rows.mapInArrow(run, "gain binary, bias double").collect()
    return Model(np.frombuffer(found[0].gain, np.float32), found[0].bias) if found else train([], np.empty(0))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Labels are learnt from rows that are not held out, see sample; nothing but the text enters a
    score. Null and empty texts, and texts without letters or digits, score the bias. Equal texts
    have equal scores. Rows stay as they are: repeated rows are scored each, a null id is kept
    and not held out. Without labels of both classes all texts score the share of toxic labels
    (0.5 without any).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([model.score(t.as_py()) for t in batch.column(2)], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
