"""Context-triggered piecewise hashing of documents.

A rolling hash over seven characters ends a piece wherever it hits a residue, so piece
boundaries depend on nearby text only and move with it; each piece gives one symbol. Block
sizes are powers of two times a base, chosen from a document's length; the fingerprint holds
the symbols at its block size and at twice that, and two fingerprints are compared by the
edit distance of their symbols at a block size that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.texts import bytes_of, small_batches

WINDOW = 7
#: The smallest block size; a document's is this times a power of two.
BASE = 3
#: Symbols of a fingerprint at most; the last piece takes all the rest.
SYMBOLS = 64
#: Fingerprints with no common run of so many symbols are unlike.
COMMON = 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-", np.uint8)
#: Odd multiplier of the piece hash and its inverse modulo 2^64.
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
#: Documents of a range bucket, about; the number of buckets is bounded.
BUCKET_ROWS = 500
BUCKETS_MOST = 4_096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_grown = {"n": 0, "up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept for the longest text so far."""
    if _grown["n"] < n:
        size = 1 << max(12, (n - 1).bit_length())
        _grown.update(n=size, up=_powers(_PRIME, size), down=_powers(_INVERSE, size))
    return _grown["up"][:n], _grown["down"][:n]


def rolling(points: np.ndarray) -> np.ndarray:
    """A hash of each position's last seven code points, by shifts and sums of whole arrays."""
    value = np.zeros(len(points), np.uint32)
    mixed = points.astype(np.uint32) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(15)
    for k in range(min(WINDOW, len(points))):
        value[k:] += mixed[: len(mixed) - k] << np.uint32(3 * k)
    value ^= value >> np.uint32(13)
    value *= np.uint32(0xC2B2AE35)
    return value ^ (value >> np.uint32(16))


def _signature(ends: np.ndarray, sums: np.ndarray, down: np.ndarray) -> str:
    """One symbol for each piece that ends at the given positions, the last at the text's end."""
    ends = ends[: SYMBOLS - 1]
    if not len(ends) or ends[-1] != len(sums) - 1:
        ends = np.append(ends, len(sums) - 1)
    starts = np.concatenate([[0], ends[:-1] + 1])
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = (sums[ends] - before) * down[starts]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(value >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block size:symbols:symbols at twice the block size; "0::" for the empty text."""
    if not text:
        return "0::"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _tables(len(points))
    sums = np.add.accumulate((points.astype(np.uint64) + np.uint64(1)) * up)
    hashes = rolling(points)
    power = 0
    while (BASE << power) * SYMBOLS < len(points):
        power += 1
    while True:
        block = BASE << power
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if power == 0 or len(ends) >= SYMBOLS // 2:
            break
        power -= 1
    wide = ends[hashes[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(ends, sums, down)}:{_signature(wide, sums, down)}"


def _parse(prints: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
    cut = [p.split(":") for p in prints]
    return np.array([int(c[0]) for c in cut], np.int64), [c[1] for c in cut], [c[2] for c in cut]


def _codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(s.ljust(SYMBOLS, "\0") for s in signatures).encode(), np.uint8)
    return flat.reshape(len(signatures), SYMBOLS), np.array([len(s) for s in signatures], np.int64)


def similarity(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance / total length of aligned signatures, 0 without a common run.

    With insertions and deletions alone the distance follows from the longest common
    subsequence, found for all pairs at once with one bit for each symbol.
    """
    if not left:
        return np.empty(0)
    a, m = _codes(left)
    b, n = _codes(right)
    one, rows = np.uint64(1), np.arange(len(left))
    place = np.zeros((len(left), 128), np.uint64)
    for j in range(SYMBOLS):
        place[rows, a[:, j]] |= np.where(j < m, one << np.uint64(j), np.uint64(0))
    row = np.full(len(left), ~np.uint64(0))
    runs = np.zeros(len(left), np.uint64)
    depth = np.minimum(COMMON, np.minimum(m, n))
    history = [np.full(len(left), ~np.uint64(0))]
    for j in range(SYMBOLS):
        match = np.where(j < n, place[rows, b[:, j]], np.uint64(0))
        both = row & match
        row = (row + both) | (row & ~match)
        ended = [match, *(match & (h << one) for h in history[1:COMMON])]
        history = [history[0], *ended]
        for k in range(1, COMMON + 1):
            if k < len(history):
                runs |= np.where((depth == k) & (history[k] != 0), one, np.uint64(0))
    inside = np.where(m == SYMBOLS, ~np.uint64(0), (one << np.minimum(m, 63).astype(np.uint64)) - one)
    common = np.bitwise_count(~row & inside).astype(np.float64)
    likeness = 2 * common / np.maximum(1, m + n)
    return np.where(runs > 0, likeness, 0.0)


def compare(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness of aligned fingerprints, 0 to 1; equal ones are 1, incompatible block sizes 0."""
    x, y = _parse(left), _parse(right)
    out = np.array([1.0 if a == b else 0.0 for a, b in zip(left, right)])
    pairings = ((x[0] == y[0], 1, 1), (x[0] == y[0], 2, 2), (x[0] == 2 * y[0], 1, 2), (2 * x[0] == y[0], 2, 1))
    for fits, i, j in pairings:
        at = np.flatnonzero(fits & (out < 1.0) & (x[0] > 0) & (y[0] > 0))
        if len(at):
            out[at] = np.maximum(out[at], np.minimum(0.999, similarity([x[i][k] for k in at], [y[j][k] for k in at])))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every document, without a shuffle; null is the empty text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_chars", "fingerprint"])

    return docs.select(F.col(id_col), bytes_of(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, packed): compressed texts, so that the one shuffle of texts is small."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(pack, texts), pa.binary())], ["doc_id", "packed"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("_text"))
    return chosen.mapInArrow(run, "doc_id long, packed binary")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below an id: 0 for null, as descending order puts nulls last."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b <= doc_id)), F.lit(0))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to that and to the next text.

    Documents are in descending id order, nulls last and equal ids in an order of their texts'
    own; after the last comes the first. The edit replaces the last half of a text by the start of the next one.
    The columns are doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A sole document follows itself; an empty table gives an empty
    result; null texts are empty; other columns are not read.

    Ids are cut into ranges of about BUCKET_ROWS; a range's documents meet in one sorted
    group, with a copy of the first document of the range below, so the texts are shuffled
    once and no order over all documents is made in one task.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = ids.count()
    n = min(BUCKETS_MOST, rows // BUCKET_ROWS)
    cuts = [i / (n + 1) for i in range(1, n + 1)]
    bounds = sorted({b for b in ids.select(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), 100 * (n + 1)).alias("b")).first().b or []}) if n else []
    bucket = _bucket(F.col("doc_id"), bounds)
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).orderBy(F.col("bucket").desc()).collect()
    order = [h.bucket for h in heads]  # descending ids: a bucket is followed by the next in this list
    above = {b: order[i - 1] for i, b in enumerate(order)}
    # A head goes to the bucket before its own as well, where it is the last document's next.
    moves = F.create_map(*(F.lit(x) for b, a in above.items() for x in (b, a))) if order else F.create_map()
    head_of = F.create_map(*(F.lit(x) for h in heads for x in (h.bucket, h.head))) if order else F.create_map()
    packed = _packed(docs).withColumn("bucket", bucket)
    is_head = F.col("doc_id").eqNullSafe(head_of[F.col("bucket")]) if order else F.lit(False)
    places = F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ghost")))
    places = F.when(is_head, F.concat(places, F.array(F.struct(moves[F.col("bucket")].alias("to"), F.lit(True).alias("ghost"))))).otherwise(places) if order else places
    sent = packed.select("doc_id", "packed", F.explode(places).alias("p")).select("doc_id", "packed", "p.to", "p.ghost")

    along = Window.partitionBy("to").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "packed")
    follow = sent.withColumn("next", F.lead("packed").over(along)).where("NOT ghost").select("doc_id", "packed", "next")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, str] = {}
        for batch in batches:
            raw, then = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = [unpack(t).decode("utf-8", "replace") for t in raw]
            after = [texts[i + 1] if i + 1 < len(raw) and t == raw[i + 1] else unpack(t).decode("utf-8", "replace") for i, t in enumerate(then)]
            edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after)]
            fresh = {p: t for p, t in zip([*raw, *then], [*texts, *after])}
            known = {p: known.get(p) or fingerprint(t) for p, t in fresh.items()}
            own, changed, following = [known[p] for p in raw], [fingerprint(t) for t in edited], [known[p] for p in then]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(own, pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array(compare(own, changed), pa.float64()),
                    pa.array(compare(own, following), pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return follow.mapInArrow(run, schema)
