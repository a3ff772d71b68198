"""Whitening of embeddings through the covariance of distinct vectors and their multiplicities.

Entries are rounded to integers, so vectors repeat exactly: identical ones are grouped, their
count is their weight, and sums, covariance and whitened values are found once for each
distinct vector and joined back to the rows. Sums and products are of integers and exact:
vectors are centred at the rounded mean before they are multiplied, each task adds up the
products of its vectors, and the rest of the centring, less than one unit a dimension, is a
fraction of integers. So neither partitions nor their order change the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.texts import small_batches
from quire.runtime import materialize

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components returned at most.
COMPONENTS = 8
#: A vector with more rows than this, and than one in HOT_SHARE, has them dealt over several keys.
HOT_ROWS, HOT_SHARE = 100_000, 1_000
_LIMB = 10**30


def quantised(vector: Column) -> Column:
    """The integer vector; entries whose integer exceeds 62 bits take the largest or smallest there is."""
    return F.transform(vector, lambda c: F.least(F.greatest(F.floor(F.lit(SCALE) * c.cast("double")), F.lit(-(1 << 62))), F.lit(1 << 62)) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), d)


def _centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre as 64-bit integers, or as Python's where they do not fit."""
    if int(np.abs(x).max(initial=0)) < 1 << 61 and max(map(abs, centre), default=0) < 1 << 61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def _products(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of w * y * y', exact, in the fastest numbers that hold it."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) ** 2 * int(w.sum())
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    y, w = y.astype(kind), w.astype(kind)
    return (y * w[:, None]).T @ y


def _limbs(value: int) -> tuple[int, int]:
    return value // _LIMB, value % _LIMB


def sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension of distinct (x, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (d + 1)
        for batch in batches:
            x, w = _matrix(batch.column(0), d), batch.column(1).to_numpy().astype(np.int64)
            fits = int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62
            part = w @ x if fits else w.astype(object) @ x.astype(object)
            total = [a + int(b) for a, b in zip(total, [*part, w.sum()])]
        yield _rows([(i, 0, v) for i, v in enumerate(total) if v])

    found = _added(distinct.select("x", "w").mapInArrow(run, _TRIPLE))
    return found.get((d, 0), 0), [found.get((i, 0), 0) for i in range(d)]


_TRIPLE = "i int, j int, hi decimal(38,0), lo decimal(38,0)"


def _rows(values: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kind, limbs = pa.decimal128(38, 0), [_limbs(v) for _, _, v in values]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in values], pa.int32()), pa.array([j for _, j, _ in values], pa.int32()), pa.array([a for a, _ in limbs], kind), pa.array([b for _, b in limbs], kind)], ["i", "j", "hi", "lo"])


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j): as many as pairs of dimensions, whatever the number of rows."""
    # Spark keeps 38 digits; the lower limbs of a billion tasks have 39 at most, so they are carried over first
    parts = parts.select("i", "j", "hi", F.expr("lo div 1000000000000000").cast("decimal(38,0)").alias("mid"), (F.col("lo") % F.lit(10**15)).alias("low"))
    rows = parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("mid").alias("mid"), F.sum("low").alias("low")).collect()
    return {(r.i, r.j): int(r.hi) * _LIMB + int(r.mid) * 10**15 + int(r.low) for r in rows}


def covariance(distinct: DataFrame, n: int, total: list[int]) -> tuple[np.ndarray, list[int]]:
    """Covariance (divisor n), each entry the double nearest to the exact fraction, and the centre that products were taken at."""
    d = len(total)
    centre = [round(s / n) if abs(s) < 1 << 52 else s // n for s in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d), object)
        for batch in batches:
            w = batch.column(1).to_numpy().astype(np.int64)
            part = _products(_centred(_matrix(batch.column(0), d), centre), w)
            gram = gram + (part.astype(np.int64) if part.dtype == np.float64 else part).astype(object)
        yield _rows([(i, j, int(gram[i, j])) for i in range(d) for j in range(i, d) if gram[i, j]])

    found = _added(distinct.select("x", "w").mapInArrow(run, _TRIPLE))
    rest = [s - n * c for s, c in zip(total, centre)]
    cov = np.array([[(n * found.get((min(i, j), max(i, j)), 0) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    return cov, centre


def components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors * signs


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """Whitened components of every usable vector: (vec_id, component, n, deviation, whitened, explained, identity_error).

    weights "counts" fits on all usable rows, "one" on each distinct vector once; n and the sums
    are over that list. deviation is the sum over dimensions of (n * x - sum)^2, null where it
    exceeds 63 bits. A component without variance (at most d * 2^-52 of the total) has whitened
    and explained 0 and no part in identity_error. Vectors that are null or empty, hold null or
    non-finite entries, or have another length than most (the longer at a tie), are left out. Repeated rows and ids
    stay, also null ids. A table without usable vectors gives no rows; one vector has deviation 0.
    Vectors of fewer than k entries have as many components.
    """
    spark = rows.sparkSession
    small_batches(spark)
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    v = F.col(vector)
    listed = rows.where(usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(v).alias("x"))
    listed = listed.select("vec_id", "x", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)).alias("key"))
    grouped = materialize(listed.groupBy("key").agg(F.first("x").alias("x"), F.count("*").alias("rows")))
    lengths = grouped.groupBy(F.size("x").alias("d")).agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    distinct = grouped.where(F.size("x") == d).withColumn("w", F.col("rows") if weights == "counts" else F.lit(1).cast("long"))
    n, total = sums(distinct, d) if d else (0, [])
    if not n:
        return listed.where("false").select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in _RESULT))
    cov, centre = covariance(distinct, n, total)
    values, vectors = components(cov, k)
    trace = float(np.trace(cov))
    real = values > trace * d * 2.0**-52
    scaled = vectors / np.sqrt(np.where(real, values, np.inf))
    rest = [s - n * c for s, c in zip(total, centre)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = np.array([r / n for r in rest])
        for batch in batches:
            y = _centred(_matrix(batch.column(1), d), centre)
            most = n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + max(map(abs, rest))
            kind = np.int64 if d * most**2 < 1 << 62 else object
            gaps = y.astype(kind) * n - np.array(rest, kind)
            far = [int(q) if q < 1 << 63 else None for q in (gaps * gaps).sum(axis=1)]
            z = (y.astype(np.float64) - offset) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(far, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["key", "rows", "w", "deviation", "z"])

    whitened = materialize(distinct.select("key", "x", "rows", "w").mapInArrow(run, "key binary, rows long, w long, deviation long, z array<double>"))
    error = identity_error(whitened, n, [i for i in range(len(values)) if real[i]])
    hot = max(HOT_ROWS, -(-lengths[0].n // HOT_SHARE))
    parts = whitened.where(F.col("rows") > hot).select("key", F.ceil(F.col("rows") / hot).alias("parts"))  # under HOT_SHARE keys
    salted = listed.select("vec_id", "key").join(F.broadcast(parts), "key", "left")
    salted = salted.select("vec_id", "key", F.when(F.col("parts").isNull(), 0).otherwise(F.expr("pmod(xxhash64(vec_id), parts)")).cast("long").alias("part"))
    copies = F.when(F.col("rows") > hot, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / hot) - 1)).otherwise(F.array(F.lit(0).cast("long")))
    found = salted.join(whitened.select("key", "deviation", "z", F.explode(copies).alias("part")), ["key", "part"])
    shares = F.array(*(F.lit(float(e / trace) if ok else 0.0) for e, ok in zip(values, real)))
    out = found.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


_RESULT = (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))


def identity_error(whitened: DataFrame, n: int, at: list[int]) -> float:
    """Largest absolute entry of the covariance of the columns z[at] of (z, w), centred first, minus the identity."""
    if not at:
        return 0.0
    means = whitened.agg(*(F.sum(F.col("w") * F.col("z")[i]).alias(f"m{i}") for i in at)).collect()[0]
    mean = {i: means[f"m{i}"] / n for i in at}
    pairs = [(i, j) for i in at for j in at if i <= j]
    products = whitened.agg(*(F.sum(F.col("w") * (F.col("z")[i] - F.lit(mean[i])) * (F.col("z")[j] - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs)).collect()[0]
    return float(max(abs(products[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs))
