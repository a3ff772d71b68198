"""SimHash near-duplicates through a segment-popcount grid.

A 64-bit fingerprint is cut into segments; its vector of per-segment bit counts changes by
at most one in Manhattan distance for each bit that differs, so Manhattan distance is a
lower bound of Hamming distance. Two fingerprints within two bits have a point of the
integer grid within one step of both, so every fingerprint is entered in its own cell and
the cells one step away, and only fingerprints that meet in a cell go on. The exact test
works without pairs: within two bits means that some 64-bit value is at most one flip from
both, so members of a busy cell are grouped by these values, and each group is linked as a
star. A group of any size costs rows in proportion to its members.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.texts import bytes_of, small_batches
from quire.operators.components import components
from quire.runtime import broadcast_if_small, discard, materialize

SEED = 42
BITS = 64
#: Segments of the popcount embedding: 16 segments of 4 bits give 33 cells a fingerprint.
SEGMENTS = 16
#: Fingerprints a text in near_copies, their bits and segments, and the longest words that they
#: leave out. Fewer bits are within two bits for more of the pairs at a similarity of 0.8, and
#: short segments make cells that unlike texts seldom share.
BANDS = 8
BAND_BITS = 40
BAND_SEGMENTS = 20
SHORT = 4
#: Shingle minima a text: texts that meet are compared where they share one, at 0.8 in 998 of 1,000 cases.
MINIMA = 4
#: Partners of a text that are compared with one copy of it.
SHARED = 32
#: Busy cells, 8 bytes each, that are broadcast at most; more are joined by a shuffle.
BUSY_ROWS = 1_000_000
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each space-joined shingle; a shorter sequence is one shingle, none gives none."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])), np.uint64, len(starts))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a text as a signed 64-bit integer: bits set in over half the shingle hashes."""
    hashes = shingle_hashes(text.lower().split() if text else [], width)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i : i + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every document, one row each; null and word-free texts get 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), bytes_of(text).alias("t")).mapInArrow(run, "id long, fp long")


def entered(points: DataFrame, segments: int = SEGMENTS, bits: int = BITS) -> DataFrame:
    """(fp, rep, cell, segment, up) of points (fp, rep) for the cells at Manhattan distance 0 or 1.

    segment is null for the own cell. A cell packs the counts, three bits each at 16 segments,
    and above them the point's band if it has one. Plain arithmetic after an explode over a
    constant array, so that all of it is compiled.
    """
    width = bits // segments
    digit = (width + 1).bit_length() if width > 1 else 1
    if digit * segments > 48:
        raise ValueError("the cell does not fit 48 bits")
    fp = F.col("fp")
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]
    own = sum((F.shiftleft(c.cast("long"), i * digit) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    band = F.shiftleft(F.col("band").cast("long"), 48) if "band" in points.columns else F.lit(0).cast("long")
    rows = points.select("fp", "rep", own.alias("own"), band.alias("band"))  # before the explode, once a point
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * segments))).alias("code"))
    rows = rows.select("*", F.expr("(code - 1) div 2").cast("int").alias("at"), (F.col("code") % 2 == 1).alias("up"))
    rows = rows.select("*", F.expr(f"shiftrightunsigned(own, at * {digit}) & {(1 << digit) - 1}").alias("held"), F.expr(f"shiftleft(1L, at * {digit})").alias("step"))
    cell = F.when(F.col("code") == 0, F.col("own")).when(F.col("up"), F.col("own") + F.col("step")).otherwise(F.col("own") - F.col("step"))
    there = (F.col("code") == 0) | F.when(F.col("up"), F.col("held") < width).otherwise(F.col("held") > 0)
    return rows.where(there).select("fp", "rep", (cell + F.col("band")).alias("cell"), F.when(F.col("code") > 0, F.col("at")).alias("segment"), "up")


def midpoints(fp: Column, segment: Column, up: Column, segments: int = SEGMENTS, bits: int = BITS) -> Column:
    """The 64-bit values of that cell at most one flip from fp."""
    width = bits // segments
    flips = F.transform(F.sequence(segment * width, segment * width + width - 1), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
    fitting = F.filter(flips, lambda bit: (fp.bitwiseAND(bit) == 0) == up)
    return F.when(segment.isNull(), F.array(fp)).otherwise(F.transform(fitting, lambda bit: fp.bitwiseXOR(bit)))


def _met(points: DataFrame, segments: int) -> tuple[DataFrame, DataFrame]:
    """(rep, band, mid) of points that meet others in a cell, and (band, mid, dst) of the values at most one flip from two or more."""
    cells = entered(points, segments)
    busy = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    near = cells.join(broadcast_if_small(busy, BUSY_ROWS), "cell")
    mids = midpoints(F.col("fp"), F.col("segment"), F.col("up"), segments)
    return _stars(near.select("rep", F.shiftright("cell", 48).alias("band"), F.explode(mids).alias("mid")))


def _stars(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    near = materialize(near)
    stars = near.groupBy("band", "mid").agg(F.min("rep").alias("dst"), F.max("rep").alias("hi")).where("dst <> hi")
    return near, materialize(stars.select("band", "mid", "dst"))


def _met_banded(texts: DataFrame, spread: int) -> tuple[DataFrame, DataFrame]:
    """As _met, for texts (place, rep, fps) with a fingerprint for each band.

    Most cells hold one point, so an entry is shuffled as two numbers, its cell, and the text's
    place and its way into the cell; the fingerprint follows for entries of shared cells only.
    """
    points = texts.select(F.col("place").alias("rep"), F.posexplode("fps").alias("band", "fp")).repartition(spread)
    cells = entered(points, BAND_SEGMENTS, BAND_BITS)
    code = F.when(F.col("segment").isNull(), 0).otherwise(2 * F.col("segment") + F.when(F.col("up"), 1).otherwise(2))
    cells = cells.select("cell", (F.shiftleft("rep", 6) + code).alias("entry"))
    busy = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"))
    shared = cells.join(busy, "cell").select(F.shiftright("entry", 6).alias("place"), F.shiftright("cell", 48).cast("int").alias("band"), F.col("entry").bitwiseAND(F.lit(63).cast("long")).cast("int").alias("code"))
    known = shared.join(texts.select("place", "rep", "fps"), "place").select("rep", "band", "code", F.expr("fps[band]").alias("fp"))
    segment = F.when(F.col("code") > 0, F.expr("(code - 1) div 2").cast("int"))
    mids = midpoints(F.col("fp"), segment, F.col("code") % 2 == 1, BAND_SEGMENTS, BAND_BITS)
    near, stars = _stars(known.select("rep", "band", F.explode(mids).alias("mid")))
    discard(busy)
    return near, stars


def links(points: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Star edges (src, dst) whose components are those of Hamming distance at most 2 among points (fp, rep).

    With a column band only points of one band are compared. Points are distinct in fp or rep.
    """
    near, stars = _met(points, segments)
    return near.join(stars, ["band", "mid"]).where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """Fingerprint and component of every document: (doc_id, fingerprint, component_id).

    Fingerprints link at two or fewer differing bits; component_id is the smallest id
    reachable over links, itself included. Equal fingerprints are one point of the grid, so
    thousands of copies cost one. Null or empty texts have fingerprint 0 and link like any
    other. Rows with a null id take their fingerprint's component, null if it has no other
    id. Repeated rows stay, each with its component; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text, width))
    points = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    found = components(links(points.where("rep IS NOT NULL"), segments))
    named = points.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = materialize(named.select("fp", F.coalesce("component", "rep").alias("component_id")))
    return prints.join(named, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_prints(text: bytes | None, bands: int = BANDS) -> list[int]:
    """One SimHash for each band over a text's longer words, weighed by the root of their counts."""
    counts = Counter(text.lower().split() if text else [])
    chosen = [w for w in counts if len(w) > SHORT] or list(counts)
    if not chosen:
        return [0] * bands
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in chosen], np.uint64)
    weights = np.sqrt(np.array([counts[w] for w in chosen], np.float32))
    out = []
    for band in range(bands):
        mixed = hashes * np.uint64(2 * band + 1) + np.uint64(band)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        total = np.zeros(BAND_BITS, np.float64)
        for i in range(0, len(mixed), _CHUNK):
            bits = np.unpackbits(mixed[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, count=BAND_BITS, bitorder="little")
            total += weights[i : i + _CHUNK] @ bits.astype(np.float32)
        out.append(int.from_bytes(np.packbits(2 * total > weights.sum(), bitorder="little").tobytes(), "little"))
    return out


def shingle_minima(text: bytes | None, width: int, n: int = MINIMA) -> list[int]:
    """Minima of n hash functions over a text's shingles; each is shared by two texts as often as shingles are."""
    words = text.lower().split() if text else []
    if not words:
        return [0] * n
    each = np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    width = min(width, len(words))
    whole = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        whole = whole * np.uint64(0x100000001B3) + (each[k : k + len(whole)] ^ (each[k : k + len(whole)] >> np.uint64(29)))
    out = []
    for j in range(n):
        mixed = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append(int((mixed ^ (mixed >> np.uint64(32))).min().view(np.int64)))
    return out


def _shingle_set(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(doc_id, component_id): components of documents whose shingle sets have that Jaccard similarity.

    SimHash proposes: two bits of one fingerprint are too few for a similarity of 0.8, so
    each text has one for each band, over its longer words, and a pair meets where any band is
    within two bits. Texts that meet, directly or by way of others, are one chain, see _chains. Texts of
    the same words in another order meet as well, so a chain is cut into groups by minima of its texts'
    shingles. Links are then checked on the whole texts, see alike_groups. Equal texts are one text. Null and empty texts are equal to each other; rows with a null id take their
    text's component.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(2).to_pylist(), pa.list_(pa.int64())
            prints, minima = [word_prints(t, bands) for t in texts], [shingle_minima(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, lists), pa.array(minima, lists)], ["id", "h", "fps", "minima"])

    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(body.cast("binary")).alias("h"), bytes_of("text").alias("t"))
    prints = materialize(hashed.mapInArrow(run, "id long, h string, fps array<bigint>, minima array<bigint>"))
    once = prints.groupBy("h").agg(F.min("id").alias("rep"), F.min_by("fps", "id").alias("fps"), F.min_by("minima", "id").alias("minima"))
    texts = materialize(once.withColumn("place", F.monotonically_increasing_id()))
    near, stars = _met_banded(texts.where("rep IS NOT NULL"), 4 * docs.sparkSession.sparkContext.defaultParallelism)
    edges = materialize(near.join(stars, ["band", "mid"]).select(F.col("rep").alias("src"), "dst").distinct())
    discard(near, stars)
    met = _chains(edges).join(texts.select("rep", "minima"), "rep").select("chain", "rep", F.posexplode("minima").alias("j", "least"))
    members = met.select(F.lit(0).alias("band"), F.xxhash64("chain", "j", "least").alias("mid"), "rep")
    found = alike_groups(docs, members, width, similarity)
    named = texts.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(materialize(named), "h").select(F.col("id").alias("doc_id"), "component_id")


def _chains(edges: DataFrame) -> DataFrame:
    """(rep, chain): components of star edges (src, dst) in which each hub is a member of its own star.

    A text is in many stars, so only its edge to the smallest hub enters the rounds at first;
    of the others those whose ends that leaves apart.
    """
    labels = components(materialize(edges.groupBy("src").agg(F.min("dst").alias("dst"))))
    label = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    apart = edges.join(label("src"), "src").join(label("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()
    found = components(materialize(forest(labels).union(apart)))
    return found.select(F.col("node").alias("rep"), F.col("component").alias("chain"))


def alike_groups(docs: DataFrame, members: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, component) by the alike pairs of ids that share a group (band, mid, rep).

    Each group is first a star around its smallest id: a text is compared with the smallest of
    its hubs, and with the others where that leaves them apart. Texts of groups whose members then still
    lie in several components are grouped anew by their rarest shingles, see rare_groups: every
    alike pair among them shares one, while a passage that many unlike texts have, or the text
    under many heavy edits, is not among the rarest. These groups end in rounds, see _settled.
    """
    members = materialize(members)
    whole = (F.min("rep").alias("dst"), F.max("rep").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"))
    groups = members.groupBy("band", "mid").agg(*whole).where("dst <> hi")
    once = groups.groupBy("dst", "hi", "n", "x").agg(F.min(F.struct("band", "mid")).alias("g"))  # groups of the same members are one
    hubs = materialize(once.select("g.band", "g.mid", "dst"))
    members = materialize(members.join(hubs, ["band", "mid"]).select("band", "mid", "rep"))
    pairs = materialize(members.join(hubs, ["band", "mid"]).where("rep <> dst").select(F.col("rep").alias("src"), "dst").distinct())
    first = materialize(pairs.groupBy("src").agg(F.min("dst").alias("dst")))
    labels = components(materialize(_alike(docs, first, width, similarity)))
    label = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    apart = F.coalesce("_src", "src") != F.coalesce("_dst", "dst")
    rest = pairs.join(first, ["src", "dst"], "left_anti").join(label("src"), "src", "left").join(label("dst"), "dst", "left").where(apart)
    rest = materialize(rest.select("src", "dst"))
    linked = materialize(forest(labels).union(_alike(docs, rest, width, similarity)))
    pairs = first.union(rest)
    labels = components(linked).withColumnRenamed("node", "rep")
    labelled = members.join(labels, "rep", "left").select("band", "mid", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = materialize(labelled.groupBy("band", "mid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("band", "mid"))
    texts = materialize(members.join(broadcast_if_small(mixed), ["band", "mid"], "left_semi").select("rep").distinct())
    return _settled(docs, rare_groups(docs, texts, width, similarity), linked, pairs, width, similarity)


def forest(labels: DataFrame) -> DataFrame:
    """(src, dst): one edge from each node of (node, component) to its component's smallest, which has the same components."""
    return labels.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))


def rare_groups(docs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(band, mid, rep, n, place): the texts (rep) under each of their rarest shingles, so many that alike texts share one.

    Of n shingles in order of how many of the texts have them, two texts of that similarity
    share one of their first n - ceil(similarity * n) + 1; place is a shingle's in that order.
    At the first that a pair shares, what comes after must be enough for the similarity
    (may_reach), so texts that reach it with no text of the group's sizes are left out, as are
    groups of one. Texts that share an id are one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes((t.as_py() or b"").lower().split(), width)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["rep", "shingles"])

    whole = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), bytes_of("text").alias("t"))
    held = whole.join(texts, "rep", "left_semi").mapInArrow(run, "rep long, shingles array<bigint>")
    rows = materialize(held.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("mid")))
    shared = rows.groupBy("mid").agg(F.count("*").alias("f")).where("f > 1")
    ranked = rows.join(shared, "mid")
    by = Window.partitionBy("rep")
    alone = F.col("n") - F.count("*").over(by)
    place = F.row_number().over(by.orderBy("f", "mid")) + alone
    first = F.col("n") - F.ceil(F.lit(similarity) * F.col("n")) + 1
    entered_ = materialize(ranked.withColumn("place", place).where(F.col("place") <= first).select("mid", "rep", "n", "place").distinct())
    least = entered_.groupBy("mid").agg(F.min("n").alias("low"))
    other = F.greatest("low", F.ceil(F.lit(similarity) * F.col("n")))
    fit = materialize(entered_.join(least, "mid").where(may_reach(similarity, F.col("n") - F.col("place"), F.col("n") + other)).select("mid", "rep", "n", "place"))
    several = fit.groupBy("mid").agg(F.count("*").alias("k")).where("k > 1").select("mid")
    return fit.join(several, "mid", "left_semi").select(F.lit(0).alias("band"), "mid", "rep", "n", "place")


def may_reach(similarity: float, after: Column, sizes: Column) -> Column:
    """Whether one shared shingle and at most so many after it can make that similarity of two texts with those shingles together."""
    return (after + 1) * (1 + similarity) >= similarity * sizes - 1e-6


def _settled(docs: DataFrame, members: DataFrame, linked: DataFrame, done: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, component) once every pair of a group is compared or in one component; linked and done are pairs so far.

    Where a group's members lie in several components, members outside its largest one become
    hubs, one at first and 64 times as many each round, and are compared with all members
    of other components that may reach the similarity. It ends when every such member has been a hub or lies in the largest
    component. Where members are alike, the first hubs join nearly all; work is then in
    proportion to members.
    """
    members = materialize(members)
    tried = members.select("band", "mid", "rep").where("false")
    lots = 1
    while True:
        labels = components(linked).withColumnRenamed("node", "rep")
        labelled = materialize(members.join(labels, "rep", "left").select("band", "mid", "rep", "n", "place", F.coalesce("component", "rep").alias("c")))
        counts = labelled.groupBy("band", "mid", "c").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("lo"))
        groups = counts.groupBy("band", "mid").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.min("lo").alias("lo"))
        # groups of the same members are one
        once = groups.where("k > 1").groupBy("main", "k", "n", "x", "lo").agg(F.min(F.struct("band", "mid")).alias("g"))
        mixed = materialize(once.select("g.band", "g.mid", "main"))
        within = materialize(labelled.join(broadcast_if_small(mixed), ["band", "mid"]))
        outside = within.where("c <> main").join(tried, ["band", "mid", "rep"], "left_anti")
        lot = F.pmod(F.xxhash64("rep", F.lit(lots)), F.lit(lots)).alias("lot")
        hub = F.min(F.struct("rep", "c", "n", "place")).alias("hub")
        hubs = materialize(outside.groupBy("band", "mid", lot).agg(hub).select("band", "mid", F.col("hub.rep").alias("one"), F.col("hub.c").alias("c1"), F.col("hub.n").alias("n1"), F.col("hub.place").alias("place1")))
        if not hubs.count():
            return labels.withColumnRenamed("rep", "node")
        enough = may_reach(similarity, F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1")), F.col("n") + F.col("n1"))
        crossed = hubs.join(within, ["band", "mid"]).where((F.col("c") != F.col("c1")) & enough).select(F.greatest("one", "rep").alias("src"), F.least("one", "rep").alias("dst")).distinct()
        pairs = materialize(crossed.join(done, ["src", "dst"], "left_anti"))
        linked = materialize(forest(labels.withColumnRenamed("rep", "node")).union(_alike(docs, pairs, width, similarity)))
        done, tried = done.union(pairs), tried.union(hubs.select("band", "mid", F.col("one").alias("rep")))
        lots *= 64


def _alike(docs: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (src, dst) of ids whose texts have that similarity.

    Texts are compressed; dst's is sent once for SHARED of its partners, and a task holds the
    shingle hashes of two texts at a time. Of texts that share an id any counts.
    """
    small_batches(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(t.as_py() or b"") for t in batch.column(1)], pa.binary())], ["needed", "packed"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        at, hubs = None, []
        for batch in batches:
            keep = []
            for dst, part, src, packed in zip(*batch.columns):
                mine = np.unique(shingle_hashes(unpack(packed.as_py()).lower().split(), width))
                if at != (dst, part):
                    at, hubs = (dst, part), []
                if not src.is_valid:
                    hubs.append(mine)
                    keep.append(False)
                    continue
                common = [(len(np.intersect1d(mine, hub, assume_unique=True)), len(hub)) for hub in hubs]
                keep.append(any(n >= similarity * (len(mine) + size - n) for n, size in common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["src", "dst"])

    many = materialize(pairs.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > SHARED).select("dst", F.ceil(F.col("n") / SHARED).alias("parts")))
    part = F.expr("pmod(xxhash64(src), coalesce(parts, 1))")
    sides = materialize(pairs.join(broadcast_if_small(many), "dst", "left").select("dst", part.alias("part"), "src"))
    wanted = sides.select(F.col("src").alias("needed"), "dst", "part", "src").union(sides.select(F.col("dst").alias("needed"), "dst", "part", F.lit(None).cast("long").alias("src")).distinct())
    packed = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("needed"), bytes_of("text").alias("t"))
    packed = packed.join(wanted.select("needed").distinct(), "needed", "left_semi").mapInArrow(pack, "needed long, packed binary")
    met = packed.join(wanted, "needed").select("dst", "part", "src", "packed").repartition("dst", "part")
    met = met.sortWithinPartitions("dst", "part", F.col("src").asc_nulls_first())
    return met.mapInArrow(check, "src long, dst long").distinct()


def deduplicate(docs: DataFrame, components_: DataFrame | None = None) -> DataFrame:
    """One document of each component, the smallest id, with its columns unchanged.

    Components are near_duplicates(docs) unless given as (doc_id, component_id), as by
    near_copies. Documents that share an id count as one; rows with a null id are never dropped.
    """
    found = near_duplicates(docs) if components_ is None else components_
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    unnamed = docs.where("doc_id IS NULL")
    kept = docs.join(keep, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(unnamed)
