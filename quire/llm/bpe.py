"""Byte-level BPE through DuckDB recursive queries, one small database per Python worker.

The rank file is turned into a merge table (left, right, merged). The distinct pieces of a
batch become rows (piece, position, token); each step of the recursion joins neighbouring
positions with the merge table and contracts every piece's leftmost pair of minimum rank,
until no pair of a piece is in the table. Long pieces are cut where no token can cross, and
all pairs of their minimum rank that do not touch each other are contracted in one step.
Decoding joins (document, position, token) with the token table and aggregates the bytes in
order.
"""

from __future__ import annotations

import base64
import contextlib
import itertools
import re
import shutil
import tempfile
from collections.abc import Collection, Iterator
from typing import Any

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.texts import small_batches

#: Memory of a worker's database; larger intermediate results go to the task's temporary folder.
MEMORY = "128MB"
#: Cached chunks and pieces of a worker, in bytes, about: half of them recent, half from before.
CACHE_BYTES = 160 << 20
#: Characters encoded together, and four times the tokens decoded by one query, at most, unless a single text has more.
QUERY_CHARS = 4_000_000
#: Bytes of a piece that CONTRACT takes; CONTRACT_LONG takes longer ones.
SHORT_PIECE = 64
#: Rows that the recursion over short pieces returns at most: a piece of n bytes keeps up to n * n / 2.
QUERY_ROWS = 1_500_000

#: A row's place is its piece's number times WIDTH plus its position; next is the token after it in
#: its piece, negative at the end, so that a pair is one row. best is, for each piece with a pair in
#: the table, rank and place of the leftmost pair of least rank: the pair's first row goes, its
#: second takes the merged token and keeps its next. A row is done when its piece has no pair left.
CONTRACT = """
WITH RECURSIVE state(place, token, next, done) AS (
    SELECT place, token, next, false FROM start
    UNION ALL
    (
        WITH best AS (
            SELECT s.place // {width} AS piece, min(m.merged * {width} + s.place % {width}) AS least
            FROM state s JOIN merges m ON m.pair = s.token * {radix} + s.next WHERE NOT s.done
            GROUP BY 1
        )
        SELECT CASE WHEN s.place % {width} > least % {width} THEN s.place - 1 ELSE s.place END,
               CASE WHEN s.place % {width} = least % {width} + 1 THEN least // {width} ELSE s.token END,
               CASE WHEN s.place % {width} = least % {width} - 1 THEN least // {width} ELSE s.next END,
               least IS NULL
        FROM state s LEFT JOIN best ON best.piece = s.place // {width}
        WHERE NOT s.done AND (least IS NULL OR s.place % {width} <> least % {width})
    )
)
SELECT place // {width} AS piece, token FROM state WHERE done ORDER BY place
"""

#: The same result for long pieces. One step contracts all pairs of a piece's least rank that the
#: leftmost-first order would take in a row: of overlapping ones every other, and none after the
#: first (stop) whose token makes a pair of lower rank with a neighbour, as that pair is next.
#: A row is done when its piece has no pair left; only done rows are returned, so that no step is
#: kept, and a piece takes a step for each rank that occurs in it, not for each pair.
CONTRACT_LONG = """
WITH RECURSIVE state(place, token, done) AS (
    SELECT place, token, false FROM start
    UNION ALL
    (
        WITH live AS (SELECT place, token FROM state WHERE NOT done),
        pairs AS (
            SELECT a.place, a.place // {width} AS piece, m.merged AS rank
            FROM live a JOIN live b ON b.place = a.place + 1 JOIN merges m ON m.pair = a.token * {radix} + b.token
        ),
        least AS (SELECT piece, min(rank) AS rank FROM pairs GROUP BY piece),
        runs AS (
            SELECT place, piece, rank, place - row_number() OVER (PARTITION BY piece ORDER BY place) AS run
            FROM pairs JOIN least USING (piece, rank)
        ),
        hits AS (
            SELECT place, piece, rank
            FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY place) AS nth FROM runs) WHERE nth % 2 = 1
        ),
        lower AS (
            SELECT h.piece, h.place FROM hits h JOIN live n ON n.place = h.place + 2
            JOIN merges m ON m.pair = h.rank * {radix} + n.token WHERE m.merged < h.rank
            UNION ALL
            SELECT h.piece, h.place FROM hits h JOIN live n ON n.place = h.place - 1
            JOIN merges m ON m.pair = n.token * {radix} + h.rank WHERE m.merged < h.rank
            UNION ALL
            SELECT h.piece, h.place FROM hits h JOIN hits g ON g.place = h.place - 2
            JOIN merges m ON m.pair = h.rank * {radix} + h.rank WHERE m.merged < h.rank
        ),
        stops AS (SELECT piece, min(place) AS stop FROM lower GROUP BY piece),
        taken AS (SELECT place, rank FROM hits LEFT JOIN stops USING (piece) WHERE stop IS NULL OR place <= stop),
        marked AS (
            SELECT l.place, l.token, t.rank, before.place AS gone, least.piece IS NULL AS done
            FROM live l LEFT JOIN taken t ON t.place = l.place LEFT JOIN taken before ON before.place = l.place - 1
            LEFT JOIN least ON least.piece = l.place // {width}
        ),
        moved AS (
            SELECT place - count(gone) OVER (PARTITION BY place // {width} ORDER BY place ROWS UNBOUNDED PRECEDING) AS place,
                   coalesce(rank, token) AS token, done, gone
            FROM marked
        )
        SELECT place, token, done FROM moved WHERE gone IS NULL
    )
)
SELECT place // {width} AS piece, token FROM state WHERE done ORDER BY place
"""

#: The merge table: every split of a token into two tokens.
MERGES = """
CREATE TABLE merges AS
SELECT l.id * {radix} + r.id AS pair, t.id AS merged
FROM (SELECT id, chars, unnest(range(1, length(chars))) AS at FROM tokens) t
JOIN tokens l ON l.chars = left(t.chars, t.at) JOIN tokens r ON r.chars = substr(t.chars, t.at + 1)
"""

#: Tokens of a document in a row of DECODE, so that fewer rows are put in order.
RUN = 8

#: id0 to id7 are a run of a document's tokens; what has no token, as at its end, gives no bytes.
DECODE = f"""
SELECT place // {{width}} AS doc, string_agg(concat({", ".join(f"t{i}.chars" for i in range(RUN))}), '' ORDER BY place) AS chars
FROM coded {" ".join(f"LEFT JOIN tokens t{i} ON t{i}.id = id{i}" for i in range(RUN))} GROUP BY 1
"""

#: White space other than the space and the line feed, and the bytes that hint at it in UTF-8.
_OTHER = re.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_HINTS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
#: Marks that are a match of their own after letters at the end of a chunk.
_ENDS = frozenset(",.;:!?")


def _plain(text: str) -> bool:
    """Whether all white space of a text is lone spaces and line feeds between other characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _PAIRS):
        return False
    data = text.encode()
    if len(data.translate(None, b"\t\r\v\f\x1c\x1d\x1e\x1f")) < len(data):
        return False
    return not (any(x in data for x in _HINTS) and _OTHER.search(text))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file's contents."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """The tables of one rank file in a DuckDB database, with a bounded cache of encoded chunks and pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.split = regex.compile(pattern).findall
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.radix = max(ranks.values()) + 1
        self.folder = tempfile.mkdtemp(prefix="bpe-")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder})
        self.db.execute("CREATE TABLE tokens(id BIGINT, chars VARCHAR)")
        self._insert("tokens", pa.table({"id": list(ranks.values()), "chars": [t.decode("latin-1") for t in ranks]}))
        self.db.execute(MERGES.format(radix=self.radix))
        #: Whether two bytes stand side by side in any token; where they do not, no token crosses.
        self.joined = np.zeros(1 << 16, bool)
        flat = np.frombuffer(b"".join(ranks), np.uint8).astype(np.int64)
        inside = np.ones(len(flat), bool)
        inside[np.cumsum([len(t) for t in ranks]) - 1] = False
        at = np.flatnonzero(inside)
        self.joined[flat[at] << 8 | flat[at + 1]] = True
        self.recent: dict[str | bytes, bytes] = {}
        self.before: dict[str | bytes, bytes] = {}
        self.held = 0
        self.whole = {t: np.int32(n).tobytes() for t, n in ranks.items()}

    def close(self) -> None:
        """Give up the database, its folder and the cache."""
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)
        self.recent.clear()
        self.before.clear()
        self.whole.clear()

    def _insert(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"INSERT INTO {name} SELECT * FROM given")
        self.db.unregister("given")

    def _cached(self, wanted: Collection[Any]) -> dict[Any, bytes | None]:
        """What the cache has of each; what it has only from before becomes recent again."""
        found = dict(zip(wanted, map(self.recent.get, wanted)))
        if self.before:
            again = {x: self.before[x] for x, v in found.items() if v is None and x in self.before}
            self._keep(again)
            found.update(again)
        return found

    def _keep(self, coded: dict[Any, bytes]) -> None:
        """Add to the cache; a full half takes the place of the one from before."""
        size = sum(map(len, coded)) + sum(map(len, coded.values())) + 200 * len(coded)
        if self.held + size > CACHE_BYTES // 2:
            self.before, self.recent, self.held = self.recent, {}, 0
        if size <= CACHE_BYTES // 2:
            self.recent.update(coded)
            self.held += size

    def _contract(self, query: str, pieces: list[bytes]) -> list[bytes]:
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max()) + 1
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        place = np.repeat(np.arange(len(pieces)) * width - firsts, sizes) + np.arange(len(flat))
        token = self.base[flat]
        after = np.append(token[1:], 0)
        after[firsts + sizes - 1] = -self.radix * self.radix  # makes no pair
        self.db.register("start", pa.table({"place": place, "token": token, "next": after}))
        found = self.db.execute(query.format(width=width, radix=self.radix)).fetchnumpy()
        self.db.unregister("start")
        ends = [0, *(4 * np.searchsorted(found["piece"], np.arange(1, len(pieces) + 1))).tolist()]
        tokens = found["token"].astype(np.int32).tobytes()
        return [tokens[a:b] for a, b in zip(ends, ends[1:])]

    def _cut(self, piece: bytes) -> list[bytes]:
        """A long piece's parts between bytes that no token has side by side; no pair crosses there."""
        codes = np.frombuffer(piece, np.uint8).astype(np.int64)
        ends = [0, *(np.flatnonzero(~self.joined[codes[:-1] << 8 | codes[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(ends, ends[1:])]

    def pieces(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """Tokens of each piece: its own rank if it has one, else by contraction; short pieces first, as long ones take more steps."""
        out = {p: self.whole.get(p) for p in wanted}
        fresh = [p for p, v in out.items() if v is None]
        parts = {p: self._cut(p) for p in fresh if len(p) > SHORT_PIECE}
        small = {p for p in fresh if p not in parts} | {x for cut in parts.values() for x in cut if out.get(x) is None}
        coded = {x: self.whole[x] for x in small if x in self.whole}
        rest: list[bytes] = []
        size = 0
        for piece in sorted((p for p in small if p not in coded and len(p) <= SHORT_PIECE), key=len):
            if size + len(piece) ** 2 > 2 * QUERY_ROWS:
                coded.update(zip(rest, self._contract(CONTRACT, rest)))
                rest, size = [], 0
            rest.append(piece)
            size += len(piece) ** 2
        if rest:
            coded.update(zip(rest, self._contract(CONTRACT, rest)))
        for piece in (p for p in small if len(p) > SHORT_PIECE and p not in coded):
            coded[piece] = self._contract(CONTRACT_LONG, [piece])[0]
        for piece, cut in parts.items():
            coded[piece] = b"".join(coded.get(x) or out[x] for x in cut)
        out.update((p, coded[p]) for p in fresh)
        return out

    def _parts(self, chunk: str) -> list[str | bytes]:
        """Pieces of a chunk that followed a space, or starts with a line feed; a space and letters as the letters alone, as text."""
        if chunk.isascii():
            if chunk.isalpha():  # one match of the pattern, as is a mark of _ENDS after it
                return [chunk]
            if chunk[-1:] in _ENDS and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1:].encode()]
        parts = ["\n", *self.split(chunk[1:])] if chunk[:1] == "\n" else self.split(" " + chunk)
        return [p[1:] if p[0] == " " and p[1:].isascii() and p[1:].isalpha() else p.encode() for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as the bytes of 32-bit integers."""
        out: list[bytes] = []
        for some in _groups(texts, list(map(len, texts)), QUERY_CHARS):
            out += self._encode(some)
        return out

    def _coded(self, parts: dict[Any, list[str | bytes]]) -> dict[Any, bytes]:
        """Tokens of each item from those of its pieces, all of which are cached."""
        coded = self._cached(set(itertools.chain.from_iterable(parts.values())))
        named = {p: p if isinstance(p, bytes) else b" " + p.encode() for p, v in coded.items() if v is None}
        found = self.pieces(set(named.values()))
        new = {p: found[x] for p, x in named.items()}
        coded.update(new)
        new.update((x, b"".join(map(coded.__getitem__, pieces))) for x, pieces in parts.items() if pieces != [x])
        self._keep(new)
        coded.update(new)
        return coded

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Encode some texts together.

        A lone space or line feed between other characters always starts a match of the
        pattern, so plain texts are cut there into chunks; chunks after the first, without
        their space, are encoded once each and cached whole. First chunks and other texts are
        split each time.
        """
        plain = [_plain(t) for t in texts]
        cut = pc.split_pattern(pa.array([t.replace("\n", " \n") if p else "" for t, p in zip(texts, plain)], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        first = np.zeros(len(cut.values), bool)
        first[ends[:-1]] = True
        heads = [h if p else t for h, t, p in zip(cut.values.filter(pa.array(first)).to_pylist(), texts, plain)]
        tails = cut.values.filter(pa.array(~first)).dictionary_encode()
        names = tails.dictionary.to_pylist()
        chunks = self._cached(names)
        chunks.update(self._coded({x: self._parts(x) for x, v in chunks.items() if v is None}))
        split = [[p.encode() for p in self.split(h)] for h in heads]
        starts = self._cached(set(itertools.chain.from_iterable(split)))
        starts.update(self._coded({p: [p] for p, v in starts.items() if v is None}))
        order = np.empty(len(first), np.int64)
        order[~first], order[first] = tails.indices.to_numpy(), np.arange(len(names), len(names) + len(heads))
        held = [*map(chunks.__getitem__, names), *(b"".join(map(starts.__getitem__, h)) for h in split)]
        found = _ids(held).take(pa.array(order))
        at, ids = 4 * found.offsets.to_numpy()[ends].astype(np.int64), found.values.to_numpy().tobytes()
        return [ids[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, in order."""
        out: list[bytes] = []
        for some in _groups(ids, list(map(len, ids)), QUERY_CHARS // 4):
            sizes = np.array([len(x) for x in some], np.int64)
            runs = -(-sizes // RUN)
            width, firsts = int(runs.max(initial=0)) + 1, np.cumsum(runs) - runs
            flat = np.full(RUN * int(runs.sum()), -1, np.int64)
            flat[np.repeat(RUN * firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = np.concatenate(some)
            place = np.repeat(np.arange(len(some)) * width - firsts, runs) + np.arange(runs.sum())
            texts = [b""] * len(some)
            self.db.register("coded", pa.table({"place": place, **{f"id{i}": np.ascontiguousarray(flat[i::RUN]) for i in range(RUN)}}))
            for doc, text in self.db.execute(DECODE.format(width=width)).fetchall():
                texts[doc] = text.encode("latin-1")
            self.db.unregister("coded")
            out += texts
        return out


def _groups(items: list[Any], sizes: list[int], most: int) -> Iterator[list[Any]]:
    """Consecutive items in groups of that total size at most, or one item each."""
    group: list[Any] = []
    total = 0
    for item, size in zip(items, sizes):
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(item)
        total += size
    if group:
        yield group


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about QUERY_CHARS bytes, so that words are looked up once for many texts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= QUERY_CHARS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@contextlib.contextmanager
def vocabulary(data: bytes, pattern: str) -> Iterator[Vocabulary]:
    """A rank file's tables for the length of a task, so that workers keep no memory for later stages."""
    made = Vocabulary(read_ranks(data), pattern)
    try:
        yield made
    finally:
        made.close()


def _ids(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _contents(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids) of every document: the token ids of its whole text without special tokens.

    path is the rank file on the driver; its contents, a few MB, are broadcast. Null and empty
    texts give no ids; repeated rows are encoded each; no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(_contents(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with vocabulary(data.value, pattern) as words:
            for batch in _gathered(batches):
                found = words.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), _ids(found)], [id_col, "ids"])

    return docs.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The given rows with a binary column decoded: the bytes of their ids; null ids give no bytes."""
    spark = coded.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(_contents(path))
    at = coded.columns.index(ids)
    names = [*coded.columns, "decoded"]
    schema = coded.select("*", F.lit(b"").cast("binary").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with vocabulary(data.value, pattern) as words:
            for batch in batches:
                given = [np.array(x.values if x.is_valid else (), np.int64) for x in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.decode(given), pa.binary())], names)

    return coded.mapInArrow(run, schema)


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded) of every document: encoded, and decoded from the ids again, in one worker."""
    spark = docs.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(_contents(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with vocabulary(data.value, pattern) as words:
            for batch in _gathered(batches):
                found = words.encode([t or "" for t in batch.column(1).to_pylist()])
                back = words.decode([np.frombuffer(x, np.int32) for x in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), _ids(found), pa.array(back, pa.binary())], [id_col, "ids", "decoded"])

    done = docs.select(id_col, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
    return done.select(id_col, "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, and SHA-256 of its ids joined by a space and of its decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    done = tokenized(docs, path, pattern)
    return done.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
