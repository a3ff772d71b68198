"""Line-first quality cleaning.

Each line is judged alone by punctuation, navigation, boilerplate and repetition rules;
failing lines are removed, and a document is rejected when too much of its text went with
them, or when it fails a base rule on length or repeated words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.texts import bytes_of, small_batches

#: A document with fewer words fails.
MIN_WORDS = 50
#: A document fails where more than this share of its words lies in repeated 3-word windows.
MAX_REPEAT_SHARE = 0.5
#: A document is rejected when the removed lines hold more than this share of its words.
MAX_LOST_SHARE = 0.5
#: A line that ends without a closing mark passes with this many words.
UNPUNCTUATED_WORDS = 10
#: A line fails with more symbols than this for each word.
MAX_SYMBOLS_PER_WORD = 0.5
#: Separators that make a line of short items a navigation bar.
MIN_SEPARATORS = 3
#: Boilerplate phrases count in lines of up to this many words.
BOILERPLATE_WORDS = 20

# Characters and phrases of the line rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
CLOSING = tuple(s.encode() for s in (".", "!", "?", ":", ";", "…", '"', "'", ")", "]", "”", "’", "»", "。", "！", "？"))
SEPARATORS = re.compile(rb"\||\xc2\xbb|\xc2\xb7|\xe2\x80\xa2| > | / ")
BOILERPLATE = re.compile(
    rb"all rights reserved|cookie|privacy policy|terms of (?:use|service)|sign (?:in|up)|log ?in|subscribe|newsletter"
    rb"|enable javascript|click here|read more|share (?:this|on)|follow us|lorem ipsum|skip to (?:main )?content|back to top",
    re.IGNORECASE,
)


class Report(NamedTuple):
    """Counts and verdict of one text; cleaned is the text without its failing lines."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_failed_lines: int
    lost_words: int
    base_failed: bool
    kept: bool
    cleaned: bytes


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_failed_lines long, lost_words long, base_failed boolean, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, windows, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether a line with at least one word fails the punctuation, navigation or boilerplate rule."""
    tail = line.rstrip(SPACES)
    if n_words < UNPUNCTUATED_WORDS and not tail.endswith(CLOSING):
        return True
    if _n_symbols(line) > MAX_SYMBOLS_PER_WORD * n_words:
        return True
    separators = len(SEPARATORS.findall(line))
    if separators >= MIN_SEPARATORS and n_words <= 5 * (separators + 1):
        return True
    return n_words <= BOILERPLATE_WORDS and BOILERPLATE.search(line) is not None


def judge(text: bytes | None) -> Report:
    """Judge one text; null is the empty text."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    lines, n_dup, n_failed, lost = [], 0, 0, 0
    for line in text.split(b"\n"):
        n = len(line.split())
        dup = n > 0 and line in seen
        if n > 0:
            seen.add(line)
        n_dup += dup
        if n and (dup or line_fails(line, n)):
            n_failed += 1
            lost += n
        else:
            lines.append(line)
    n_chars = len(text.decode("utf-8", "replace"))
    word_chars = n_chars - (len(text) - len(text.translate(None, SPACES)))
    repeats = repeated_words(words)
    base = len(words) < MIN_WORDS or repeats > MAX_REPEAT_SHARE * len(words)
    kept = not base and lost <= MAX_LOST_SHARE * len(words)
    return Report(len(words), word_chars, _n_symbols(text), n_dup, repeats, n_failed, lost, base, kept, b"\n".join(lines))


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every document, without a shuffle: id, the COUNTS columns.

    Null and empty texts have no words and fail; rows are judged alone, so repeated rows get
    equal results; other columns, whatever their names, are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in COUNTS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py())[:-1] for t in batch.column(1)]
            columns = list(zip(*found)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col(id_col), bytes_of(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {COUNTS}")


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The kept documents with failing lines removed and n_chars counted anew; columns as given."""
    small_batches(docs.sparkSession)
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports = [judge(t.encode() if (t := v.as_py()) is not None else None) for v in batch.column(at)]
            batch = batch.filter(pa.array([r.kept for r in reports], pa.bool_()))
            texts = pa.array([r.cleaned.decode("utf-8", "replace") for r in reports if r.kept], batch.column(at).type)
            columns = list(batch.columns)
            columns[at] = texts
            if n_chars in names:
                columns[names.index(n_chars)] = pa.compute.utf8_length(texts).cast(batch.column(names.index(n_chars)).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
