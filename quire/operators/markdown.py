"""Markdown as rows: nested blocks, link definitions, and inline trees.

A document's lines are folded with a stack of open containers (quotes, list items, footnotes)
and one open leaf; each block is a row with its parent and its place among its siblings. What
follows from the rows of more than one block is left to joins: the first definition of each
label, and which definitions a text refers to. Inline trees fold the tokens of a leaf's text
with a stack of delimiter runs and one of brackets.
Rules are those of CommonMark 0.31.2 with tables, strikethrough and footnotes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import inlines
from quire.runtime import materialize

# Patterns and names of the syntax.
LINE_END = re.compile(r"\r\n|\n|\r")
HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*?)(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
ITEM = re.compile(r"([-+*])(?=[ \t]|$)|([0-9]{1,9})([.)])(?=[ \t]|$)")
FOOTNOTE = re.compile(r"\[\^([^\]\s]+)\]:[ \t]*")
DEFINITION = re.compile(r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
DEFINITION_ALONE = re.compile(r"""[ ]{0,3}\[((?:[^\[\]\\]|\\.){1,999})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)()[ \t]*(?:\n|$)""")
DELIMITER_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame"
    " frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
#: Start of each kind of HTML block, and what ends it on its line (None: a blank line).
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{HTML_NAMES.replace(' ', '|')})(?:[ \t]|/?>|$)", re.I), None),
    (re.compile(rf"(?:{inlines.OPEN_TAG}|{inlines.CLOSE_TAG})[ \t]*$", re.I), None),
]
LEAST_CODE = 4

BLOCKS = "block long, parent long, ordinal int, kind string, level int, marker string, start long, info string, title string, text string, first_line int, last_line int, tight boolean"
#: Rows of a batch that goes back to Spark, about.
BATCH_ROWS = 10_000


class _Block:
    """A row in the making; open containers also know the columns that their lines start with."""

    def __init__(self, rows: list[_Block], parent: _Block | None, kind: str, line: int, **more: object):
        self.n, self.parent, self.kind, self.first, self.last = len(rows), parent, kind, line, line
        self.children, self.lines, self.more, self.indent, self.list, self.dropped, self.ordinal = 0, [], more, 0, None, False, 0
        if parent:
            parent.children += 1
        rows.append(self)


def _lead(rest: str, column: int) -> int:
    """Columns of white space that rest starts with; a tab goes to the next multiple of 4."""
    at = column
    for c in rest:
        if c == " ":
            at += 1
        elif c == "\t":
            at += 4 - at % 4
        else:
            break
    return at - column


def _drop(rest: str, column: int, n: int) -> tuple[str, int]:
    """rest without n columns of white space; what a cut tab had left becomes spaces."""
    while n > 0 and rest[:1] in (" ", "\t"):
        width = 1 if rest[0] == " " else 4 - column % 4
        rest = " " * max(0, width - n) + rest[1:]
        column += min(width, n)
        n -= width
    return rest, column


def cells(row: str) -> list[str]:
    """The trimmed cells of a table row; a backslash before a bar keeps it, outer bars are optional."""
    row = row.strip(" \t")
    parts = re.split(r"(?<!\\)\|", row)
    parts = parts[1 if row.startswith("|") else 0 : -1 if len(parts) > 1 and not parts[-1].strip() and row.endswith("|") else None]
    return [p.strip(" \t").replace("\\|", "|") for p in parts]


def _settle(rows: list[_Block], leaf: _Block) -> None:
    """Take the link definitions that a paragraph starts with out of it."""
    text = "\n".join(leaf.lines)
    while text.lstrip(" ").startswith("["):
        found = DEFINITION.match(text) or DEFINITION_ALONE.match(text)
        if not found or not found[1].strip() or found[1].startswith("^"):
            break
        dest = found[2][1:-1] if found[2].startswith("<") else found[2]
        made = _Block(rows, leaf.parent, "definition", leaf.first, info=inlines.label(found[1]), title=inlines.unescaped(found[3][1:-1]) if found[3] else None)
        lines = found[0].rstrip("\n").count("\n") + 1
        made.lines, made.last = [inlines.unescaped(dest)], leaf.first + lines - 1
        leaf.first += lines
        text = text[found.end() :]
    leaf.lines = text.split("\n") if text else []
    leaf.dropped = not leaf.lines


def fold(text: str | None) -> list[_Block]:
    """The blocks of one document in order of their start, the document's own first."""
    rows: list[_Block] = []
    root = _Block(rows, None, "document", 0)
    stack, leaf = [root], None
    lines = LINE_END.split((text or "").replace("\0", "�"))

    def close_leaf() -> None:
        nonlocal leaf
        if leaf is not None and leaf.kind == "paragraph":
            _settle(rows, leaf)
        leaf = None

    def opened(kind: str, **more: object) -> _Block:
        nonlocal leaf
        close_leaf()
        if kind != "listItem":
            stack[-1].list = None
        return _Block(rows, stack[-1].list if kind == "listItem" else stack[-1], kind, no, **more)

    for no, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
        rest, column, depth = line, 0, 1
        for box in stack[1:]:
            wide, blank = _lead(rest, column), not rest.strip(" \t")
            if box.kind == "blockquote":
                if wide >= LEAST_CODE or rest.lstrip(" \t")[:1] != ">":
                    break
                rest, column = _drop(rest, column, wide)
                rest, column = _drop(rest[1:], column + 1, 1)
            elif blank:
                if not box.children and no > box.first and leaf is None:
                    break
            elif wide >= box.indent:
                rest, column = _drop(rest, column, box.indent)
            else:
                break
            depth += 1
        whole = depth == len(stack)
        blank = not rest.strip(" \t")
        if whole and leaf is not None and leaf.kind in ("codeBlock", "htmlBlock", "table"):
            wide, bare = _lead(rest, column), rest.strip(" \t")
            if "fence" in leaf.more:
                fence = leaf.more["fence"]
                if wide < LEAST_CODE and len(bare) >= len(fence) and bare == fence[0] * len(bare):
                    leaf.last, leaf = no, None
                else:
                    leaf.lines.append(_drop(rest, column, leaf.indent)[0])
                for box in (*stack, *([leaf] if leaf else [])):
                    box.last = no
                continue
            if leaf.kind == "codeBlock" and (wide >= LEAST_CODE or blank):
                leaf.lines.append(_drop(rest, column, LEAST_CODE)[0])
                for box in () if blank else (*stack, leaf):
                    box.last = no
                continue
            if leaf.kind == "htmlBlock":
                end = leaf.more["end"]
                if end is None and blank:
                    leaf = None
                else:
                    leaf.lines.append(rest)
                    for box in (*stack, leaf):
                        box.last = no
                    if end is not None and end.search(rest):
                        leaf = None
                    continue
            elif leaf.kind == "codeBlock":
                leaf = None
        held, made = leaf if leaf is not None and leaf.kind == "paragraph" else None, None
        while not blank:
            wide, bare = _lead(rest, column), rest.lstrip(" \t")
            inside = held is not None and whole and leaf is held
            if wide >= LEAST_CODE:
                if held is None or leaf is not held:
                    del stack[depth:]
                    leaf = made = opened("codeBlock")
                    made.lines.append(_drop(rest, column, LEAST_CODE)[0])
                break
            item = ITEM.match(bare)
            opening = HTML[:6] if held is not None and leaf is held else HTML  # a lone tag does not interrupt a paragraph
            html = next((i for i, (start, _) in enumerate(opening) if start.match(bare)), None) if bare[0] == "<" else None
            if bare[0] == ">":
                del stack[depth:]
                stack.append(opened("blockquote"))
                rest, column = _drop(rest, column, wide)
                rest, column = _drop(rest[1:], column + 1, 1)
            elif found := HEADING.match(bare):
                del stack[depth:]
                made = opened("heading", level=len(found[1]))
                content = found[2].strip(" \t")
                made.lines.append("" if content.strip("#") == "" else content)
                break
            elif found := FENCE.match(bare):
                del stack[depth:]
                leaf = made = opened("codeBlock", fence=found[1] or found[3], info=inlines.unescaped((found[2] or found[4] or "").strip(" \t")))
                leaf.indent = wide
                break
            elif html is not None:
                del stack[depth:]
                leaf = made = opened("htmlBlock", end=HTML[html][1])
                made.lines.append(rest)
                if HTML[html][1] is not None and HTML[html][1].search(bare):
                    leaf = None
                break
            elif inside and (found := SETEXT.match(bare)) and (_settle(rows, held) or held.lines):
                held.kind, held.more, held.last, made = "heading", {"level": 1 if found[1][0] == "=" else 2}, no, held
                leaf = None
                break
            elif RULE.match(bare):
                del stack[depth:]
                made = opened("thematicBreak")
                break
            elif item and not (inside and (not bare[item.end() :].strip(" \t") or item[2] not in (None, "1"))):
                del stack[depth:]
                close_leaf()
                marker = item[1] or item[3]
                if stack[-1].list is None or stack[-1].list.more["marker"] != marker:
                    stack[-1].list = None
                    around = _Block(rows, stack[-1], "list", no, marker=marker, start=int(item[2]) if item[2] else None)
                    stack[-1].list = around
                box = opened("listItem", marker=marker)
                rest, column = _drop(rest, column, wide)
                rest, column = rest[item.end() :], column + item.end()
                gap = _lead(rest, column)
                gap = gap if 1 <= gap <= LEAST_CODE and rest.strip(" \t") else 1
                box.indent = wide + item.end() + gap
                rest, column = _drop(rest, column, gap)
                stack.append(box)
            elif (found := FOOTNOTE.match(bare)) and not inside:
                del stack[depth:]
                box = opened("footnoteDefinition", info=inlines.label(found[1]))
                box.indent = LEAST_CODE
                rest, column = bare[found.end() :], column + wide + found.end()
                stack.append(box)
            else:
                break
            depth, whole, blank = len(stack), True, not rest.strip(" \t")
        if made is None:
            bare = rest.lstrip(" \t")
            if held is not None and leaf is held and not blank:
                # goes on the paragraph, also where containers were not matched (a lazy line)
                header = cells(held.lines[-1]) if whole and DELIMITER_ROW.match(bare) and ("|" in bare or ":" in bare) else None
                if header is not None and "|" in held.lines[-1] + bare and len(header) == len(cells(bare)):
                    title = held.lines.pop()
                    if held.lines:
                        held.last = no - 2
                        leaf = _Block(rows, held.parent, "table", no - 1)
                        _settle(rows, held)
                    else:
                        held.kind, leaf = "table", held
                    leaf.more = {"info": " ".join({(False, False): "-", (True, False): "left", (False, True): "right", (True, True): "center"}[c[0] == ":", c[-1] == ":"] for c in cells(bare))}
                    leaf.lines, leaf.last = [title], no
                else:
                    held.lines.append(bare)
                    held.last = no
            else:
                was = len(stack)
                del stack[depth:]
                if blank or depth < was or (leaf is not None and leaf.kind != "table"):
                    close_leaf()
                if not blank:
                    if leaf is None:
                        leaf = opened("paragraph")
                    leaf.lines.append(bare)
                    leaf.last = no
        if not blank or made is not None:
            for box in stack:
                box.last = no
                if box.list is not None and box.list.children:
                    box.list.last = max(box.list.last, box.last)
    close_leaf()
    for row in reversed(rows):
        if row.kind == "codeBlock" and "fence" not in row.more:
            while row.lines and not row.lines[-1].strip(" \t"):
                row.lines.pop()
        if row.parent is not None and not row.dropped:
            row.parent.last = max(row.parent.last, row.last)
        if row.kind in ("paragraph", "heading") and row.lines:
            row.lines[-1] = row.lines[-1].rstrip(" \t")
    kept = sorted((r for r in rows if not r.dropped), key=lambda r: (r.first, r.n))
    places: dict[int, int] = {}
    for n, row in enumerate(kept):
        row.n = n
        if row.parent is not None:
            row.ordinal = places.get(id(row.parent), 0)
            places[id(row.parent)] = row.ordinal + 1
    return kept


def _list_of(row: _Block) -> int | None:
    """The list whose tightness the gap behind a row decides: an item's own, or that of the item it lies in."""
    item = row if row.kind == "listItem" else row.parent
    return item.parent.n if item is not None and item.kind == "listItem" else None


def _loose(rows: list[_Block]) -> set[int]:
    """Numbers of the lists of one document with a blank line between items, or between an item's blocks."""
    last: dict[int, _Block] = {}
    found = set()
    for row in rows:
        if row.parent is not None:
            before = last.get(row.parent.n)
            if before is not None and before.kind != "definition" and row.first - before.last > 1:
                found.add(_list_of(before))
            last[row.parent.n] = row
    return found


def _batched(names: list[str], kinds: list[pa.DataType], n_ids: int, batches: Iterator[pa.RecordBatch], rows_of: Callable[..., Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows that rows_of gives for each input row, some thousands a batch, behind that row's first n_ids columns."""
    for batch in batches:
        at: list[int] = []
        out: list[tuple] = []

        def flush(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            place = pa.array(at, pa.int32())
            made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            done = pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in range(n_ids)), *made], names)
            at.clear()
            out.clear()
            return done

        for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in range(n_ids, batch.num_columns)))):
            out.extend(rows_of(*values))
            at.extend([i] * (len(out) - len(at)))
            if len(out) >= BATCH_ROWS:
                yield flush()
        if out:
            yield flush()


def nested_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, block, parent, ordinal, kind, level, marker, start, info, title, text, first_line, last_line, tight).

    Block 0 is the document; others are numbered by their start, with their place among their
    parent's children from 0. level is a heading's, marker and start a list's, info a code block's
    info string, a table's alignments, or the label of a definition or footnote; a definition's
    text is its destination. tight is for lists: no blank line between items, nor between an
    item's blocks. A null text is a document without blocks. Rows that share an id are told apart
    by no column: number them first.
    """

    def rows_of(source: str | None) -> Iterator[tuple]:
        found = fold(source)
        loose = _loose(found)
        for r in found:
            content = "\n".join(r.lines) if r.lines or r.kind in ("heading", "codeBlock") else None
            more = map(r.more.get, ("level", "marker", "start", "info", "title")) if r.more else (None,) * 5
            yield (r.n, r.parent.n if r.parent else None, r.ordinal, r.kind, *more, content, r.first, r.last, r.n not in loose if r.kind == "list" else None)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["doc", *(c.split()[0] for c in BLOCKS.split(", "))]
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("t"))
    return chosen.mapInArrow(lambda batches: _batched(names, kinds, 1, batches, rows_of), f"doc {kind}, {BLOCKS}")


def definitions(blocks: DataFrame) -> DataFrame:
    """(doc, label, dest, title): the first definition of each label in a document of nested_blocks."""
    rows = blocks.where("kind = 'definition'")
    return rows.groupBy("doc", F.col("info").alias("label")).agg(F.min_by(F.struct(F.coalesce("text", F.lit("")).alias("dest"), "title"), "block").alias("d")).select("doc", "label", "d.dest", "d.title")


def folded_label(text: Column) -> Column:
    """A link label as labels are compared: trimmed, white space as one space, without case."""
    return F.lower(F.upper(F.trim(F.regexp_replace(text, r"\s+", " "))))


def inline_nodes(blocks: DataFrame) -> DataFrame:
    """(doc, block, node, parent, ordinal, kind, text, dest, title): inline trees of headings, paragraphs and table cells' rows.

    Each block is joined with the definitions of the labels that stand in its brackets, and no
    others. The blocks are written once, as all sides of these joins read them. node counts from 0, the block's root (kind inlines), in reading order. text is that
    of text, codeSpan, rawHtml and autolink nodes; dest and title are a link's or image's.
    """
    blocks = materialize(blocks.where("kind IN ('paragraph', 'heading', 'table', 'definition', 'footnoteDefinition')").select("doc", "block", "kind", "info", "title", "text"))
    texts = blocks.where("kind IN ('paragraph', 'heading', 'table') AND text IS NOT NULL").select("doc", "block", "text")
    wanted = texts.select("doc", "block", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\[((?:[^\[\]\\]|\\.)+)\]"), F.lit(1)), folded_label))).alias("label"))
    known = definitions(blocks).select("doc", folded_label(F.col("label")).alias("label"), "dest", "title").union(
        blocks.where("kind = 'footnoteDefinition'").select("doc", F.concat(F.lit("^"), folded_label(F.col("info"))), F.lit(""), F.lit(None).cast("string"))
    )
    known = known.withColumnsRenamed({"doc": "_doc", "label": "_label"})
    met = wanted.join(known, wanted["doc"].eqNullSafe(known["_doc"]) & (wanted["label"] == known["_label"]))
    held = met.groupBy("_doc", F.col("block").alias("_block")).agg(F.collect_list(F.struct("label", "dest", "title")).alias("known"))
    rows = texts.join(held, texts["doc"].eqNullSafe(held["_doc"]) & (texts["block"] == held["_block"]), "left").select("doc", "block", "text", "known")

    def rows_of(source: str, known: list[dict] | None) -> list[inlines.Node]:
        return inlines.parse(source, {d["label"]: (d["dest"], d["title"]) for d in known or ()})

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["doc", "block", "node", "parent", "ordinal", "kind", "text", "dest", "title"]
    kind = blocks.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _batched(names, kinds, 2, batches, rows_of), f"doc {kind}, block long, node long, parent long, ordinal int, kind string, text string, dest string, title string")
