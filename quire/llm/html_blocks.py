"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. A block's features are its number of words
and link density, those of its neighbours, and what encloses it; a decision tree trained on
a small labelled table says which blocks are the article's.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.texts import bytes_of, small_batches

# Element names by the way they take part in blocks.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED_TAGS = frozenset("head template svg math object select button datalist canvas audio video applet map noscript".split())
CHROME_TAGS = frozenset("nav aside footer form menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind ends an open element of the second, up to the third.
IMPLIED_ENDS = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
CHROME_NAMES = frozenset(
    "ad ads advert advertisement adverts adbox banner billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus"
    " footer gdpr hidden masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted recommended"
    " related respond reply replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget disclaimer alert".split()
)
ARTICLE_NAMES = frozenset("article articlebody entry post story content main text body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Za-z]+")
#: Class compounds that say something about an element's state, not what it is.
_STATE = re.compile(r"(?:has|with|without|no|not|overflow)[-_]|.*[-_](?:enabled|disabled|fixed|open|closed)$")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    chrome: bool
    article: bool
    heading: bool


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "chrome", "article", "elsewhere", "heading")

# The labelled table. Each row has the FEATURES and whether the block is the
# article's; elsewhere means outside the article of a page that marks one.
LABELLED = [
    (40, 0.0, 35, 0.0, 50, 0.0, 0, 1, 0, 0, True),
    (3, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 0, True),
    (1, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0, 0, True),
    (1, 0.0, 2, 1.0, 1, 0.0, 0, 1, 0, 0, True),
    (8, 0.0, 12, 0.0, 25, 0.0, 0, 1, 0, 1, True),
    (6, 0.0, 9, 0.0, 4, 0.0, 0, 1, 0, 1, True),
    (5, 1.0, 8, 0.0, 70, 0.0, 0, 1, 0, 1, True),
    (4, 1.0, 60, 0.0, 40, 0.0, 0, 1, 0, 0, True),
    (20, 0.3, 40, 0.0, 30, 0.1, 0, 1, 0, 0, True),
    (2, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 0, True),
    (300, 0.0, 8, 0.0, 5, 0.0, 0, 1, 0, 0, True),
    (12, 0.1, 9, 0.0, 6, 0.0, 0, 1, 0, 0, True),
    (40, 0.0, 35, 0.0, 50, 0.0, 1, 1, 0, 0, False),
    (5, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 0, False),
    (2, 1.0, 2, 1.0, 2, 1.0, 1, 1, 0, 0, False),
    (6, 0.0, 40, 0.0, 20, 0.0, 1, 1, 0, 1, False),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0, False),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0, False),
    (9, 0.0, 30, 0.0, 0, 0.0, 1, 0, 1, 0, False),
    (80, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0, False),
    (8, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0, False),
    (30, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0, False),
    (120, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1, 0, False),
    (3, 0.0, 0, 0.0, 10, 0.0, 0, 0, 1, 1, False),
    (7, 1.0, 5, 1.0, 7, 1.0, 0, 0, 1, 0, False),
    (50, 0.0, 40, 0.0, 45, 0.0, 0, 0, 1, 0, False),
    (15, 0.0, 20, 0.0, 25, 0.0, 0, 0, 1, 0, False),
    (40, 0.1, 2, 1.0, 90, 0.0, 0, 0, 1, 0, False),
    (60, 0.0, 90, 0.0, 40, 0.0, 0, 0, 1, 0, False),
    (25, 0.0, 30, 0.0, 60, 0.0, 0, 0, 1, 1, False),
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, False),
    (25, 0.0, 1, 1.0, 40, 0.0, 1, 0, 0, 0, False),
    (60, 0.0, 50, 0.0, 4, 0.0, 1, 0, 0, 0, False),
    (12, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0, False),
    (4, 0.0, 3, 0.0, 3, 0.0, 1, 0, 0, 1, False),
    (45, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, True),
    (25, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0, True),
    (60, 0.1, 8, 0.0, 30, 0.0, 0, 0, 0, 0, True),
    (18, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, True),
    (5, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, True),
    (14, 0.0, 20, 0.0, 3, 1.0, 0, 0, 0, 0, True),
    (30, 0.2, 25, 0.0, 2, 1.0, 0, 0, 0, 0, True),
    (7, 0.0, 2, 1.0, 45, 0.0, 0, 0, 0, 1, True),
    (5, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1, True),
    (9, 0.0, 0, 0.0, 20, 0.0, 0, 0, 0, 1, True),
    (150, 0.0, 60, 0.0, 80, 0.0, 0, 0, 0, 0, True),
    (400, 0.02, 9, 0.0, 3, 0.0, 0, 0, 0, 0, True),
    (120, 0.0, 100, 0.0, 2, 1.0, 0, 0, 0, 0, True),
    (95, 0.1, 2, 1.0, 0, 0.0, 0, 0, 0, 0, True),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, False),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, False),
    (6, 0.9, 40, 0.0, 5, 1.0, 0, 0, 0, 0, False),
    (2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, False),
    (1, 1.0, 1, 1.0, 90, 0.0, 0, 0, 0, 0, False),
    (3, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, False),
    (4, 0.8, 45, 0.0, 50, 0.0, 0, 0, 0, 0, False),
    (10, 0.8, 3, 1.0, 8, 0.9, 0, 0, 0, 0, False),
    (30, 0.9, 25, 0.9, 20, 0.8, 0, 0, 0, 0, False),
    (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, False),
    (3, 0.0, 1, 1.0, 3, 0.0, 0, 0, 0, 0, False),
    (6, 0.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0, False),
    (5, 0.5, 3, 1.0, 0, 0.0, 0, 0, 0, 0, False),
    (4, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1, False),
]


def grow(rows: list[tuple[Any, ...]], depth: int = 6) -> Any:
    """A decision tree by Gini impurity: a leaf is a verdict, a node (feature, threshold, low, high)."""
    labels = [r[-1] for r in rows]
    if depth == 0 or len(set(labels)) == 1:
        return 2 * sum(labels) >= len(labels)

    def impurity(part: list[tuple[Any, ...]]) -> float:
        share = sum(r[-1] for r in part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({r[feature] for r in rows})
        for low, high in zip(values, values[1:]):
            at = (low + high) / 2
            parts = [r for r in rows if r[feature] <= at], [r for r in rows if r[feature] > at]
            score = impurity(parts[0]) + impurity(parts[1])
            if best is None or score < best[0] - 1e-12:
                best = score, feature, at, parts
    if best is None:
        return 2 * sum(labels) >= len(labels)
    return best[1], best[2], grow(best[3][0], depth - 1), grow(best[3][1], depth - 1)


def decide(tree: Any, features: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        feature, at, low, high = tree
        tree = low if features[feature] <= at else high
    return tree


def _context(name: str, attributes: str) -> tuple[int, bool]:
    """Whether an element is page furniture (1 by a class or id alone, 2 by more), and whether it marks the article."""
    if not attributes.strip():
        return 2 * (name in CHROME_TAGS), name in ARTICLE_TAGS
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    tokens = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", t).lower() for k in ("class", "id") for t in given.get(k, "").split()]
    names = {n for t in tokens if not _STATE.match(t) for n in _NAME.findall(t)}
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    marks = name in ARTICLE_TAGS or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
    named = bool(names & CHROME_NAMES) and not ARTICLE_NAMES & set(tokens) and name not in ("html", "body") and not marks
    return 2 if name in CHROME_TAGS or role in CHROME_ROLES or hidden else int(named), marks


class _Open(NamedTuple):
    """An open element, with what it and the elements around it say together."""

    name: str
    hard: bool
    soft: bool
    article: bool
    header: bool
    heading: bool
    skipped: bool
    link: bool


_ROOT = _Open("", False, False, False, False, False, False, False)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what encloses each."""
    out: list[Block] = []
    stack: list[_Open] = []
    open_names: Counter[str] = Counter()
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            top = stack[-1] if stack else _ROOT
            chrome = top.hard or top.soft or (top.header and not (top.article and top.heading))
            out.append(Block(" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()), chrome, top.article, top.heading))
        text.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw and not (stack and stack[-1].skipped):
            text.append(raw)
            if stack and stack[-1].link:
                linked.append(raw)

    def push(name: str, attributes: str) -> None:
        above = stack[-1] if stack else _ROOT
        furniture, mark = _context(name, attributes)
        soft = furniture > 0 or (above.soft and not mark)  # a name outside an article ends at its mark
        is_header = above.header or name == "header"
        stack.append(_Open(name, above.hard or furniture == 2, soft, above.article or mark, is_header, above.heading or name in HEADINGS, above.skipped or name in SKIPPED_TAGS, above.link or name == "a"))
        open_names[name] += 1

    def close(names: str | frozenset[str], stop: str = "") -> None:
        if not any(open_names[n] for n in (names.split() if isinstance(names, str) else names)):
            return
        ends = stop.split()
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in names:
                open_names.subtract(s.name for s in stack[i:])
                del stack[i:]
                return
            if stack[i].name in ends:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            say(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
        if m[1]:
            close(frozenset([name]))
            continue
        if name in RAW_TAGS:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID_TAGS:
            continue
        if name == "body":
            close(frozenset(["head"]))
        if name in BLOCK_TAGS and name != "html":
            close(frozenset("p"), "td th article section div li body button")
        if name in IMPLIED_ENDS:
            ended, until = IMPLIED_ENDS[name]
            close(frozenset(ended.split()), until)
        if name in HEADINGS and stack and stack[-1].name in HEADINGS:
            open_names[stack.pop().name] -= 1
        if name == "a":
            close(frozenset("a"), "table td")
        if not m[3].rstrip().endswith("/") or name in BLOCK_TAGS:
            push(name, m[3])
    flush()
    return out


def main_text(page: str | None, tree: Any) -> str:
    """The article's blocks joined by a line feed; empty if there are none.

    Blocks inside a marked article and outside furniture always stay; the tree decides the others.
    """
    found = blocks(page or "")
    marked = any(b.article and not b.chrome for b in found)
    ends = Block("", 0, 0, False, False, False)
    kept = []
    for before, b, after in zip([ends, *found], found, [*found[1:], ends]):
        around = [x for n in (b, before, after) for x in (n.words, n.linked / max(1, n.words))]
        features = (*around, float(b.chrome), float(b.article), float(marked and not b.article), float(b.heading))
        if (b.article and not b.chrome) or decide(tree, features):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, without a shuffle.

    Null pages are empty and have no text; malformed markup is read as far as it goes;
    repeated rows stay; columns other than these three are not read; an empty table gives an
    empty result.
    """
    small_batches(pages.sparkSession)
    tree = grow(LABELLED)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.decode("utf-8", "replace") if p else p, tree) for p in batch.column(2).to_pylist()], pa.string())
            n_chars = pa.compute.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, n_chars], [id_col, "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col), F.col(url).cast("string").alias("url"), bytes_of(page).alias("_html"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")
