"""The inline tree of one Markdown text: a fold of its tokens with stacks of delimiter runs and brackets.

Tokens are cut by one pattern. A closing bracket looks for its opener, then for a destination or
a known label behind it; emphasis inside is settled first. A run of delimiters pairs with the
nearest run before it that may open, unless the rule of three forbids it. Pairs leave marks at
their runs, inner ones first, so the tree follows from one pass over the marks.
"""

from __future__ import annotations

import html
import re
import unicodedata

# Patterns of the syntax.
ESCAPABLE = r"[!-/:-@\[-`{-~]"
ATTRIBUTE = r"""\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
TOKENS = re.compile(
    rf"(?P<escape>\\{ESCAPABLE})|(?P<hard>(?: {{2,}}|\\)\n[ \t]*)|(?P<soft> ?\n[ \t]*)|(?P<ticks>`+)"
    r"|(?P<auto><(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>)"
    rf"|(?P<raw>{OPEN_TAG}|{CLOSE_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>)"
    r"|(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<run>\*+|_+|~+)|(?P<open>!?\[)|(?P<close>\])",
    re.S,
)
TARGET = re.compile(r"""\(\s*(?:(<(?:[^<>\n\\]|\\.)*>|(?![<)])(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))+)(?:\s+("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?)?\s*\)""", re.S)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_ESCAPED = re.compile(rf"\\({ESCAPABLE})|(&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,31}});)")

#: (node, parent, ordinal, kind, text, dest, title)
Node = tuple[int, int | None, int, str, str | None, str | None, str | None]


def entity(source: str) -> str:
    """The characters of a reference, itself where the name is not known; zero and what is no character become U+FFFD."""
    if source[1] == "#":
        code = int(source[3:-1], 16) if source[2] in "xX" else int(source[2:-1])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    return html.entities.html5.get(source[1:], source)


def unescaped(text: str) -> str:
    """text with backslash escapes and character references resolved."""
    return _ESCAPED.sub(lambda m: m[1] or entity(m[2]), text)


def label(text: str) -> str:
    """A link label as labels are compared."""
    return re.sub(r"\s+", " ", text.strip()).upper().lower()


def _flanks(before: str, after: str, char: str) -> tuple[bool, bool]:
    """Whether a run between two characters may open, and whether it may close."""
    space = [c == "" or c.isspace() for c in (before, after)]
    mark = [c != "" and unicodedata.category(c)[0] in "PS" for c in (before, after)]
    left = not space[1] and (not mark[1] or space[0] or mark[0])
    right = not space[0] and (not mark[0] or space[1] or mark[1])
    if char == "_":
        return left and (not right or mark[0]), right and (not left or mark[1])
    return left, right


class _Token:
    """Text or a node without children; before and after hold the marks of pairs that end or begin here."""

    def __init__(self, kind: str, text: str, dest: str | None = None, title: str | None = None):
        self.kind, self.text, self.dest, self.title = kind, text, dest, title
        self.before: list[tuple[str, str | None, str | None]] = []
        self.after: list[tuple[str, str | None, str | None]] = []
        self.opens = self.closes = False
        self.size = len(text)


def _emphasise(runs: list[_Token]) -> None:
    """Pair the delimiter runs among tokens, in order, each with the nearest that fits."""
    waiting: list[_Token] = []
    floor: dict[tuple[str, bool, int], int] = {}
    for run in runs:
        char = run.text[:1]
        while run.closes and run.text:
            key = (char, run.opens, run.size % 3)
            found = None
            for at in range(len(waiting) - 1, floor.get(key, 0) - 1, -1):
                one = waiting[at]
                if one.text[:1] != char:
                    continue
                odd = (run.opens or one.closes) and (run.size + one.size) % 3 == 0 and (run.size % 3 or one.size % 3)
                if not odd if char != "~" else len(one.text) == len(run.text):
                    found = at
                    break
            if found is None:
                floor[key] = len(waiting)
                break
            one = waiting[found]
            del waiting[found + 1 :]
            floor = {k: min(v, found + 1) for k, v in floor.items()}
            used = len(run.text) if char == "~" else 2 if len(run.text) > 1 and len(one.text) > 1 else 1
            mark = ("strikethrough" if char == "~" else "strong" if used == 2 else "emphasis", None, None)
            one.after.insert(0, mark)
            run.before.append(mark)
            one.text, run.text = one.text[used:], run.text[used:]
            if not one.text:
                waiting.pop()
                floor = {k: min(v, found) for k, v in floor.items()}
        if run.text and run.opens:
            waiting.append(run)


def _code(text: str) -> str:
    body = text.replace("\n", " ")
    return body[1:-1] if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" ") else body


def tokens(text: str, known: dict[str, tuple[str, str | None]]) -> list[_Token]:
    """The tokens of a text with the marks of all pairs; known has destination and title of labels."""
    out: list[_Token] = []
    brackets: list[tuple[int, bool, int, bool]] = []  # place in out, image, end in text, active
    ticks = {}
    for found in re.finditer(r"`+", text):
        ticks.setdefault(len(found[0]), []).append(found.start())
    at, plain = 0, 0

    def put(kind: str, value: str, *more: str | None) -> _Token:
        out.append(_Token(kind, value, *more))
        return out[-1]

    while found := TOKENS.search(text, at):
        kind, source, at = found.lastgroup, found[0], found.end()
        if plain < found.start():
            put("text", text[plain : found.start()])
        plain = at
        if kind == "ticks":
            ends = ticks[len(source)]
            while ends and ends[0] < at:
                ends.pop(0)
            if ends:
                put("codeSpan", _code(text[at : ends[0]]))
                at = plain = ends[0] + len(source)
            else:
                put("text", source)
        elif kind == "escape":
            put("text", source[1:])
        elif kind in ("hard", "soft"):
            put(f"{kind}Break", "")
        elif kind == "auto":
            put("autolink", source[1:-1], source[1:-1] if re.match(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:", source) else f"mailto:{source[1:-1]}")
        elif kind == "raw":
            put("rawHtml", source)
        elif kind == "entity":
            put("text", entity(source))
        elif kind == "run":
            run = put("run" if source[0] != "~" or len(source) < 3 else "text", source)
            if run.kind == "run":
                run.opens, run.closes = _flanks(text[found.start() - 1 : found.start()] if found.start() else "", text[at : at + 1], source[0])
        elif kind == "open":
            brackets.append((len(out), source[0] == "!", at, True))
            put("text", source)
        else:
            put("text", "]")
            if not brackets:
                continue
            place, image, inner, active = brackets.pop()
            if not active:
                continue
            body, dest, end = text[inner : found.start()], None, at
            target, after = TARGET.match(text, at), LABEL.match(text, at)
            if target:
                dest, end = (unescaped((target[1] or "").removeprefix("<").removesuffix(">") if (target[1] or "").startswith("<") else target[1] or ""), unescaped(target[2][1:-1]) if target[2] else None), target.end()
            elif after and label(after[1]):
                dest, end = known.get(label(after[1])), after.end()
            if dest is None and not target and not (after and label(after[1])) and not re.search(r"(?<!\\)\[", body):
                dest, end = known.get(label(body)), after.end() if after else at
            if dest is None:
                continue
            if body.startswith("^") and not target and not image:
                out[place:] = [_Token("footnoteReference", label(body[1:]))]
            else:
                _emphasise([t for t in out[place + 1 : -1] if t.kind == "run"])
                for t in out[place + 1 : -1]:
                    t.kind = "text" if t.kind == "run" else t.kind
                mark = ("image" if image else "link", *dest)
                out[place].text = out[-1].text = ""
                out[place].after.append(mark)
                out[-1].before.append(mark)
                if not image:
                    brackets = [(p, i, e, a and i) for p, i, e, a in brackets]
            at = plain = end
    if plain < len(text):
        put("text", text[plain:])
    _emphasise([t for t in out if t.kind == "run"])
    return out


def parse(text: str, known: dict[str, tuple[str, str | None]]) -> list[Node]:
    """The nodes of a text in reading order, the root (kind inlines) first; neighbouring texts are one."""
    nodes: list[list] = [[0, None, 0, "inlines", None, None, None]]
    stack, children = [0], [0]

    def add(kind: str, value: str | None, dest: str | None = None, title: str | None = None) -> None:
        nodes.append([len(nodes), stack[-1], children[-1], kind, value, dest, title])
        children[-1] += 1

    for token in tokens(text, known):
        for _ in token.before:
            stack.pop()
            children.pop()
        if token.kind in ("text", "run"):
            if token.text:
                last = nodes[-1]
                if last[3] == "text" and last[1] == stack[-1] and last[2] == children[-1] - 1:
                    last[4] += token.text
                else:
                    add("text", token.text)
        elif token.kind in ("hardBreak", "softBreak"):
            add(token.kind, None)
        else:
            add(token.kind, token.text, token.dest, token.title)
        for kind, dest, title in token.after:
            add(kind, None, dest, title)
            stack.append(len(nodes) - 1)
            children.append(0)
    return [tuple(n) for n in nodes]
