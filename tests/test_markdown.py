"""Nested Markdown blocks and inline trees on examples of the syntax's specification."""

import pyarrow as pa
import pytest

from quire.operators import inlines, markdown


def tree(text):
    """Blocks as kind(children) or kind:text."""
    rows = markdown.fold(text)

    def show(row):
        inner = " ".join(show(r) for r in rows if r.parent is row)
        own = "\n".join(row.lines)
        return row.kind + (f"({inner})" if inner else f":{own!r}" if own else "")

    return " ".join(show(r) for r in rows if r.parent is rows[0])


def line(text, known=None):
    """Inline nodes as kind(children), kind:text or quoted text."""
    nodes = inlines.parse(text, known or {})

    def show(n):
        inner = " ".join(show(m) for m in nodes if m[1] == n[0])
        if n[3] == "text":
            return repr(n[4])
        link = "" if n[5] is None else f"[{n[5]}{'' if n[6] is None else ' ' + n[6]}]"
        return n[3] + link + (f"({inner})" if inner else f":{n[4]}" if n[4] is not None else "")

    return " ".join(show(m) for m in nodes if m[1] == 0)


BLOCKS = [
    ("  - foo\n\n\tbar", "list(listItem(paragraph:'foo' paragraph:'bar'))"),
    ("- foo\n\n\t\tbar", "list(listItem(paragraph:'foo' codeBlock:'  bar'))"),
    (">\t\tfoo", "blockquote(codeBlock:'  foo')"),
    ("- `one\n- two`", "list(listItem(paragraph:'`one') listItem(paragraph:'two`'))"),
    ("- Foo\n- * * *", "list(listItem(paragraph:'Foo') listItem(thematicBreak))"),
    ("* Foo\n* * *\n* Bar", "list(listItem(paragraph:'Foo')) thematicBreak list(listItem(paragraph:'Bar'))"),
    ("Foo\n***\nbar", "paragraph:'Foo' thematicBreak paragraph:'bar'"),
    ("Foo\n---\nbar", "heading:'Foo' paragraph:'bar'"),
    ("## foo ##  ", "heading:'foo'"),
    ("### foo \\###\n#5 bolt", "heading:'foo \\\\###' paragraph:'#5 bolt'"),
    ("Foo\nBar\n===", "heading:'Foo\\nBar'"),
    ("> Foo\n---", "blockquote(paragraph:'Foo') thematicBreak"),
    ("- Foo\n---", "list(listItem(paragraph:'Foo')) thematicBreak"),
    ("1.  a\n\n    - b", "list(listItem(paragraph:'a' list(listItem(paragraph:'b'))))"),
    ("    a\n\n\n    b\n  \n", "codeBlock:'a\\n\\n\\nb'"),
    ("Foo\n    bar", "paragraph:'Foo\\nbar'"),
    ("```\naaa\n~~~\n```\nx", "codeBlock:'aaa\\n~~~' paragraph:'x'"),
    ("  ```\n  aaa\n    b\n ```", "codeBlock:'aaa\\n  b'"),
    ("> ```\n> aaa\n\nbbb", "blockquote(codeBlock:'aaa') paragraph:'bbb'"),
    ("<div>\n*hi*\n\nx", "htmlBlock:'<div>\\n*hi*' paragraph:'x'"),
    ("Foo\n<div>\nbar\n</div>", "paragraph:'Foo' htmlBlock:'<div>\\nbar\\n</div>'"),
    ("Foo\n<a href=\"b\">\nbaz", "paragraph:'Foo\\n<a href=\"b\">\\nbaz'"),
    ("<!-- a\n\nb -->\nc", "htmlBlock:'<!-- a\\n\\nb -->' paragraph:'c'"),
    ("[foo]: /url \"t\"\n\n[foo]", "definition:'/url' paragraph:'[foo]'"),
    ("[foo]: /a\n[bar]: <b c>\n'x'\ntext", "definition:'/a' definition:'b c' paragraph:'text'"),
    ("[foo]: /url 'title' ok", "paragraph:\"[foo]: /url 'title' ok\""),
    ("> # Foo\n> bar\n> baz", "blockquote(heading:'Foo' paragraph:'bar\\nbaz')"),
    ("> bar\nbaz\n> foo", "blockquote(paragraph:'bar\\nbaz\\nfoo')"),
    ("> - foo\n- bar", "blockquote(list(listItem(paragraph:'foo'))) list(listItem(paragraph:'bar'))"),
    (">     foo\n    bar", "blockquote(codeBlock:'foo') codeBlock:'bar'"),
    ("> > > foo\nbar", "blockquote(blockquote(blockquote(paragraph:'foo\\nbar')))"),
    ("> a\n\n> b", "blockquote(paragraph:'a') blockquote(paragraph:'b')"),
    ("- one\n\n two", "list(listItem(paragraph:'one')) paragraph:'two'"),
    ("   > > 1.  one\n>>\n>>     two", "blockquote(blockquote(list(listItem(paragraph:'one' paragraph:'two'))))"),
    (">>- one\n>>\n  >  > two", "blockquote(blockquote(list(listItem(paragraph:'one')) paragraph:'two'))"),
    ("1.  foo\n\n    ```\n    bar\n    ```\n\n    baz\n\n    > bam", "list(listItem(paragraph:'foo' codeBlock:'bar' paragraph:'baz' blockquote(paragraph:'bam')))"),
    ("1.     code\n\n   x", "list(listItem(codeBlock:'code' paragraph:'x'))"),
    ("-\n  foo\n-\n  ```\n  bar\n  ```", "list(listItem(paragraph:'foo') listItem(codeBlock:'bar'))"),
    ("-\n\n  foo", "list(listItem) paragraph:'foo'"),
    ("- foo\n-\n- bar", "list(listItem(paragraph:'foo') listItem listItem(paragraph:'bar'))"),
    ("foo\n*\n\nfoo\n1.", "paragraph:'foo\\n*' paragraph:'foo\\n1.'"),
    ("> 1. > Blockquote\ncontinued here.", "blockquote(list(listItem(blockquote(paragraph:'Blockquote\\ncontinued here.'))))"),
    ("- foo\n  - bar\n    - baz\n      - boo", "list(listItem(paragraph:'foo' list(listItem(paragraph:'bar' list(listItem(paragraph:'baz' list(listItem(paragraph:'boo'))))))))"),
    ("- a\n - b\n  - c\n   - d\n    - e", "list(listItem(paragraph:'a') listItem(paragraph:'b') listItem(paragraph:'c') listItem(paragraph:'d\\n- e'))"),
    ("- - foo\n1. - 2. bar", "list(listItem(list(listItem(paragraph:'foo')))) list(listItem(list(listItem(list(listItem(paragraph:'bar'))))))"),
    ("- foo\n- bar\n+ baz", "list(listItem(paragraph:'foo') listItem(paragraph:'bar')) list(listItem(paragraph:'baz'))"),
    ("The number is\n14.  doors", "paragraph:'The number is\\n14.  doors'"),
    ("The number is\n1.  doors", "paragraph:'The number is' list(listItem(paragraph:'doors'))"),
    ("| a | b |\n|---|:-:|\n| c | d\\|e |\n> q", "table:'| a | b |\\n| c | d\\\\|e |' blockquote(paragraph:'q')"),
    ("one\n| a |\n| - |\n| c |\n\nx", "paragraph:'one' table:'| a |\\n| c |' paragraph:'x'"),
    ("[^n]: note\n    more\n\n    part\n\nout", "footnoteDefinition(paragraph:'note\\nmore' paragraph:'part') paragraph:'out'"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "expected"), BLOCKS)
def test_blocks(text, expected):
    assert tree(text) == expected


INLINES = [
    ("*foo bar* a*b*c", "emphasis('foo bar') ' a' emphasis('b') 'c'"),
    ("a * foo bar* _foo bar_ foo_bar_baz", "'a * foo bar* ' emphasis('foo bar') ' foo_bar_baz'"),
    ("a*\"foo\"*", "'a*\"foo\"*'"),
    ("**foo** __foo__bar", "strong('foo') ' __foo__bar'"),
    ("***foo** bar*", "emphasis(strong('foo') ' bar')"),
    ("*foo **bar***", "emphasis('foo ' strong('bar'))"),
    ("*foo**bar**baz*", "emphasis('foo' strong('bar') 'baz')"),
    ("*foo**bar*", "emphasis('foo**bar')"),
    ("foo***bar***baz", "'foo' emphasis(strong('bar')) 'baz'"),
    ("foo******bar*********baz", "'foo' strong(strong(strong('bar'))) '***baz'"),
    ("**foo*", "'*' emphasis('foo')"),
    ("*foo**", "emphasis('foo') '*'"),
    ("****foo*", "'***' emphasis('foo')"),
    ("*foo _bar* baz_", "emphasis('foo _bar') ' baz_'"),
    ("**foo **bar baz**", "'**foo ' strong('bar baz')"),
    ("***foo***", "emphasis(strong('foo'))"),
    ("_____foo_____", "emphasis(strong(strong('foo')))"),
    ("пристаням_стремятся_ _(bar)_.", "'пристаням_стремятся_ ' emphasis('(bar)') '.'"),
    ("~~Hi~~ ~a~ ~~~b~~~", "strikethrough('Hi') ' ' strikethrough('a') ' ~~~b~~~'"),
    ("`` foo ` bar `` ` `` ` `a", "codeSpan:foo ` bar ' ' codeSpan:`` ' `a'"),
    ("`foo\\`bar`", "codeSpan:foo\\ 'bar`'"),
    ("*foo`*`", "'*foo' codeSpan:*"),
    ("\\*not\\* &amp; &copy; &#35; &nope; \\a", "'*not* & © # &nope; \\\\a'"),
    ("foo  \nbar\\\nbaz \nq", "'foo' hardBreak 'bar' hardBreak 'baz' softBreak 'q'"),
    ("<http://a.b?c> <me@x.org> <a href=\"b\"> <33>", "autolink[http://a.b?c]:http://a.b?c ' ' autolink[mailto:me@x.org]:me@x.org ' ' rawHtml:<a href=\"b\"> ' <33>'"),
    ("[link](/uri \"title\") [x](<b c>) [y]() [z](a b)", "link[/uri title]('link') ' ' link[b c]('x') ' ' link[]('y') ' [z](a b)'"),
    ("[l](foo(and(bar)))", "link[foo(and(bar))]('l')"),
    ("![a *b*](/u) [![m](n)](o)", "image[/u]('a ' emphasis('b')) ' ' link[o](image[n]('m'))"),
    ("[foo [bar](/uri)](/uri)", "'[foo ' link[/uri]('bar') '](/uri)'"),
    ("*[foo*](/uri)", "'*' link[/uri]('foo*')"),
    ("[foo *bar](baz*)", "link[baz*]('foo *bar')"),
    ("[a][Foo] [foo][] [FOO] [b][no] [foo] (x)", "link[/f t]('a') ' ' link[/f t]('foo') ' ' link[/f t]('FOO') ' [b][no] ' link[/f t]('foo') ' (x)'"),
    ("[foo`](x)`", "'[foo' codeSpan:](x)"),
    ("see[^n] [^m]", "'see' footnoteReference:n ' [^m]'"),
]


@pytest.mark.parametrize(("text", "expected"), INLINES)
def test_inlines(text, expected):
    assert line(text, {"foo": ("/f", "t"), "^n": ("", None)}) == expected


def test_many_delimiters_end():
    for text in ("*a_ " * 5000, "**x" * 5000, "[" * 20000, "[a](" * 5000, "`" * 20000, "`a``b" * 5000, "_(" * 5000 + ")_" * 5000):
        assert inlines.parse(text, {})


def test_as_rows(spark):
    text = "# T *x*\n\n- a\n  - b [r]\n\n- c\n\n> 1) q\n> 2) [r][]\n\n[r]: /first\n[R]: /second\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "[r]"), (None, "- x\n\n- [y]\n\n[y]: z")], "doc_id long, text string")
    blocks = markdown.nested_blocks(docs)
    rows = {(r.doc, r.block): r for r in blocks.collect()}
    lists = sorted((r.doc or 0, r.first_line, r.marker, r.start, r.tight) for r in rows.values() if r.kind == "list")
    assert lists == [(0, 0, "-", None, False), (1, 2, "-", None, False), (1, 3, "-", None, True), (1, 7, ")", 1, True)]
    assert rows[2, 0].kind == "document" and (2, 1) not in rows
    assert all(r.parent is None or (r.doc, r.parent) in rows for r in rows.values())
    assert sorted((r.label, r.dest) for r in markdown.definitions(blocks).collect()) == [("r", "/first"), ("y", "z")]
    nodes = markdown.inline_nodes(blocks).collect()
    assert sorted((r.doc or 0, r.dest) for r in nodes if r.kind == "link") == [(0, "z"), (1, "/first"), (1, "/first")]
    assert [r.text for r in nodes if r.doc == 3 and r.kind == "text"] == ["[r]"]
    assert [r.kind for r in sorted((r for r in nodes if r.doc == 1 and r.block == 1), key=lambda r: r.node)] == ["inlines", "text", "emphasis", "text"]


def test_batches_hold_many_documents():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["- a\n\n- b"] * 1000)], ["id", "t"])
    rows_of = lambda t: [(r.n,) for r in markdown.fold(t)]
    out = list(markdown._batched(["doc", "block"], [pa.int64()], 1, iter([batch]), rows_of))
    assert len(out) == 1 and out[0].num_rows == 6000
    assert out[0].column(0).to_pylist() == [i for i in range(1000) for _ in range(6)]


def test_tight_is_of_one_document_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, "- a\n- b"), (1, "- a\n\n- b")], "doc_id int, text string")
    assert sorted(r.tight for r in markdown.nested_blocks(docs).where("kind = 'list'").collect()) == [False, True]
