import html
import re
import time

from quire.llm import html_blocks

TREE = html_blocks.grow(html_blocks.LABELLED)
LONG = " ".join(f"word{i}" for i in range(40)) + "."
MORE = " ".join(f"other{i}" for i in range(30)) + "."


def text(page):
    return html_blocks.main_text(page, TREE)


def test_given_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = spark.createDataFrame([(-1, "u", None), (-2, None, ""), (-3, "u", "<p>"), (-3, "u", "<p>")], "page_id long, url string, html string")
    both = pages.unionByName(odd).selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS _html")
    given = {r.page_id: r.html for r in both.collect()}
    out = html_blocks.extract(both).collect()
    assert len(out) == pages.count() + 4
    for r in out:
        found = re.search(r"<article>(.*?)</article>", given[r.page_id] or "", re.DOTALL)
        parts = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ")) if found else []
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert html_blocks.extract(both.limit(0)).collect() == []


def test_page_furniture_is_left_out():
    page = f"""<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
    <header class=top><h1>Site</h1><a href=/>Home</a></header><nav><a href=/a>Menu</a></nav>
    <div class="cookie-notice">We use cookies. {MORE}</div>
    <main><article><header><h1>The &amp; title</h1><p>By someone</p></header><p>{LONG}<p>{MORE}
    <aside>Related: {LONG}</aside><form><label>Mail <input name=x></label><button>Send</button></form>
    <ul><li>first<li>second</ul><div class="ad-box">{MORE}</div>
    <section id="comments"><p>A reader says: {LONG}</p></section></article></main>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; {MORE}</footer><!-- <p>gone</p> --></body></html>"""
    assert text(page) == "\n".join(["The & title", LONG, MORE, "first", "second"])


def test_page_without_marks_is_read_by_length_and_links():
    links = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6))
    page = f"<body><ul>{links}</ul><div>{LONG}</div><div>{MORE}</div><div>{LONG}<br>{MORE} &lt;b&gt; &eacute;&nbsp;x</div><ul>{links}</ul>"
    assert text(page) == "\n".join([LONG, MORE, f"{LONG} {MORE} <b> é x"])


def test_broken_markup():
    assert text("<article><p>a < b and c<p title='x > y'>d &am e</article") .startswith("a < b and c\nd &am e")
    assert text("<article><script>never closed <p>x") == ""
    assert text("<article>one<!-- open <p>two") == "one"
    assert text("plain " * 50) == " ".join(["plain"] * 50)
    assert len(text("<article>" + "<div>" * 3000 + "deep" + "<p>word " * 2000)) > 4


def test_article_in_a_wrapper_named_like_furniture():
    for name in ("layout has-sidebar", "overflow-hidden", "with-comments", "share-enabled", "navbar-fixed", "noSidebar", "sidebar", "widget"):
        page = f'<body><div class="{name}"><article><h1>The title</h1><p>{LONG}</p><p>{MORE}</p><div class="share">{MORE}</div></article></div></body>'
        assert text(page) == "\n".join(["The title", LONG, MORE]), name
    for name in ("layout has-sidebar", "overflow-hidden", "with-comments", "share-enabled", "navbar-fixed", "noSidebar"):
        assert text(f'<body><div class="{name}"><p>{LONG}</p><p>{MORE}</p></div></body>') == "\n".join([LONG, MORE]), name
    assert text(f"<body><aside><article><p>{LONG}</p></article></aside><div class=sidebar><p>{LONG}</p></div></body>") == ""
    for name in ("sidebar-left", "is-hidden", "visually-hidden", "js-cookie-banner", "navbar-fixed-top", "cookieNotice"):
        assert text(f'<body><div class="{name}"><p>{LONG}</p></div><div><p>{MORE}</p><p>{LONG}</p></div></body>') == "\n".join([MORE, LONG]), name


def test_all_blocks_of_a_marked_article_stay():
    assert text(f"<article><h1>Storm hits coast</h1><p><a href=/m>Full map</a></p><p>{LONG}</p></article>") == "\n".join(["Storm hits coast", "Full map", LONG])
    assert text(f"<article><p>By Ann.</p><p><a href=/x>{MORE}</a></p><p>{LONG}</p></article>") == "\n".join(["By Ann.", MORE, LONG])
    assert text(f'<body><div class="content share"><p>{LONG}</p><p>{MORE}</p></div></body>') == "\n".join([LONG, MORE])
    assert text(f'<body><div class="comment-content"><p>{LONG}</p></div><div><p>{MORE}</p><p>{LONG}</p></div></body>') == "\n".join([MORE, LONG])


def test_deep_and_unclosed_tags_take_time_in_proportion():
    began = time.time()
    assert text("<article>" + "<div>word " * 100_000).count("word") == 100_000
    assert text("<article>" + "<b>" * 100_000 + "word" + "</i></p>" * 100_000) == "word"
    assert text("<article>" + "<p>word" * 100_000).count("word") == 100_000
    assert time.time() - began < 30
