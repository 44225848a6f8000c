"""Page extraction on small fixed pages."""

import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespark.functions.css import BadSelector, css_flags
from pagespark.functions.html_tree import parse_nodes
from pagespark.functions.text import truncate_col
from pagespark.operators import ax, dom, expect, extract, find
from pagespark.sources.pages import save_html

BOARD = """<!doctype html><html><body><header><h1>Shop</h1></header><nav>Start Help</nav><aside>Offer</aside>
<main><div>Hello</div><div>Total: <b>42</b></div></main><footer>imprint</footer>
<div role="navigation">more links</div><div aria-hidden="true">unseen</div><svg><path/></svg>
<script>track(1)</script><style>p{color:red}</style></body></html>"""

FORM = """<html><head><title> Log  in </title></head><body><h1>Log in</h1><form>
<label>Email <input name="email" type="email" placeholder="you@site" value="a@b.c"></label>
<label for="pw">Password</label><input id="pw" type="password" disabled>
<fieldset disabled><input id="inner"></fieldset>
<select id="plan"><option value="f">Free</option><option value="p" selected>Pro</option></select>
<p hidden>secret</p><button type="submit" data-testid="go">Send form</button></form>
<ul id="items"><li class="todo">buy milk</li><li class="todo done">walk dog</li></ul></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_compact_views(spark):
    d = dom.build_dom(pages(spark, BOARD))
    text = extract.compact_text(d).first()["text"]
    assert text == "Hello\n\nTotal: 42"
    html = extract.compact_html(d).first()["html"]
    assert "<main><div>Hello</div><div>Total: <b>42</b></div></main>" in html
    for gone in ("Start", "Offer", "imprint", "more links", "unseen", "svg", "track", "color"):
        assert gone not in html


@pytest.mark.parametrize("html, want", [
    ("<body><p>a     b\t\tc</p></body>", "a b c"),
    ("<body><p>one</p><p>two</p><p>three</p></body>", "one\n\ntwo\n\nthree"),
    ("just text", "just text"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "ab\n\ncd"),
])
def test_text_rules(spark, html, want):
    assert extract.compact_text(dom.build_dom(pages(spark, html))).first()["text"] == want


def test_tree_rules():
    def shape(html):
        return [(r[2], r[5] or r[7]) for r in parse_nodes(html) if r[2] > 1]

    assert shape("<p><b>1<br><p>2</p>3") == [
        (2, "p"), (3, "b"), (4, "1"), (4, "br"), (2, "p"), (3, "b"), (4, "2"), (2, "b"), (3, "3")]
    assert shape("<ul><li>a<li>b</ul>c</p>") == [(2, "ul"), (3, "li"), (4, "a"), (3, "li"), (4, "b"), (2, "c"), (2, "p")]
    assert shape("<table><tr><td>x</table>y") == [(2, "table"), (3, "tbody"), (4, "tr"), (5, "td"), (6, "x"), (2, "y")]
    assert max(r[2] for r in parse_nodes("<div>" * 3000)) == 3001


def test_deep_pages_are_read(spark):
    for depth in (50, 300, 2000):
        html = "<div>" * depth + "<script>no()</script>deep text"
        got = extract.read_content(pages(spark, html), mode="text").first()
        assert got["content"].strip() == "deep text" and got["error"] is None


def test_many_dropped_subtrees(spark):
    html = "".join(f"<p>text {i}</p><script>no({i})</script><nav><p>menu</p></nav>" for i in range(8000))
    text = extract.read_content(pages(spark, html), mode="text", max_chars=10**7).first()["content"]
    assert text.count("text ") == 8000 and "no(" not in text and "menu" not in text
    kept = extract.strip_compact(extract.strip_compact(dom.build_dom(pages(spark, html[:50000])))).first()["nodes"]
    assert {n["tag"] for n in kept} == {"html", "head", "body", "p", None}


def test_no_depth_loses_a_page(spark):
    """7,000 levels and more read like any other page, in every operator."""
    deep = "<div>" * 7000 + "<p>bottom <a href='/x'>link</a><script>no()</script>"
    rows = parse_nodes(deep)
    assert max(r[2] for r in rows) > 7000
    d = dom.build_dom(pages(spark, "<p>ok</p>", deep)).cache()
    assert dom.bad_pages(d).count() == 0
    for mode, want in (("text", "bottom link"), ("markdown", "bottom [link](/x)"), ("html", "<p>bottom <a")):
        ok, got = extract.read_content(pages(spark, "<p>ok</p>", deep), mode=mode, compact=True, max_chars=10**6).orderBy("page_id").collect()
        assert "ok" in ok["content"] and got["error"] is None and want in got["content"]
    assert find.locate(d, "div div p > a", "selector").count() == 1
    assert ax.render_tree(ax.compact_tree(d)).count() == 2


def test_bad_pages_are_quarantined(spark):
    """A page whose parsing failed is set aside with its reason; the others go on."""
    bad = F.col("page_id") == 1
    d = dom.build_dom(pages(spark, "<p>ok</p>", "<p>bad</p>")).withColumn("error", F.when(bad, "ValueError: broken")).withColumn("nodes", F.when(~bad, F.col("nodes")))
    assert [r["page_id"] for r in dom.bad_pages(d).collect()] == [1] and {r["page_id"] for r in dom.dom_nodes(d).collect()} == {0}
    found = expect.check_expectations(d, [expect.Rule("r", "count", target="p", target_type="css", expected=1)]).orderBy("page_id").collect()
    assert [r["ok"] for r in found] == [True, False] and "broken" in found[1]["detail"]
    assert [r["text"] is None for r in extract.to_markdown(d).orderBy("page_id").collect()] == [False, True]


RICH = {
    "<p>i<ul><li>a<ul><li>b<li>c</ul><li>d</ul>after": "i\n\n- a\n  - b\n  - c\n- d\n\nafter",
    "<ol start=3><li><p>one</p><p>two</p><li>x</ol>": "3. one\n\n   two\n4. x",
    "<ol start=9><li>a<ol><li>b</ol><li>c<ul><li>d": "9. a\n   1. b\n10. c\n    - d",
    "<blockquote><p>one</p><p>two</p><ul><li>q</ul></blockquote>t": "> one\n>\n> two\n>\n> - q\n\nt",
    "<ul><li><blockquote>a<blockquote>b</blockquote></blockquote>": "- > a\n  >\n  > > b",
    "<table><caption>C</caption><tr><th>a|b<th>c<tr><td>1<td>2 <b>x</b><tr><td><p>l</p><p>m</p></table>z":
        "C\n\n| a\\|b | c |\n| --- | --- |\n| 1 | 2 **x** |\n| l m |  |\n\nz",
    "<blockquote><table><tr><td>a</table>": "> | a |\n> | --- |",
    "<ul><li>a<pre>x\n  y</pre>": "- a\n\n  ```\n  x\n    y\n  ```",
    "<pre><code>a\n```\n</code></pre><p>e *f* <code>g*</code>": "````\na\n```\n````\n\ne \\*f\\* `g*`",
    "<h2>A<br>b</h2>c<br>d<hr><p>&nbsp;<img alt=x src=y>": "## A b\n\nc  \nd\n\n* * *\n\n![x](y)",
    "<b><p>x</p><p>z</p></b><ul><li></li><li>y<i></i></ul>": "**x**\n\n**z**\n\n-\n- y",
}


def test_markdown_of_nested_blocks(spark):
    parts = dom.build_dom(pages(spark, *RICH)).select("page_id", extract.markdown_parts(F.col("nodes")).alias("md"))
    got = extract.with_markdown(parts, "md").orderBy("page_id").collect()
    for r, (html, want) in zip(got, RICH.items()):
        assert r["md"].replace("\u00a0", "") == want, html


def test_markdown_drops_emphasis_of_nothing_behind_text(spark):
    cases = {"<p>y<i></i>z": "yz", "<p>a<b><i></i></b>b": "ab", "<p>y <b>x</b><b></b> z": "y **x** z", "<p><code>x<i>_</i></code>": "`x___`", "<p><b>a<p>b<i></i></b>c": "**a**\n\n**b** c"}
    parts = dom.build_dom(pages(spark, *cases)).select("page_id", extract.markdown_parts(F.col("nodes")).alias("md"))
    assert [r["md"].replace("** c", "**c") for r in extract.with_markdown(parts, "md").orderBy("page_id").collect()] == [w.replace("** c", "**c") for w in cases.values()]


def test_content_without_article(spark):
    """The block of prose wins over link lists, chrome and the body around it."""
    links = "<ul>" + "".join(f"<li><a href='/{i}'>a long link text {i}</a></li>" for i in range(30)) + "</ul>"
    prose = "<p>" + "Some sentence of the story. " * 8 + "</p>"
    cases = [
        (f"<body>{links}<div id=a><div id=b>{prose}{prose}</div></div>{links}<footer>{prose * 9}</footer>", "b"),
        (f"<body><div id=x>{links}</div><section id=s>{prose}<a href=/>more</a>{prose}</section><div id=y>{links}{prose}</div>", "s"),
        (f"<body id=all>{prose}<div id=in>{prose}</div>", "all"),
        (f"<body id=all><article id=art>{'x'}</article>{prose}", "art"), (f"<body><div>{prose}</div><main id=m>x</main>", "m"),
        ("<body id=none>", "none"),
    ]
    p = pages(spark, *[html for html, _ in cases])
    for cut in (lambda d: d, extract.strip_compact):
        got = extract.main_article(cut(dom.build_dom(p))).orderBy("page_id").select(F.col("nodes")[0]["attrs"]["id"]).collect()
        assert [r[0] for r in got] == [want for _, want in cases]


SELECTORS = """<ul id=l><li class='a x'>1</li><li class=b>2</li><!-- c --><li class='a'>3<b>i</b></li>text<li lang='en-US' class='a b'>4</li></ul>
<div><p>p1</p><span>s</span><p class=a>p2</p><p>p3</p><div><p></p></div></div><ol><li>o1<li class=a>o2</ol>"""


@pytest.mark.parametrize("css, want", [
    ("li:first-child", ["1", "o1"]), ("li:last-child", ["4", "o2"]), ("li:nth-child(odd)", ["1", "3i", "o1"]), ("#l li:nth-child(2n)", ["2", "4"]),
    ("li:nth-child(-n+2)", ["1", "2", "o1", "o2"]), ("li:nth-child(n + 3)", ["3i", "4"]), ("li:nth-last-child(1)", ["4", "o2"]), ("div > p:nth-child(3)", ["p2"]),
    ("li:not(.a)", ["2", "o1"]), ("li:not(.a, .b)", ["o1"]), ("li:not(:first-child):not(:last-child)", ["2", "3i"]), ("p:not([class])", ["p1", "p3", ""]),
    (".x + li", ["2"]), ("li + .a", ["3i", "4", "o2"]), ("span ~ p", ["p2", "p3"]), (".b ~ .a", ["3i", "4"]), ("ul ~ div p.a ~ p", ["p3"]),
    ("ul > li ~ li b", ["i"]), ("body>ul>li.a", ["1", "3i", "4"]), ("div div > p", [""]), ("p:empty", [""]), ("p:only-child", [""]),
    ("[lang|=en]", ["4"]), ("li[class~=b]", ["2", "4"]), ("div > :first-of-type", ["p1", "s", "", ""]), ("ol li, .x", ["1", "o1", "o2"]),
    ("ul li:last-of-type", ["4"]), ("html:root > body > ol > li.a", ["o2"]), ("b, i, u", ["i"]),
])
def test_selectors(spark, css, want):
    d = dom.build_dom(pages(spark, SELECTORS))
    got = [r["text"] for r in find.locate(d, css, "selector").orderBy("nth").collect()]
    assert [x.replace(" ", "") for x in got] == want


@pytest.mark.parametrize("css", ["", "> p", "p >", "p > > a", "p:hover", "li:nth-child(x)", ":not(", "p,,a"])
def test_bad_selectors(css):
    with pytest.raises(BadSelector):
        css_flags(css)


def test_latest_status(spark):
    net = spark.createDataFrame([("u0", 500, 1), ("u0", 200, 2), ("u0", None, 3)], "url string, status int, seq long")
    d = dom.build_dom(pages(spark, "<p>x</p>"))
    d = d.withColumn("url", F.lit("u0"))
    assert extract.page_info(d, net).first()["status_line"] == "HTTP 200"


def test_markdown(spark):
    body = "<article><h1>Title</h1><p>First <b>bold</b> and <em>soft</em> <a href='/x'>link</a>, long enough to count as an article text.</p>" \
           "<ul><li>one<li>two</ul><pre>code  here</pre><script>no()</script></article>"
    md = extract.to_markdown(dom.build_dom(pages(spark, f"<title>T</title><nav>menu</nav>{body}"))).first()["text"]
    assert md == (
        "# T\n\n# Title\n\nFirst **bold** and _soft_ [link](/x), long enough to count as an article text.\n\n"
        "- one\n- two\n\n```\ncode  here\n```")


def test_markdown_fallbacks(spark):
    tiny = dom.build_dom(pages(spark, "<title>T</title><body><article>tiny</article><div>much longer text outside of it</div></body>"))
    assert extract.to_markdown(tiny).first()["text"] == "# T\n\ntiny\n\nmuch longer text outside of it"
    assert extract.to_markdown(tiny, fallback=None).first()["text"] == "# T\n\ntiny\n\nmuch longer text outside of it"
    shorter = tiny.withColumn("alt", F.lit("x"))
    assert extract.to_markdown(shorter, fallback="alt").first()["text"] == "# T\n\ntiny"


def test_size_cap_warns(spark):
    big = pages(spark, "<body>" + "x" * 500)
    d = extract.to_markdown(dom._parse(dom.cap_html(big, 200)), max_chars=50).first()["text"]
    assert d.endswith("page exceeded 10 MB]") and "[...truncated, " in d


def test_truncate(spark):
    row = spark.range(1).select(truncate_col(F.lit("abcdefghij"), 5).alias("a"), truncate_col(F.lit("abc"), 5).alias("b")).first()
    assert row["a"] == "abcde\n\n[...truncated, 5 more chars]" and row["b"] == "abc"


def test_read_modes(spark):
    p = pages(spark, FORM)
    assert extract.read_content(p, "text", "#items li").first()["content"] == "buy milk"
    missing = extract.read_content(p, "html", "#none").first()
    assert missing["content"] is None and missing["error"] == "Selector not found: #none"
    li = extract.read_content(p, "html", "li.done", compact=False).first()["content"]
    assert li == '<li class="todo done">walk dog</li>'


@pytest.mark.parametrize("target, kind, opts, want", [
    ("email", "label", {}, ["input"]), ("Password", "label", {"exact": True}, ["input"]),
    ("you@", "placeholder", {}, ["input"]), ("go", "testid", {}, ["button"]),
    ("send", "role", {}, ["button"]), ("send", "role", {"exact": True}, []),
    ("MILK", "text", {}, ["li"]), ("Log in", "text", {"exact": True}, ["h1"]),
    ("ul#items > li.todo:nth-of-type(2)", "selector", {}, ["li"]), ("#items li, h1", "selector", {}, ["h1", "li", "li"]),
    ("Email", "role", {"role": "textbox"}, ["input"]),
])
def test_locators(spark, target, kind, opts, want):
    d = dom.build_dom(pages(spark, FORM))
    assert [r["tag"] for r in find.locate(d, target, kind, **opts).orderBy("nth").collect()] == want


def test_find(spark):
    hit = find.find_text(dom.build_dom(pages(spark, f"<body><div id='1a'><p>{'w' * 60} Needle {'v' * 60}</p></div></body>")), "nEEdle").first()
    assert hit["snippet"] == "..." + "w" * 39 + " Needle " + "v" * 39 + "..."
    assert hit["selector"] == "div#\\31 a > p" and hit["tag"] == "p"


ASSERTIONS = [
    ("visible", dict(target="h1", target_type="selector"), True), ("visible", dict(target="#no", target_type="selector"), False),
    ("visible", dict(target="p", target_type="selector"), False), ("hidden", dict(target="#no", target_type="selector"), True),
    ("hidden", dict(target="p", target_type="selector"), True), ("enabled", dict(target="go", target_type="testid"), True),
    ("disabled", dict(target="Password", target_type="label"), True), ("disabled", dict(target="#inner", target_type="selector"), True),
    ("text_equals", dict(target="h1", target_type="selector", expected="Log in"), True),
    ("text_matches", dict(target="h1", target_type="selector", expected="^log"), False),
    ("text_contains", dict(target="#no", target_type="selector", expected="x"), False),
    ("value_equals", dict(target="email", target_type="label", expected="a@b.c"), True),
    ("value_equals", dict(target="#plan", target_type="selector", expected="p"), True),
    ("value_equals", dict(target="h1", target_type="selector", expected="p"), False),
    ("count", dict(target="li", target_type="selector", expected=2), True), ("count", dict(target="li", target_type="selector", expected="2"), True),
    ("count", dict(target="li", target_type="selector"), False), ("url_equals", dict(expected="https://x.example/0"), True),
    ("title_equals", dict(expected="Log in"), True), ("title_matches", dict(expected="["), False),
]


def test_assertions(spark):
    rules = [expect.Rule(str(i), a, **kw) for i, (a, kw, _) in enumerate(ASSERTIONS)]
    got = {r["rule_id"]: r for r in expect.check_expectations(dom.build_dom(pages(spark, FORM)), rules).collect()}
    for i, (_, _, want) in enumerate(ASSERTIONS):
        assert got[str(i)]["ok"] is want, (ASSERTIONS[i], got[str(i)])
    assert got["0"]["report"] == "PASS visible"
    assert got["3"]["report"] == "PASS hidden — no match"
    assert got["1"]["report"] == "FAIL visible actual=0\n  not found\n  (retried for 5000ms)"
    assert got["9"]["report"] == 'FAIL text_matches expected="^log" actual="Log in"\n  (retried for 5000ms)'
    assert "bad regex: " in got["19"]["report"]


def test_every_page_gets_its_file(spark, tmp_path):
    rows = [(1, "u", "<p>one é"), (1, "u", "<p>other"), (2, "u", None), (None, "u", ""), (7, "u", "x" * 200_000), (7, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = f"{tmp_path}/saved"
    got = save_html(df, out).collect()
    assert sorted((r["page_id"] or -1, r["bytes"]) for r in got) == [(-1, 0), (1, 8), (1, 9), (2, 0), (7, 200_000), (7, 200_000)]
    html = {r["path"]: open(r["path"], encoding="utf-8").read() for r in got}
    assert sorted(html.values(), key=len) == ["", "", "<p>one é", "<p>other", "x" * 200_000]
    assert len({r["path"] for r in got if r["page_id"] == 1}) == 2
    assert [p.name for p in tmp_path.iterdir()] == ["saved"]
    with pytest.raises(Exception):
        save_html(df, out)


def test_an_aborted_save_shows_nothing(spark, tmp_path):
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "if(id = 150, raise_error('no'), 'x') as html").repartition(4)
    with pytest.raises(Exception):
        save_html(df, f"{tmp_path}/saved")
    assert list(tmp_path.iterdir()) == []


def test_parsing_holds_a_few_pages_at_a_time():
    html = ["<p>" + "word &amp; " * 2_000 + f"<a href='/{i}' href=x>{i}</a>" for i in range(120)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(121)), pa.array(html)], names=["page_id", "html"])
    got = list(dom._parse_batches([batch]))
    assert [x for b in got for x in b.column("page_id").to_pylist()] == list(range(121))
    assert max(b.num_rows for b in got) * 20_000 < 2 * dom.PIECE_BYTES and len(got) > 3
    nodes = [x for b in got for x in b.column("nodes").to_pylist()]
    assert [dict(n["attrs"]) for n in nodes[7] if n["tag"] == "a"] == [{"href": "/7"}] and len(nodes[120]) == 3
    assert [n["attrs"] for n in nodes[7] if n["kind"] == "text"] == [None, None]


def test_a_parsed_page_leaves_nothing_behind():
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            parse_nodes("<ul>" + "<li><b>x" * 200)
        assert gc.collect() < 2_000
    finally:
        gc.enable()
