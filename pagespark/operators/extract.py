"""Page text, HTML and Markdown: array expressions over a page's nodes, and a fold for Markdown."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.css import css_flags
from ..functions.lets import let
from ..functions.markdown import fold
from ..functions.prefix import covers, running_sum
from ..functions.text import HTML_CUT_WARNING, MAX_CHARS, squash, trim_all, truncate_col
from .dom import attr, build_dom, drop_subtrees, inside

# Regions that compact mode strips.
STRIP_TAGS = "script style noscript template svg iframe nav header footer aside".split()
STRIP_ROLES = "navigation banner contentinfo complementary search".split()
# Elements that start a paragraph in compact text.
BLOCK_TAGS = "p div br li tr section article h1 h2 h3 h4 h5 h6 blockquote pre".split()
UNSEEN_TAGS = "script style noscript template".split()
RAW_TEXT_TAGS = "script style xmp iframe noembed noframes plaintext".split()
VOID_TAGS = "area base br col embed hr img input link meta param source track wbr".split()


def is_chrome(n: Column) -> Column:
    """Whether an element is page chrome that compact mode removes with its sub-tree."""
    return (
        n["tag"].isin(*STRIP_TAGS)
        | F.coalesce(attr(n, "role").isin(*STRIP_ROLES), F.lit(False))
        | F.coalesce(attr(n, "aria-hidden") == "true", F.lit(False))
        | attr(n, "hidden").isNotNull()
    )


def strip_compact(dom: DataFrame) -> DataFrame:
    """Drop the chrome sub-trees. Nodes keep their ``ord``; array position no longer equals it."""
    return dom.withColumn("nodes", drop_subtrees(F.col("nodes"), is_chrome))


def _body_nodes(nodes: Column) -> Column:
    """Nodes below the body, or all nodes when there is none."""
    body = F.get(F.filter(nodes, lambda n: n["tag"] == "body"), F.lit(0))
    return let(body, lambda b: F.when(b.isNull(), nodes).otherwise(
        F.filter(nodes, lambda n: (n["ord"] > b["ord"]) & (n["ord"] <= b["last"]))))


def compact_body(nodes: Column) -> Column:
    return let(drop_subtrees(nodes, is_chrome), _body_nodes)


def _tidy(raw: Column) -> Column:
    """Four steps, in this order: squeeze blanks, cap blank lines, strip line edges, trim."""
    one = F.regexp_replace(raw, "[ \\t\\f\\x0b]+", " ")
    two = F.regexp_replace(one, "\\n{3,}", "\n\n")
    three = F.regexp_replace(two, "(?m)^ +| +$", "")
    return trim_all(three)


def _flowing_text(nodes: Column) -> Column:
    parts = F.transform(nodes, lambda n: F.when(n["kind"] == "text", n["text"]).when(
        n["tag"].isin(*BLOCK_TAGS), "\n\n").otherwise(""))
    return _tidy(F.array_join(parts, ""))


def compact_text_col(nodes: Column) -> Column:
    return _flowing_text(compact_body(nodes))


def plain_text_col(nodes: Column) -> Column:
    """Stand-in for rendered text: everything in the body but scripts, styles and templates."""
    seen = drop_subtrees(nodes, lambda n: n["tag"].isin(*UNSEEN_TAGS))
    return _flowing_text(let(seen, _body_nodes))


def _escape(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    nbsp = F.replace(amp, F.lit(" "), F.lit("&nbsp;"))
    return F.replace(F.replace(nbsp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _start_tag(n: Column) -> Column:
    def one(e: Column) -> Column:
        value = F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        return F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(value, F.lit(" "), F.lit("&nbsp;")), F.lit('"'))

    attrs = F.array_join(F.transform(F.map_entries(n["attrs"]), one), "")
    return F.concat(F.lit("<"), n["tag"], attrs, F.lit(">"))


def _assemble(nodes: Column, before, after) -> Column:
    """Join opening and closing texts of a preorder list of structs with a node ``n`` in document order.

    A closing text goes behind the last node of its sub-tree, inner elements first.
    """

    def at(pos: Column, late: int, inner: Column, text: Column) -> Column:
        return F.struct(pos.alias("pos"), F.lit(late).alias("late"), inner.alias("inner"), text.alias("text"))

    opened = F.transform(nodes, lambda m: at(m["n"]["ord"], 0, m["n"]["ord"], before(m)))
    elements = F.filter(nodes, lambda m: m["n"]["kind"] == "element")
    closed = F.transform(elements, lambda m: at(m["n"]["last"], 1, -m["n"]["ord"], after(m)))
    return F.array_join(F.transform(F.array_sort(F.concat(opened, closed)), lambda p: p["text"]), "")


def html_of(nodes: Column) -> Column:
    """Serialised HTML of a node list."""
    raw = covers(nodes, lambda n: n["tag"].isin(*RAW_TEXT_TAGS))  # such elements hold nothing but text
    return let(F.zip_with(nodes, raw, lambda n, r: F.struct(n.alias("n"), r.alias("raw"))), _html_of)


def _html_of(marked: Column) -> Column:
    def before(m: Column) -> Column:
        n = m["n"]
        return (
            F.when(n["kind"] == "element", _start_tag(n))
            .when(n["kind"] == "comment", F.concat(F.lit("<!--"), n["text"], F.lit("-->")))
            .when(m["raw"], n["text"])
            .otherwise(_escape(n["text"]))
        )

    def after(m: Column) -> Column:
        tag = m["n"]["tag"]
        return F.when(tag.isin(*VOID_TAGS), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))

    return _assemble(marked, before, after)


def compact_html(dom: DataFrame) -> DataFrame:
    """Inner HTML of the body without chrome; a page without body gives the whole document."""
    kept = dom.withColumn("_n", compact_body(F.col("nodes")))
    return kept.select("page_id", "url", html_of(F.col("_n")).alias("html"))


def compact_text(dom: DataFrame) -> DataFrame:
    return dom.select("page_id", "url", compact_text_col(F.col("nodes")).alias("text"))


def plain_text(dom: DataFrame) -> DataFrame:
    return dom.select("page_id", "url", plain_text_col(F.col("nodes")).alias("text"))


# --- main article and Markdown ---

def with_content_root(dom: DataFrame, to: str = "_content") -> DataFrame:
    """Column ``to``: the element with the most text outside links, weighed by the share of its text that is outside links.

    With T the characters (blanks aside) of an element's text and L those inside links, the largest (T - L) * (1 - L / T) wins; of
    equals the innermost, then the last. Chrome and what is never shown do not count. Sub-tree sums are differences of running sums over
    the preorder; null where nothing has text.
    """
    nodes, none = F.col("nodes"), F.lit(0).cast("bigint")
    unseen = lambda n: is_chrome(n) | n["tag"].isin("head", *UNSEEN_TAGS)
    own = F.transform(nodes, lambda n: F.when(n["kind"] == "text", F.length(F.regexp_replace(n["text"], "\\s", ""))).otherwise(0).cast("bigint"))
    first = F.get(nodes, F.lit(0))["ord"]
    # Position of the last node at or before each ord: sub-trees that were cut leave gaps.
    at = F.flatten(F.transform(nodes, lambda n, i: F.array_repeat(
        i, F.coalesce(F.get(nodes, i + 1)["ord"], F.get(nodes, F.lit(0))["last"] + 1) - n["ord"])))
    kept = lambda texts, flags, keep: F.zip_with(texts, flags, lambda c, f: F.when(f == keep, c).otherwise(none))
    # One column after the other: each is a short expression of the one before.
    staged = dom.withColumn("_text", kept(own, covers(nodes, unseen), False))
    staged = staged.withColumn("_sums", let(F.col("_text"), lambda t: F.struct(
        t.alias("t"), kept(t, covers(nodes, lambda n: n["tag"] == "a"), True).alias("l"))))
    staged = staged.withColumn("_sums", let(F.col("_sums"), lambda s: F.struct(running_sum(s["t"]).alias("t"), running_sum(s["l"]).alias("l"), at.alias("at"))))

    def scores(s: Column) -> Column:
        def below(sums: Column, n: Column, i: Column) -> Column:
            return F.get(sums, F.get(s["at"], n["last"] - first)) - F.when(i > 0, F.get(sums, i - 1)).otherwise(0)
        return F.transform(nodes, lambda n, i: F.struct(
            (n["kind"] == "element").alias("ok"), below(s["t"], n, i).alias("t"), below(s["l"], n, i).alias("l"), i.alias("at")))

    staged = staged.withColumn("_scores", let(F.col("_sums"), scores))
    best = F.array_max(F.transform(F.filter("_scores", lambda x: x["ok"] & (x["t"] > 0)), lambda x: F.struct(
        ((x["t"] - x["l"]) * (x["t"] - x["l"]) / x["t"]).alias("score"), x["at"].alias("at"))))
    return staged.withColumn(to, F.get(nodes, best["at"])).drop("_text", "_sums", "_scores")


def with_article_root(dom: DataFrame, to: str = "_root") -> DataFrame:
    """Column ``to``: the first article, else the first main element, else the element that holds the content, else the body."""
    def first(tag: str) -> Column:
        return F.get(F.filter("nodes", lambda n: n["tag"] == tag), F.lit(0))

    return with_content_root(dom, "_content").withColumn(
        to, F.coalesce(first("article"), first("main"), F.col("_content"), first("body"), F.get("nodes", F.lit(0)))).drop("_content")


def main_article(dom: DataFrame) -> DataFrame:
    """Keep only the nodes of the main article; ``root_tag`` says which element that is."""
    return with_article_root(dom).withColumn("nodes", inside(F.col("nodes"), F.col("_root"))).withColumn("root_tag", F.col("_root.tag")).drop("_root")


def markdown_parts(nodes: Column) -> Column:
    """What Markdown needs of a node list, for ``with_markdown``."""
    seen = drop_subtrees(nodes, lambda n: n["tag"].isin("script", "style", "noscript", "template", "head"))
    return F.transform(F.filter(seen, lambda n: n["kind"] != "comment"), lambda n: F.struct(
        n["ord"].alias("ord"), n["last"].alias("last"), n["tag"].alias("tag"), F.when(n["kind"] == "text", n["text"]).alias("text"),
        F.coalesce(attr(n, "href"), attr(n, "src"), attr(n, "start")).alias("link"), attr(n, "alt").alias("alt")))


def with_markdown(df: DataFrame, *columns: str) -> DataFrame:
    """Columns made by ``markdown_parts`` become Markdown: ATX headings, fenced code, dash bullets, numbered lists from their start, quotes and pipe tables, nested at will.

    The rows pass through a Python worker, so select what is needed beside them first.
    """
    def run(batches):
        for batch in batches:
            made = {c: pa.array([None if page is None else fold(tuple(n.values()) for n in page) for page in (p.as_py() for p in batch.column(c))], pa.string())
                    for c in columns}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    out = T.StructType([T.StructField(f.name, T.StringType() if f.name in columns else f.dataType) for f in df.schema])
    return df.mapInArrow(run, out).withColumns({c: trim_all(F.col(c)) for c in columns})


def title_col(nodes: Column) -> Column:
    """Document title: text of the first title element, white space squeezed; empty when absent."""
    title = F.get(F.filter(nodes, lambda n: n["tag"] == "title"), F.lit(0))["ord"]
    text = let(title, lambda t: F.get(F.filter(nodes, lambda n: n["parent"] == t), F.lit(0))["text"])
    return squash(F.coalesce(text, F.lit("")))


def to_markdown(dom: DataFrame, fallback: str | None = "plain", max_chars: int = MAX_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """Markdown of the main article under the page title.

    When the trimmed result has fewer than 100 characters, the plain text (``fallback``:
    'plain', a column name, or None) takes over if it is longer; only without any fallback
    the whole body is converted instead. Columns to ``carry`` follow.
    """
    n = F.col("nodes")
    staged = with_article_root(dom).withColumn("_title", title_col(n)).withColumn("_md", markdown_parts(inside(n, F.col("_root"))))
    said = F.aggregate("_md", F.lit(0), lambda acc, x: acc + F.coalesce(F.length(F.regexp_replace(x["text"], "\\s", "")), F.lit(0)))
    few = F.coalesce(said < 100, F.lit(False))  # Markdown is no shorter than the text it shows, so only such pages can need anything else
    if fallback is None:
        body = F.get(F.filter(n, lambda x: x["tag"] == "body"), F.lit(0))
        other = F.when(few, markdown_parts(inside(n, body)))
    else:
        other = F.when(few, F.coalesce(plain_text_col(n) if fallback == "plain" else F.col(fallback), F.lit("")))
    shown = with_markdown(staged.select("page_id", "url", "cut", "_title", "_md", other.alias("_other"), *carry), "_md", *(["_other"] if fallback is None else []))
    head = F.when(F.col("_title") != "", F.concat(F.lit("# "), F.col("_title"), F.lit("\n\n"))).otherwise("")
    shown = shown.withColumn("_head", head).withColumn("_full", F.when(F.col("_md") != "", F.concat("_head", "_md")).otherwise(F.when(F.col("_md").isNotNull(), "")))
    short = F.length(trim_all(F.col("_full"))) < 100
    instead = F.concat("_head", F.coalesce("_other", F.lit("")))
    if fallback is not None:
        short = short & (F.length(trim_all(F.col("_other"))) > F.length(trim_all(F.col("_full"))))
    text = truncate_col(F.col("_text"), max_chars)
    return shown.withColumn("_text", trim_all(F.when(short, instead).otherwise(F.col("_full")))).select(
        "page_id", "url",
        F.when(F.col("cut"), F.concat(text, F.lit(HTML_CUT_WARNING))).otherwise(text).alias("text"), *carry,
    )


def select_subtree(dom: DataFrame, css: str) -> DataFrame:
    """Narrow each page to the first element that matches a CSS selector.

    Pages without a match get ``error`` "Selector not found: ..." and no nodes.
    """
    root = let(css_flags(css)(F.col("nodes")), lambda hit: F.get(F.filter("nodes", lambda n, i: F.get(hit, i)), F.lit(0)))
    found = dom.withColumn("_root", root)
    kept = F.when(F.col("_root").isNotNull(), inside(F.col("nodes"), F.col("_root")))
    missing = F.when(F.col("_root").isNull() & F.col("error").isNull(), F.lit(f"Selector not found: {css}"))
    return found.withColumn("nodes", kept).withColumn("error", F.coalesce("error", missing)).drop("_root")


def read_content(
    pages: DataFrame, mode: str = "markdown", selector: str | None = None,
    max_chars: int = MAX_CHARS, compact: bool | None = None,
) -> DataFrame:
    """url, mode, content of each page; ``error`` instead of content where a page cannot be parsed or a selector finds nothing.

    Compact defaults to off for Markdown and on for text and HTML.
    """
    if mode not in ("markdown", "text", "html"):
        raise ValueError(f"unknown mode: {mode}")
    strip = mode != "markdown" if compact is None else compact
    if mode == "html" and not strip and selector is None:
        return pages.select(
            "page_id", "url", F.lit(mode).alias("mode"),
            truncate_col(F.col("html"), max_chars).alias("content"), F.lit(None).cast("string").alias("error"))
    dom = build_dom(pages)
    if selector is not None:
        dom = select_subtree(dom, selector)
    n = F.col("nodes")
    if mode == "markdown":
        shown = dom.withColumn("_plain_text", plain_text_col(n))
        out = to_markdown(strip_compact(shown) if strip else shown, "_plain_text", max_chars, carry=["error"])
    elif mode == "text":
        out = dom.select("page_id", "url", truncate_col(
            compact_text_col(n) if strip else plain_text_col(n), max_chars).alias("text"), "error")
    else:
        kept = compact_body(n) if strip else n
        out = dom.withColumn("_n", kept).select(
            "page_id", "url", truncate_col(html_of(F.col("_n")), max_chars).alias("text"), "error")
    return out.select(
        "page_id", "url", F.lit(mode).alias("mode"), F.when(F.col("error").isNull(), F.col("text")).alias("content"), "error")


def page_info(dom: DataFrame, net: DataFrame | None = None) -> DataFrame:
    """Title, url and latest status line of each page; ``net`` (url, status, seq) is optional.

    The entry with the largest ``seq`` counts, of equal ones the larger status; entries without a status do not.
    """
    info = dom.select("page_id", "url", title_col(F.col("nodes")).alias("title"))
    if net is None:
        info = info.withColumn("status", F.lit(None).cast("int"))
    else:
        info = info.join(net.filter("status IS NOT NULL").groupBy("url").agg(F.max_by("status", F.struct("seq", "status")).alias("status")), "url", "left")
    line = F.when(F.col("status").isNull() | (F.col("status") == 0), "HTTP status unknown").otherwise(
        F.concat(F.lit("HTTP "), F.col("status").cast("string"), F.when(F.col("status") >= 400, " (error)").otherwise(""))
    )
    return info.select("page_id", "url", "title", "status", line.alias("status_line"))
