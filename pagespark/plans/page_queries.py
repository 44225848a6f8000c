"""Registered queries over pages. The SQL twins know the page template and use regular expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dom, extract
from ..sources.pages import save_html
from ..session import shared_dir
from . import feeds
from .registry import query


def _unescape(x: str) -> str:
    """The entities of the pages, with or without their semicolon."""
    for entity, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"regexp_replace({x}, '&{entity};?', '{char}', 'g')"
    return x


def _reescape(x: str) -> str:
    """The same text as it is serialised again."""
    return f"replace({_unescape(x)}, '&', '&amp;')"


_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _tidy(x: str) -> str:
    one = f"regexp_replace({x}, '[ \\t\\f\\v]+', ' ', 'g')"
    two = f"regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    three = f"regexp_replace({two}, '(?m)^ +| +$', '', 'g')"
    return f"regexp_replace({three}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


# Body parts by the template: nav, comment, ad, article, footer.
PARTS = r"""parts AS (
  SELECT page_id, url, html,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav,
    regexp_extract(html, '(?s)<!--(.*?)-->', 1) AS note,
    regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad,
    regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS story,
    regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS foot FROM pages)"""

# Paragraphs with the number of bold elements open in them: the unclosed <b> is re-opened in
# every later paragraph, from at most three remembered ones.
PARAS = PARTS + r""",
split AS (SELECT page_id, generate_subscripts(list, 1) AS i, unnest(list) AS seg
          FROM (SELECT page_id, string_split(story, '<p>')[2:] AS list FROM parts)),
marked AS (SELECT *, CAST(starts_with(seg, '<b>') AS INT) AS own,
             coalesce(sum(CAST(starts_with(seg, '<b>') AS INT)) OVER (PARTITION BY page_id ORDER BY i
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM split),
paras AS (SELECT page_id, i, least(3, before) + own AS bolds, contains(seg, '<br>') AS br,
            regexp_replace(seg, '<b>|<br>|</p>', '', 'g') AS words FROM marked)"""


def _dom(spark, sf):
    return dom.build_dom(feeds.pages(spark, sf))


@query("page_table", "SELECT page_id, url, md5(html) AS html_md5, length(html) AS chars FROM pages")
def page_table(spark, sf):
    return feeds.pages(spark, sf).select(
        "page_id", "url", F.md5(F.encode("html", "UTF-8")).alias("html_md5"), F.length("html").alias("chars"))


@query("capped_pages", """SELECT page_id, md5(substr(html, 1, 2500)) AS html_md5, length(html) > 2500 AS cut FROM pages""")
def capped_pages(spark, sf):
    return dom.cap_html(feeds.pages(spark, sf), 2500).select(
        "page_id", F.md5(F.encode("html", "UTF-8")).alias("html_md5"), "cut")


@query("saved_pages", """SELECT page_id, CAST(page_id % 4096 AS VARCHAR) || '/' || CAST(page_id AS VARCHAR) || '-' || substr(sha256(html), 1, 12) || '.html' AS path,
  octet_length(encode(html)) AS bytes FROM pages""")
def saved_pages(spark, sf):
    home = shared_dir(spark, "saved-pages")
    return save_html(feeds.pages(spark, sf), home).withColumn("path", F.substr("path", F.lit(len(home) + 2)))


_COUNTS = f"""WITH {PARAS}
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
WHERE tag <> 'b' GROUP BY 1, 2
UNION ALL SELECT page_id, 'b', CAST(sum(bolds) + least(3, sum(own2)) AS BIGINT) FROM (
  SELECT p.page_id, p.bolds, m.own AS own2 FROM paras p JOIN marked m ON m.page_id = p.page_id AND m.i = p.i)
GROUP BY 1 HAVING sum(bolds) > 0"""


@query("dom_tag_counts", _COUNTS)
def dom_tag_counts(spark, sf):
    nodes = dom.dom_nodes(_dom(spark, sf))
    return nodes.filter(F.col("kind") == "element").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("dom_tag_counts_by_document", _COUNTS)
def dom_tag_counts_by_document(spark, sf):
    nodes = dom.dom_nodes(dom.build_dom(feeds.pages(spark, sf), dedupe=True, copies_per_task=3))
    return nodes.filter(F.col("kind") == "element").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("bad_pages", "SELECT page_id, url, '' AS error FROM pages WHERE FALSE")
def bad_pages(spark, sf):
    return dom.bad_pages(_dom(spark, sf))


@query("stripped_nodes", f"""WITH {PARAS},
body AS (SELECT page_id, 'article' AS tag, 1 AS n FROM parts UNION ALL SELECT page_id, 'h1', 1 FROM parts
  UNION ALL SELECT page_id, 'div', 1 FROM parts
  UNION ALL SELECT page_id, unnest(['html', 'head', 'meta', 'title', 'body']), 1 FROM parts
  UNION ALL SELECT page_id, 'p', count(*) FROM paras GROUP BY 1
  UNION ALL SELECT page_id, 'br', count(*) FROM paras WHERE br GROUP BY 1
  UNION ALL SELECT page_id, 'b', CAST(sum(bolds) AS BIGINT) FROM paras GROUP BY 1 HAVING sum(bolds) > 0)
SELECT * FROM body""")
def stripped_nodes(spark, sf):
    nodes = dom.dom_nodes(extract.strip_compact(_dom(spark, sf)))
    return nodes.filter(F.col("kind") == "element").groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("compact_html", f"""WITH {PARAS},
ps AS (SELECT page_id, string_agg('<p>' || repeat('<b>', CAST(bolds AS INT)) || {_reescape('words')} || CASE WHEN br THEN '<br>' ELSE '' END
         || repeat('</b>', CAST(bolds AS INT)) || '</p>', '' ORDER BY i) AS body FROM paras GROUP BY 1)
SELECT t.page_id, t.url, '<!--' || note || '--><div class="ad">' || {_reescape('ad')} || '</div><article><h1>'
  || {_reescape('h1')} || '</h1>' || coalesce(body, '') || '</article>' AS html
FROM parts t LEFT JOIN ps ON ps.page_id = t.page_id""")
def compact_html(spark, sf):
    return extract.compact_html(_dom(spark, sf))


_TEXT_BODY = r"""regexp_replace(regexp_replace({x}, '<(p|div|br|li|tr|section|article|h[1-6]|blockquote|pre)( [^>]*)?>', chr(10) || chr(10), 'g'), '<!--.*?-->|</?[a-z][^>]*>', '', 'g')"""


@query("compact_text", f"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1),
    '(?s)<nav>.*?</nav>|<footer>.*?</footer>', '', 'g') AS x FROM pages)
SELECT page_id, url, {_tidy(_unescape(_TEXT_BODY.format(x='x')))} AS text FROM b""")
def compact_text(spark, sf):
    return extract.compact_text(_dom(spark, sf))


_PLAIN = _tidy(_unescape(_TEXT_BODY.format(x="regexp_extract(html, '(?s)<body>(.*)', 1)")))


@query("plain_text", f"SELECT page_id, url, {_PLAIN} AS text FROM pages")
def plain_text(spark, sf):
    return extract.plain_text(_dom(spark, sf))


@query("main_articles", f"""WITH {PARAS}
SELECT t.page_id, 'article' AS root_tag, count(p.i) AS paragraphs FROM parts t LEFT JOIN paras p ON p.page_id = t.page_id GROUP BY 1""")
def main_articles(spark, sf):
    art = extract.main_article(_dom(spark, sf))
    return art.select("page_id", "root_tag", F.size(F.filter("nodes", lambda n: n["tag"] == "p")).cast("long").alias("paragraphs"))


def _md(x: str) -> str:
    flat = f"regexp_replace({_unescape(x)}, '\\s+', ' ', 'g')"
    return f"regexp_replace({flat}, '([\\\\*_`\\[\\]])', '\\\\\\1', 'g')"


_BARE = "CAST(length(regexp_replace({x}, '\\s', '', 'g')) AS BIGINT)"


@query("main_content", f"""WITH {PARAS}, body AS (SELECT page_id, sum({_BARE.format(x=_unescape('words'))}) AS p FROM paras GROUP BY 1),
s AS (SELECT t.page_id, {_BARE.format(x=_unescape('ad'))} AS ad, {_BARE.format(x=_unescape('h1'))} + coalesce(p, 0) AS story,
    (SELECT coalesce(sum({_BARE.format(x=_unescape('x'))}), 0) FROM (SELECT unnest(regexp_extract_all(nav, '<a href="[^"]*">(.*?)</a>', 1)) AS x)) AS links
  FROM parts t LEFT JOIN body b ON b.page_id = t.page_id),
w AS (SELECT *, page_id % 2 = 0 AS linked FROM s),
v AS (SELECT *, CASE WHEN linked THEN story * story / CAST(links + ad + story AS DOUBLE) ELSE (ad + story) * (ad + story) / CAST(links + ad + story AS DOUBLE) END AS body_score FROM w)
SELECT page_id, CASE WHEN body_score > story THEN 'body' ELSE 'div' END AS root_tag, CASE WHEN body_score > story THEN NULL ELSE 'story' END AS root_class,
  CASE WHEN body_score > story THEN links + ad + story ELSE story END AS chars FROM v""")
def main_content(spark, sf):
    """Pages whose story is a plain block between a list of links and, on every other page, a linked advertisement."""
    html = F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="story">')), F.lit("</article>"), F.lit("</div>"))
    html = F.replace(F.replace(html, F.lit("<nav>"), F.lit("<div>")), F.lit("</nav>"), F.lit("</div>"))
    linked = F.regexp_replace(html, '(?s)<div class="ad">(.*?)</div>', '<div class="ad"><a href="/ad">$1</a></div>')
    plain = feeds.pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 2 == 0, linked).otherwise(html))
    found = extract.main_article(extract.strip_compact(dom.build_dom(plain)))
    shown = F.filter("nodes", lambda n: (n["kind"] == "text"))
    inside = F.aggregate(shown, F.lit(0).cast("long"), lambda acc, n: acc + F.length(F.regexp_replace(n["text"], "\\s", "")))
    return found.select("page_id", "root_tag", dom.attr(F.get("nodes", F.lit(0)), "class").alias("root_class"), inside.alias("chars"))


# Lists in lists, a numbered list with a start, a quote of several blocks and a table, made of each page's heading, advertisement and links.
_RICH = """concat('<title>T</title><article><h2>', h1, '</h2><ul><li>', ad, '<ol start="', 3 + page_id % 5, '"><li>one<li><p>two</p><p>', h1,
  '</p></ol></li><li>last</li></ul><blockquote><p>', ad, '</p><p>', h1, '</p><ul><li>quoted</li></ul></blockquote><table><tr><th>a|b</th><th>', page_id,
  '</th></tr>', rows, '</table><p>end of the page that is long enough to be an article by itself, which takes a hundred characters</p></article>')"""


@query("rich_markdown", f"""WITH {PARTS}, t AS (SELECT *, CAST(3 + page_id % 5 AS VARCHAR) AS first, CAST(4 + page_id % 5 AS VARCHAR) AS next,
  regexp_extract_all(nav, '<a href="[^"]*">(.*?)</a>', 1) AS links FROM parts),
m AS (SELECT *, trim({_md('h1')}) AS h, trim({_md('ad')}) AS a,
  coalesce((SELECT string_agg('| ' || replace(trim({_md('x')}), '|', '\\|') || ' | ' || CAST(i AS VARCHAR) || ' |', chr(10) ORDER BY i) || chr(10)
    FROM (SELECT unnest(links) AS x, generate_subscripts(links, 1) AS i)), '') AS body FROM t)
SELECT page_id, url, '# T' || chr(10) || chr(10) || '## ' || h || chr(10) || chr(10) || '- ' || a || chr(10) || '  ' || first || '. one' || chr(10) || '  ' || next || '. two' || chr(10)
  || chr(10) || '     ' || h || chr(10) || '- last' || chr(10) || chr(10) || '> ' || a || chr(10) || '>' || chr(10) || '> ' || h || chr(10) || '>' || chr(10) || '> - quoted' || chr(10) || chr(10)
  || '| a\\|b | ' || CAST(page_id AS VARCHAR) || ' |' || chr(10) || '| --- | --- |' || chr(10) || body || chr(10)
  || 'end of the page that is long enough to be an article by itself, which takes a hundred characters' AS text FROM m""")
def rich_markdown(spark, sf):
    part = lambda pattern: F.trim(F.regexp_extract("html", pattern, 1))
    links = F.regexp_extract_all("html", F.lit('(?s)<li><a href="[^"]*">(.*?)</a>'), F.lit(1))
    rows = F.array_join(F.transform(links, lambda x, i: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td>"), (i + 1).cast("string"), F.lit("</td></tr>"))), "")
    made = feeds.pages(spark, sf).withColumn("h1", part("(?s)<h1>(.*?)</h1>")).withColumn("ad", part('(?s)<div class="ad">(.*?)</div>')).withColumn("rows", rows)
    return extract.to_markdown(dom.build_dom(made.withColumn("html", F.expr(_RICH)).select("page_id", "url", "html")), max_chars=1_000_000)


MARKDOWN = f"""{PARAS},
mds AS (SELECT page_id, string_agg(repeat('**', CAST(bolds AS INT)) || {_md('words')} || CASE WHEN br THEN '  ' || chr(10) ELSE '' END
          || repeat('**', CAST(bolds AS INT)), chr(10) || chr(10) ORDER BY i) AS body FROM paras GROUP BY 1),
md AS (SELECT t.page_id, t.url, t.html, '# ' || trim(regexp_replace({_unescape('title')}, '\\s+', ' ', 'g')) || chr(10) || chr(10) AS head,
         '# ' || {_md('h1')} || coalesce(chr(10) || chr(10) || body, '') AS main
       FROM parts t LEFT JOIN mds m ON m.page_id = t.page_id),
final AS (SELECT page_id, url, CASE WHEN length(head || main) < 100 AND length({_PLAIN}) > length(head || main)
            THEN head || {_PLAIN} ELSE head || main END AS text FROM md)"""


def _cut(x: str, n: int) -> str:
    return (f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || chr(10) || chr(10) || '[...truncated, ' || "
            f"CAST(length({x}) - {n} AS VARCHAR) || ' more chars]' ELSE {x} END")


@query("markdown", f"WITH {MARKDOWN} SELECT page_id, url, text FROM final")
def markdown(spark, sf):
    return extract.to_markdown(_dom(spark, sf), max_chars=1_000_000)


@query("read_markdown", f"WITH {MARKDOWN} SELECT page_id, url, 'markdown' AS mode, {_cut('text', 1200)} AS content, NULL AS error FROM final")
def read_markdown(spark, sf):
    return extract.read_content(feeds.pages(spark, sf), max_chars=1200)


@query("read_raw_html", f"SELECT page_id, url, 'html' AS mode, {_cut('html', 700)} AS content, NULL AS error FROM pages")
def read_raw_html(spark, sf):
    return extract.read_content(feeds.pages(spark, sf), mode="html", compact=False, max_chars=700)


@query("read_heading_text", f"""WITH {PARTS} SELECT page_id, url, 'text' AS mode, {_tidy(_unescape('h1'))} AS content, NULL AS error FROM parts""")
def read_heading_text(spark, sf):
    return extract.read_content(feeds.pages(spark, sf), mode="text", selector="article > h1")


@query("read_missing", "SELECT page_id, url, 'html' AS mode, NULL AS content, 'Selector not found: #nothing' AS error FROM pages")
def read_missing(spark, sf):
    return extract.read_content(feeds.pages(spark, sf), mode="html", selector="#nothing")


@query("page_info", f"""WITH {PARTS}
SELECT page_id, url, trim(regexp_replace({_unescape('title')}, '\\s+', ' ', 'g')) AS title, NULL AS status,
  'HTTP status unknown' AS status_line FROM parts""")
def page_info(spark, sf):
    return extract.page_info(_dom(spark, sf))


@query("page_status", f"""WITH {PARTS}, s AS (SELECT url, arg_max(200 + page_id % 4 * 101, page_id * 7919 % 1009 * 1000000000 + page_id) AS status FROM pages GROUP BY 1)
SELECT page_id, p.url, trim(regexp_replace({_unescape('title')}, '\\s+', ' ', 'g')) AS title, status,
  'HTTP ' || status || CASE WHEN status >= 400 THEN ' (error)' ELSE '' END AS status_line FROM parts p JOIN s ON s.url = p.url""")
def page_status(spark, sf):
    net = feeds.pages(spark, sf).select(
        "url", (200 + F.col("page_id") % 4 * 101).cast("int").alias("status"),
        (F.col("page_id") * 7919 % 1009 * 1000000000 + F.col("page_id")).alias("seq"))
    return extract.page_info(_dom(spark, sf), net)
