"""Registered queries over semantic trees, searches, locators and page assertions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import ax, diff, dom, expect, find, tabs, user
from . import feeds
from .feeds_sql import BASE
from .page_queries import PARAS, PARTS, _unescape
from .registry import CATALOG, query


def _dom(spark, sf):
    return dom.build_dom(feeds.pages(spark, sf))


def _say(x: str) -> str:
    return f"replace(trim(regexp_replace({_unescape(x)}, '\\s+', ' ', 'g')), '\"', '\\\"')"


_NL = "chr(10)"
LINKS = f"""{PARAS},
links AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS text, len(l) AS n FROM (
  SELECT page_id, regexp_extract_all(nav, '<li><a href="[^"]*">(.*?)</a></li>', 1) AS l FROM parts)),
nav_lines AS (SELECT page_id, string_agg('      - listitem' || {_NL} || '        - link "' || {_say('text')} || '"', {_NL} ORDER BY i) AS body
  FROM links GROUP BY 1),
para_lines AS (SELECT page_id, string_agg('    - paragraph "' || {_say('words')} || '"', {_NL} ORDER BY i) AS body FROM paras GROUP BY 1)"""

_TREE = f"""'  - navigation' || {_NL} || '    - list' || coalesce({_NL} || n.body, '') || {_NL}"""
_HEADING = f"""'  - article' || {_NL} || '    - heading "' || {_say('h1')} || '" [level=1]' || {_NL}"""
_FOOT = f"""'  - contentinfo "' || {_say('foot')} || '"'"""
# The body has no role and several children, so it becomes a group, which takes the name of the ad's text.
_NAMED_GROUP = f"""'- RootWebArea "' || {_say('title')} || '"' || {_NL} || '  - group "' || {_say('ad')} || '"' || {_NL}"""
_INNER = f"{_TREE} || {_HEADING} || coalesce(q.body || {_NL}, '') || {_FOOT}"
_FULL_SQL = f"""WITH {LINKS}
SELECT p.page_id AS snapshot_id, {_NAMED_GROUP} || regexp_replace({_INNER}, '(?m)^', '  ', 'g') AS text
FROM parts p LEFT JOIN nav_lines n ON n.page_id = p.page_id LEFT JOIN para_lines q ON q.page_id = p.page_id"""


@query("semantic_trees", _FULL_SQL)
def semantic_trees(spark, sf):
    return ax.render_tree(ax.semantic_tree(_dom(spark, sf)))


def _raw_nodes(spark, sf):
    """Semantic nodes as a raw node list: ids, child ids, variant values."""
    rows = ax.ax_from_dom(_dom(spark, sf))
    kids = rows.filter(F.col("parent_ord").isNotNull()).groupBy("snapshot_id", F.col("parent_ord").alias("ord")).agg(
        F.transform(F.array_sort(F.collect_list("ord")), lambda c: c.cast("string")).alias("childIds"))
    level = F.filter(F.array(F.struct(
        F.lit("level").alias("name"), F.parse_json(ax.number_text(F.col("p.level"))).alias("value"))), lambda x: x["value"].isNotNull())
    return rows.join(kids, ["snapshot_id", "ord"], "left").select(
        F.col("snapshot_id").cast("string").alias("snapshot_id"), (-F.col("ord")).alias("pos"),
        F.col("ord").cast("string").alias("nodeId"), F.col("parent_ord").cast("string").alias("parentId"), "childIds",
        "ignored", "role", "name", F.parse_json("p.value").alias("value"), F.lit(None).cast("string").alias("description"),
        level.alias("properties"))


@query("wired_trees", _FULL_SQL)
def wired_trees(spark, sf):
    wired = ax.decode_props(ax.wire_tree(_raw_nodes(spark, sf)))
    text = ax.render_tree(ax.collapse_text(ax.prune_tree(wired)))
    return text.select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "text")


_COMPACT_SQL = f"""WITH {LINKS}
SELECT p.page_id AS snapshot_id, '- group' || {_NL} || {_TREE} || {_HEADING} || {_FOOT} AS text
FROM parts p LEFT JOIN nav_lines n ON n.page_id = p.page_id"""


@query("compact_trees", _COMPACT_SQL)
def compact_trees(spark, sf):
    return ax.render_tree(ax.compact_tree(_dom(spark, sf)))


@query("shallow_trees", f"""WITH {PARTS}
SELECT page_id AS snapshot_id, {_NAMED_GROUP} || '    - … "3 hidden children"' AS text FROM parts""")
def shallow_trees(spark, sf):
    return ax.render_tree(ax.limit_depth(ax.semantic_tree(_dom(spark, sf)), 1))


@query("navigation_subtrees", f"""WITH {LINKS}
SELECT p.page_id AS snapshot_id, {_NAMED_GROUP} || '    - navigation' || {_NL} || '      - list'
  || coalesce({_NL} || regexp_replace(n.body, '(?m)^', '  ', 'g'), '') AS text FROM parts p LEFT JOIN nav_lines n ON n.page_id = p.page_id""")
def navigation_subtrees(spark, sf):
    tree = ax.semantic_tree(_dom(spark, sf))
    return ax.render_tree(ax.subtree(tree, F.col("role") == "navigation"))


def _json_text(x: str) -> str:
    return f"CAST(to_json(trim(regexp_replace({_unescape(x)}, '\\s+', ' ', 'g'))) AS VARCHAR)"


@query("tree_json", f"""WITH {LINKS},
nj AS (SELECT page_id, string_agg('{{"role":"listitem","children":[{{"role":"link","name":' || {_json_text('text')} || '}}]}}', ',' ORDER BY i) AS body
       FROM links GROUP BY 1)
SELECT p.page_id AS snapshot_id, '{{"role":"group","children":[{{"role":"navigation","children":[{{"role":"list","children":[' || body
  || ']}}]}},{{"role":"article","children":[{{"role":"heading","name":' || {_json_text('h1')} || ',"level":1}}]}},{{"role":"contentinfo","name":'
  || {_json_text('foot')} || '}}]}}' AS text FROM parts p JOIN nj ON nj.page_id = p.page_id""")
def tree_json(spark, sf):
    return ax.snapshot_format(ax.compact_tree(_dom(spark, sf)), "json")


_GROUP = "'/group|'"
_SIGS = f"""sigs AS (
  SELECT page_id, {_GROUP} AS signature FROM parts UNION ALL SELECT page_id, {_GROUP} || '/navigation|' FROM parts
  UNION ALL SELECT page_id, {_GROUP} || '/navigation|/list|' FROM parts
  UNION ALL SELECT DISTINCT page_id, {_GROUP} || '/navigation|/list|/listitem|' FROM links
  UNION ALL SELECT DISTINCT page_id, {_GROUP} || '/navigation|/list|/listitem|/link|' || {_unescape('text')} FROM links
  UNION ALL SELECT page_id, {_GROUP} || '/article|' FROM parts
  UNION ALL SELECT page_id, {_GROUP} || '/article|/heading|' || trim(regexp_replace({_unescape('h1')}, '\\s+', ' ', 'g')) FROM parts
  UNION ALL SELECT page_id, {_GROUP} || '/contentinfo|' || trim(regexp_replace({_unescape('foot')}, '\\s+', ' ', 'g')) FROM parts)"""


@query("path_signatures", f"WITH {LINKS}, {_SIGS} SELECT page_id AS snapshot_id, signature FROM sigs")
def path_signatures(spark, sf):
    return diff.path_signature(ax.compact_tree(_dom(spark, sf))).select("snapshot_id", "signature")


def _two_versions(spark, sf):
    """Each page with a checkbox, and the same page after an edit: first link gone, one added, heading changed, box ticked."""
    box = '</h1><input type="checkbox" aria-label="agree">'
    p = feeds.pages(spark, sf)
    first = p.withColumn("html", F.regexp_replace("html", "</h1>", box))
    edited = F.regexp_replace(
        F.regexp_replace("html", "<ul><li>.*?</li>", '<ul><li><a href="/n">brand new</a></li>'),
        "</h1>", "!!" + box.replace(">", ">", 1).replace('label="agree"', 'label="agree" checked'))
    both = first.withColumn("v", F.lit(0)).unionByName(p.withColumn("html", edited).withColumn("v", F.lit(1)))
    parsed = dom.build_dom(both.withColumn("page_id", F.col("page_id") * 2 + F.col("v")))
    sigs = diff.path_signature(ax.compact_tree(parsed))
    return sigs.withColumn("v", F.col("snapshot_id") % 2).withColumn("snapshot_id", F.floor(F.col("snapshot_id") / 2))


def _diff(spark, sf):
    return diff.diff_versions(_two_versions(spark, sf), F.col("v") == 1)


_DIFF_ROWS = f"""first AS (SELECT a.page_id, a.text FROM links a WHERE a.i = 1
    AND NOT EXISTS (SELECT 1 FROM links b WHERE b.page_id = a.page_id AND b.i > 1 AND b.text = a.text)),
head AS (SELECT page_id, trim(regexp_replace({_unescape('h1')}, '\\s+', ' ', 'g')) AS h,
           trim(regexp_replace({_unescape('h1')} || '!!', '\\s+', ' ', 'g')) AS h2 FROM parts),
rows AS (
  SELECT page_id, 'added' AS kind, 'link "brand new"' AS signature, NULL AS was, NULL AS now, 1 AS o FROM parts
  UNION ALL SELECT page_id, 'added', 'heading "' || h2 || '"', NULL, NULL, 2 FROM head
  UNION ALL SELECT page_id, 'removed', 'link "' || {_unescape('text')} || '"', NULL, NULL, 1 FROM first
  UNION ALL SELECT page_id, 'removed', 'heading "' || h || '"', NULL, NULL, 2 FROM head
  UNION ALL SELECT page_id, 'changed', 'checkbox "agree"', 'checked=false', 'checked=true', 1 FROM parts)"""


@query("snapshot_diff", f"WITH {LINKS}, {_DIFF_ROWS} SELECT page_id AS snapshot_id, kind, signature, was, now FROM rows")
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select("snapshot_id", "kind", "signature", "was", "now")


@query("snapshot_diff_report", f"""WITH {LINKS}, {_DIFF_ROWS},
s AS (SELECT page_id, kind, CASE kind WHEN 'added' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS r,
        chr(10) || upper(kind[1]) || kind[2:] || ' (' || count(*) || '):' || chr(10) || string_agg(
          CASE kind WHEN 'added' THEN '  + ' || signature WHEN 'removed' THEN '  - ' || signature
               ELSE '  ~ ' || signature || '  [' || was || '] → [' || now || ']' END, chr(10) ORDER BY o) AS text FROM rows GROUP BY 1, 2)
SELECT page_id AS snapshot_id, '── diff vs "before" ──' || chr(10) || string_agg(text, chr(10) ORDER BY r) AS text FROM s GROUP BY 1""")
def snapshot_diff_report(spark, sf):
    base = feeds.pages(spark, sf).select(F.col("page_id").alias("snapshot_id"))
    return diff.diff_report(_diff(spark, sf), base, "before")


SNAPS = BASE + """,
s AS (SELECT profile || '/s' || (k % 2) AS session, 'n' || (k % 4) AS name, seq, k AS version FROM base WHERE event_type <> 'view')"""


def _snap_log(spark, sf):
    k = F.col("k")
    return feeds.base(spark, sf).filter(F.col("event_type") != "view").select(
        F.concat_ws("/", "profile", F.concat(F.lit("s"), (k % 2).cast("string"))).alias("session"),
        F.concat(F.lit("n"), (k % 4).cast("string")).alias("name"), "seq", k.alias("version"))


@query("snapshot_store", f"""WITH {SNAPS} SELECT session, name, version, seq FROM s a
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.session = a.session AND b.name = a.name AND b.seq > a.seq)""")
def snapshot_store(spark, sf):
    return diff.snapshot_store(_snap_log(spark, sf))


@query("snapshot_lookup", f"""WITH {SNAPS},
last AS (SELECT session, name, arg_max(version, seq) AS version FROM s WHERE seq <= (SELECT max(seq) // 32 FROM s) GROUP BY 1, 2),
w AS (SELECT DISTINCT profile || '/s' || (k % 2) AS session, 'n' || (k % 4) AS name FROM base WHERE event_type = 'view')
SELECT w.session, w.name, version, CASE WHEN version IS NULL THEN
  'No stored snapshot named "' || w.name || '". Use store_as= on an earlier call first.' END AS error
FROM w LEFT JOIN last l ON l.session = w.session AND l.name = w.name""")
def snapshot_lookup(spark, sf):
    k = F.col("k")
    wanted = feeds.base(spark, sf).filter(F.col("event_type") == "view").select(
        F.concat_ws("/", "profile", F.concat(F.lit("s"), (k % 2).cast("string"))).alias("session"),
        F.concat(F.lit("n"), (k % 4).cast("string")).alias("name")).distinct()
    log = _snap_log(spark, sf)
    early = (log.agg(F.max("seq")).first()[0] or 0) // 32  # a moment in the log's first part, when some names are still missing
    return diff.snapshot_lookup(diff.snapshot_store(log, as_of=early), wanted)


@query("rolling_diff", f"""WITH {LINKS}, {_SIGS},
v AS (SELECT DISTINCT 's' || (page_id % 10) AS session, page_id AS seq, signature FROM sigs),
p AS (SELECT session, seq, lag(seq) OVER (PARTITION BY session ORDER BY seq) AS prev FROM (SELECT DISTINCT session, seq FROM v))
SELECT p.session, 'page' AS name, p.seq, 'added' AS kind, v.signature FROM p JOIN v ON v.session = p.session AND v.seq = p.seq
  WHERE p.prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v o WHERE o.session = p.session AND o.seq = p.prev AND o.signature = v.signature)
UNION ALL SELECT p.session, 'page', p.seq, 'removed', v.signature FROM p JOIN v ON v.session = p.session AND v.seq = p.prev
  WHERE NOT EXISTS (SELECT 1 FROM v n WHERE n.session = p.session AND n.seq = p.seq AND n.signature = v.signature)""")
def rolling_diff(spark, sf):
    """Each tenth page is a version of one series: whole semantic trees against those before."""
    sigs = diff.path_signature(ax.compact_tree(_dom(spark, sf))).select(
        F.concat(F.lit("s"), (F.col("snapshot_id") % 10).cast("string")).alias("session"), F.lit("page").alias("series"),
        F.col("snapshot_id").alias("seq"), "signature", "role", "name", "state", "pos")
    got = diff.rolling_diff(sigs, ("session", "series"))
    return got.select("session", F.col("series").alias("name"), "seq", "kind", F.col("path").alias("signature"))


_BODY = "regexp_extract(html, '(?s)<body>(.*)', 1)"


@query("find_text", f"""WITH t AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (
  SELECT page_id, string_split_regex(regexp_replace({_BODY}, '<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS l FROM pages)),
c AS (SELECT page_id, i, regexp_replace({_unescape('raw')}, '^\\s+|\\s+$', '', 'g') AS s FROM t),
h AS (SELECT *, instr(lower(s), 'an') AS pos, row_number() OVER (PARTITION BY page_id ORDER BY i) AS hit FROM c
      WHERE length(s) >= 2 AND contains(lower(s), 'an'))
SELECT page_id, hit, CASE WHEN pos > 41 THEN '...' ELSE '' END || substr(s, greatest(pos - 40, 1), least(pos - 1, 40) + 42)
  || CASE WHEN pos + 41 < length(s) THEN '...' ELSE '' END AS snippet FROM h WHERE hit <= 7""")
def find_text(spark, sf):
    return find.find_text(_dom(spark, sf), "AN", 7).select("page_id", "hit", "snippet")


def _chain(*levels: str) -> str:
    """SQL for the last five of a list of path levels."""
    return f"array_to_string(list_slice(flatten([{', '.join(levels)}]), -5, -1), ' > ')"


@query("find_text_selectors", f"""WITH {LINKS},
np AS (SELECT page_id, count(*) AS n FROM paras GROUP BY 1),
fb AS (SELECT p.page_id, (SELECT least(3, sum(m.own)) FROM marked m WHERE m.page_id = p.page_id) AS b FROM parts p),
t AS (
  SELECT page_id, 1 AS part, i, 'a' AS tag, text AS raw, {_chain("['html', 'body', 'nav', 'ul']", "['li' || CASE WHEN n > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END, 'a']")} AS selector FROM links
  UNION ALL SELECT page_id, 2, 1, 'div', ad, 'html > body > div' FROM parts
  UNION ALL SELECT page_id, 3, 1, 'h1', h1, 'html > body > article > h1' FROM parts
  UNION ALL SELECT p.page_id, 4, i, CASE WHEN bolds > 0 THEN 'b' ELSE 'p' END, words,
    {_chain("['html', 'body', 'article']", "['p' || CASE WHEN n > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END]", "list_transform(range(CAST(bolds AS BIGINT)), lambda x: 'b')")}
    FROM paras p JOIN np ON np.page_id = p.page_id
  UNION ALL SELECT p.page_id, 5, 1, CASE WHEN fb.b > 0 THEN 'b' ELSE 'footer' END, foot,
    {_chain("['html', 'body', 'footer']", "list_transform(range(CAST(coalesce(fb.b, 0) AS BIGINT)), lambda x: 'b')")} FROM parts p JOIN fb ON fb.page_id = p.page_id),
c AS (SELECT *, regexp_replace({_unescape('raw')}, '^\\s+|\\s+$', '', 'g') AS s FROM t),
h AS (SELECT *, instr(lower(s), 'the') AS pos, row_number() OVER (PARTITION BY page_id ORDER BY part, i) AS hit FROM c
      WHERE length(s) >= 2 AND contains(lower(s), 'the'))
SELECT page_id, hit, tag, CASE WHEN pos > 41 THEN '...' ELSE '' END || substr(s, greatest(pos - 40, 1), least(pos - 1, 40) + 43)
  || CASE WHEN pos + 42 < length(s) THEN '...' ELSE '' END AS snippet, selector FROM h WHERE hit <= 50""")
def find_text_selectors(spark, sf):
    return find.find_text(_dom(spark, sf), "the", 50)


@query("link_paths", f"""WITH {LINKS}
SELECT page_id, 'body > nav > ul > li' || CASE WHEN n > 1 THEN ':nth-of-type(' || i || ')' ELSE '' END || ' > a' AS selector FROM links""")
def link_paths(spark, sf):
    paths = find.css_path(_dom(spark, sf))
    return paths.filter(F.col("tag") == "a").select("page_id", F.regexp_replace("selector", "^html > ", "").alias("selector"))


@query("locate_links", f"""WITH {LINKS}, c AS (SELECT page_id, i, {_unescape('text')} AS text FROM links)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, 'a' AS tag, text FROM c WHERE contains(lower(text), 'e')""")
def locate_links(spark, sf):
    return find.locate(_dom(spark, sf), "E", "role", role="link").drop("ord")


@query("locate_paragraphs", f"""WITH {PARAS}
SELECT page_id, i AS nth, 'p' AS tag, trim(regexp_replace({_unescape('words')}, '\\s+', ' ', 'g')) AS text FROM paras""")
def locate_paragraphs(spark, sf):
    return find.locate(_dom(spark, sf), "article > p", "selector").drop("ord")


@query("locate_heading_text", f"""WITH {PARTS}, c AS (SELECT page_id, trim(regexp_replace({_unescape('ad')}, '\\s+', ' ', 'g')) AS text FROM parts)
SELECT page_id, 1 AS nth, 'div' AS tag, text FROM c""")
def locate_ads(spark, sf):
    return find.locate(_dom(spark, sf), "div.ad", "selector").drop("ord")


_FORM = """concat('<form><label>Mail ', page_id % 7, ' <input class="m" data-testid="box', page_id % 5, '"></label><label for="z">Zip code</label>',
  '<input id="z" placeholder="Find item ', page_id % 10, '"><button>Go ', page_id % 3, '</button><p>Say <b>word ', page_id % 4, '</b></p></form>')"""


def _forms(spark, sf):
    """Each page with a small form behind its heading."""
    return dom.build_dom(feeds.pages(spark, sf).withColumn("html", F.replace("html", F.lit("</h1>"), F.concat(F.lit("</h1>"), F.expr(_FORM)))))


@query("locate_by_label", """SELECT page_id, 1 AS nth, 'input' AS tag, '' AS text FROM pages WHERE page_id % 7 = 3""")
def locate_by_label(spark, sf):
    return find.locate(_forms(spark, sf), "mail 3", "label", exact=False).drop("ord")


@query("locate_by_label_exactly", """SELECT page_id, 1 AS nth, 'input' AS tag, '' AS text FROM pages""")
def locate_by_label_exactly(spark, sf):
    return find.locate(_forms(spark, sf), "Zip code", "label", exact=True).drop("ord")


@query("locate_by_placeholder", """SELECT page_id, 1 AS nth, 'input' AS tag, '' AS text FROM pages WHERE page_id % 10 = 4""")
def locate_by_placeholder(spark, sf):
    return find.locate(_forms(spark, sf), "ITEM 4", "placeholder").drop("ord")


@query("locate_by_testid", """SELECT page_id, 1 AS nth, 'input' AS tag, '' AS text FROM pages WHERE page_id % 5 = 2""")
def locate_by_testid(spark, sf):
    return find.locate(_forms(spark, sf), "box2", "testid").drop("ord")


@query("locate_by_role", """SELECT page_id, 1 AS nth, 'button' AS tag, 'Go 1' AS text FROM pages WHERE page_id % 3 = 1""")
def locate_by_role(spark, sf):
    return find.locate(_forms(spark, sf), "go 1", "role", role="button").drop("ord")


@query("locate_by_text", """SELECT page_id, 1 AS nth, 'b' AS tag, 'word 2' AS text FROM pages WHERE page_id % 4 = 2""")
def locate_by_text(spark, sf):
    return find.locate(_forms(spark, sf), "word 2", "text", exact=True).drop("ord")


@query("locate_by_position", f"""WITH {LINKS}, c AS (SELECT page_id, i, {_unescape('text')} AS text FROM links WHERE i % 2 = 1 AND i < n)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, 'a' AS tag, text FROM c""")
def locate_by_position(spark, sf):
    return find.locate(_dom(spark, sf), "nav li:nth-child(odd):not(:last-child) > a", "selector").drop("ord")


@query("locate_by_siblings", f"""WITH {PARAS}, c AS (SELECT page_id, i, trim(regexp_replace({_unescape('words')}, '\\s+', ' ', 'g')) AS text FROM paras WHERE i > 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, 'p' AS tag, text FROM c""")
def locate_by_siblings(spark, sf):
    return find.locate(_dom(spark, sf), "h1 ~ p + p:not(:nth-of-type(2))", "selector").drop("ord")


RULES = [
    expect.Rule("heading shown", "visible", "h1", "selector"),
    expect.Rule("script hidden", "hidden", "script", "selector"),
    expect.Rule("nothing hidden", "hidden", "#nothing", "selector"),
    expect.Rule("nothing shown", "visible", "#nothing", "selector"),
    expect.Rule("link enabled", "enabled", "nav a", "selector"),
    expect.Rule("no target", "enabled"),
    expect.Rule("heading text", "text_contains", "h1", "selector", expected="th"),
    expect.Rule("heading pattern", "text_matches", "h1", "selector", expected="^[A-Z]"),
    expect.Rule("bad pattern", "text_matches", "h1", "selector", expected="[open"),
    expect.Rule("six links", "count", "nav li", "selector", expected=6),
    expect.Rule("no expected", "count", "nav li", "selector"),
    expect.Rule("https", "url_matches", expected="^https:"),
    expect.Rule("title", "title_matches", expected="\\.$"),
]


@query("page_assertions", f"""WITH {LINKS},
t AS (SELECT p.page_id, p.url, trim(regexp_replace({_unescape('h1')}, '\\s+', ' ', 'g')) AS h,
        trim(regexp_replace({_unescape('title')}, '\\s+', ' ', 'g')) AS title,
        (SELECT count(*) FROM links l WHERE l.page_id = p.page_id) AS n FROM parts p)
SELECT page_id, 'heading shown' AS rule_id, TRUE AS ok, 'visible' AS actual, NULL AS detail FROM t
UNION ALL SELECT page_id, 'script hidden', TRUE, 'hidden', NULL FROM t
UNION ALL SELECT page_id, 'nothing hidden', TRUE, '0', 'no match' FROM t
UNION ALL SELECT page_id, 'nothing shown', FALSE, '0', 'not found' FROM t
UNION ALL SELECT page_id, 'link enabled', n > 0, CASE WHEN n > 0 THEN 'enabled' ELSE '0' END, CASE WHEN n = 0 THEN 'not found' END FROM t
UNION ALL SELECT page_id, 'no target', FALSE, NULL, 'target required' FROM t
UNION ALL SELECT page_id, 'heading text', contains(h, 'th'), h, NULL FROM t
UNION ALL SELECT page_id, 'heading pattern', regexp_matches(h, '^[A-Z]'), h, NULL FROM t
UNION ALL SELECT page_id, 'bad pattern', FALSE, NULL, 'bad regex: Unclosed character class' FROM t
UNION ALL SELECT page_id, 'six links', n = 6, CAST(n AS VARCHAR), NULL FROM t
UNION ALL SELECT page_id, 'no expected', FALSE, NULL, 'target + expected required' FROM t
UNION ALL SELECT page_id, 'https', starts_with(url, 'https:'), url, NULL FROM t
UNION ALL SELECT page_id, 'title', suffix(title, '.'), title, NULL FROM t""")
def page_assertions(spark, sf):
    got = expect.check_expectations(_dom(spark, sf), RULES)
    return got.select("page_id", "rule_id", "ok", "actual", "detail")


_REPORT_SQL = CATALOG["page_assertions"].sql.replace("WITH ", "WITH meta(rule_id, assertion, expected) AS (VALUES " + ", ".join(
    "('{}', '{}', {})".format(r.rule_id, r.assertion, "NULL" if r.expected is None else "'" + json.dumps(r.expected) + "'")
    for r in RULES) + "), ", 1).replace("SELECT page_id, 'heading shown'", "r AS (SELECT page_id, 'heading shown'", 1) + """)
SELECT page_id, r.rule_id, CASE WHEN ok THEN 'PASS ' || assertion || coalesce(' — ' || detail, '')
  ELSE 'FAIL ' || assertion || coalesce(' expected=' || expected, '')
    || coalesce(' actual=' || CASE WHEN assertion = 'count' OR detail = 'not found' THEN actual ELSE CAST(to_json(actual) AS VARCHAR) END, '')
    || coalesce(chr(10) || '  ' || detail, '') || chr(10) || '  (retried for 5000ms)' END AS report
FROM r JOIN meta m ON m.rule_id = r.rule_id"""
_REPORT_SQL = _REPORT_SQL.replace("FROM parts p)\nr AS", "FROM parts p),\nr AS")


@query("assertion_reports", _REPORT_SQL)
def assertion_reports(spark, sf):
    return expect.check_expectations(_dom(spark, sf), RULES).select("page_id", "rule_id", "report")


@query("retried_assertions", f"""WITH {BASE},
c AS (SELECT tab_id AS rule_id, event_type AS key, ts_ms % 86400000 // 1440 AS ts_ms, k > 95 AS ok, CAST(k AS VARCHAR) AS actual, seq FROM base),
i AS (SELECT * FROM c WHERE ts_ms <= 20000),
l AS (SELECT rule_id, key, arg_max(actual, ts_ms) AS last_actual, bool_or(ok) AS ok, min(ts_ms) FILTER (WHERE ok) AS passed_ms FROM i GROUP BY 1, 2)
SELECT DISTINCT c.rule_id, c.key, coalesce(l.ok, FALSE) AS ok, l.passed_ms, CASE WHEN NOT coalesce(l.ok, FALSE) THEN l.last_actual END AS last_actual
FROM c LEFT JOIN l ON l.rule_id = c.rule_id AND l.key = c.key""")
def retried_assertions(spark, sf):
    checks = feeds.base(spark, sf).select(
        F.col("tab_id").alias("rule_id"), F.col("event_type").alias("key"), F.lit(0).alias("t0_ms"),
        F.floor((F.col("ts_ms") % 86_400_000) / 1440).alias("ts_ms"), (F.col("k") > 95).alias("ok"),
        F.col("k").cast("string").alias("actual"))
    return expect.check_within(checks, 20_000)


@query("evaluated_pages", """SELECT page_id, CAST(to_json({'host': split_part(url, '/', 3), 'long': length(html) > 3000}) AS VARCHAR) AS result FROM pages""")
def evaluated_pages(spark, sf):
    return user.evaluate(feeds.pages(spark, sf), "named_struct('host', split_part(url, '/', 3), 'long', length(html) > 3000)")


@query("evaluated_undefined", """SELECT page_id, CASE WHEN length(html) > 3000 THEN CAST(length(html) AS VARCHAR) ELSE 'undefined' END AS result FROM pages""")
def evaluated_undefined(spark, sf):
    return user.evaluate(feeds.pages(spark, sf), "if(length(html) > 3000, length(html), null)")


@query("condition_waits", f"""WITH {BASE}
SELECT tab_id AS key, min(ts_ms) FILTER (WHERE value > 100) AS met_ms, count(*) FILTER (WHERE value > 100) > 0 AS met FROM base GROUP BY 1""")
def condition_waits(spark, sf):
    versions = feeds.base(spark, sf).select(F.col("tab_id").alias("key"), "ts_ms", "value", F.lit(0).alias("t0_ms"))
    return tabs.first_satisfied(versions, F.expr("value > 100"), 2_000_000_000_000)


@query("tokenizer_function", f"""WITH {LINKS} SELECT page_id, count(*) AS links FROM links GROUP BY 1""")
def tokenizer_function(spark, sf):
    nodes = dom.dom_nodes(dom.build_dom(feeds.pages(spark, sf)))
    return nodes.filter(F.col("tag") == "a").groupBy("page_id").agg(F.count("*").alias("links"))
