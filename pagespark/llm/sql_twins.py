"""SQL that gives the rows of the registered queries on the same tables."""

from .licenses import BASE, TEMPLATES, as_regex, words_of

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""

OP5 = rf"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, row_number() OVER () AS r,
    coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
best AS (SELECT r, first(h || p ORDER BY length(h) + length(p) DESC, length(h) DESC) AS rule, first(verdict ORDER BY length(h) + length(p) DESC, length(h) DESC) AS verdict
    FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

OP7 = """
WITH l AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
once AS (SELECT min(coalesce('=' || source, '')) AS site, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL GROUP BY text),
spread AS (SELECT bare FROM (SELECT site, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM once) WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.*, s.bare IS NOT NULL AS gone FROM k LEFT JOIN spread s ON k.bare = s.bare),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS rest FROM m GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines, g AS n_removed, CASE WHEN g > 0 THEN coalesce(rest, '') ELSE text END AS text
FROM documents d JOIN a USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

OP10 = f"""
WITH rows AS (SELECT doc_id, coalesce('=' || source, '') AS src, len({WORDS.format("coalesce(text, '')")}) AS size, md5('mix:' || doc_id) AS ord FROM documents),
sizes AS (SELECT src, sum(size)::BIGINT AS ss FROM rows GROUP BY src),
ranked AS (SELECT *, row_number() OVER (ORDER BY (src = '')::INT, src) AS place FROM sizes),
weighted AS (SELECT *, [1, 2, 3][((place - 1) % 3 + 1)::INT] AS w FROM ranked),
levels AS (SELECT *, ((sum(ss) OVER ()) - coalesce(sum(3 * ss) OVER before, 0))::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
    FROM weighted WINDOW before AS (ORDER BY (3 * ss)::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, least((3 * ss)::DOUBLE, max(level) OVER () * w) AS target FROM levels),
line AS (SELECT *, sum(target) OVER (ORDER BY place) AS hi FROM targets),
whole AS (SELECT max(hi) AS upto, sum(ss)::BIGINT AS total FROM line),
points AS (SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE * upto AS x
    FROM (SELECT unnest(range(0, (total + 1023) // 1024)) AS slot, upto FROM whole)),
slots AS (SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM points JOIN line ON x >= hi - target AND x < hi),
counts AS (SELECT src, count(*) AS n FROM slots GROUP BY src),
plan AS (SELECT *, greatest(1, floor(slots * ss / greatest(target, 1e-9)))::BIGINT AS blocks, floor(target)::BIGINT AS due FROM (
    SELECT l.*, coalesce(c.n, CASE WHEN target >= 1 THEN 1 ELSE 0 END) AS slots FROM line l LEFT JOIN counts c USING (src))),
ranks AS (SELECT src, rank FROM slots UNION ALL SELECT src, 0 FROM plan WHERE slots > 0 AND src NOT IN (SELECT src FROM counts)),
used AS (SELECT src, rank % blocks AS block, ss, blocks, greatest(0, least(
        due - ((rank // blocks) * ss + ((rank % blocks) * ss) // blocks), ((rank % blocks + 1) * ss) // blocks - ((rank % blocks) * ss) // blocks)) AS words
    FROM ranks JOIN plan USING (src)),
placed AS (SELECT r.*, ss, target, sum(size) OVER (PARTITION BY src ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS off FROM rows r JOIN plan USING (src)),
took AS (SELECT doc_id, sum(greatest(0, least(
        words - (greatest(off, (block * u.ss) // blocks) - (block * u.ss) // blocks),
        least(off + size, ((block + 1) * u.ss) // blocks) - greatest(off, (block * u.ss) // blocks)))) AS taken
    FROM placed p JOIN used u ON p.src = u.src AND off < ((block + 1) * u.ss) // blocks AND off + size > (block * u.ss) // blocks GROUP BY doc_id)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN took USING (doc_id)
"""

FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

OP11 = f"""
WITH RECURSIVE crc(id, i, c) AS (SELECT DISTINCT doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
    SELECT id, i + 1, list_reduce([xor(c, ascii(id[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
    FROM crc WHERE i < length(id)),
odd AS (SELECT id FROM crc WHERE i = length(id) AND xor(c, 4294967295) % 2 = 0),
d AS (SELECT doc_id, coalesce('=' || source, '') AS k, {LEAF.format("text")} AS leaf,
    CASE WHEN doc_id::VARCHAR IN (SELECT id FROM odd) THEN {LEAF.format("replace(text, chr(10), '')")} ELSE {LEAF.format("text")} END AS seen FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM d),
t(k, lvl, i, n, h) AS (SELECT k, 0, r, n, leaf FROM l UNION ALL
    SELECT k, lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY k, lvl, i // 3),
s AS (SELECT k, lvl AS height, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, i, n, h) AS (SELECT 0, r, n, subroot FROM s UNION ALL SELECT lvl + 1, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3),
top AS (SELECT h AS root, lvl AS height FROM u WHERE n = 1),
nodes AS (SELECT k, lvl, i, h FROM t WHERE n > 1 UNION ALL SELECT s.k, s.height + u.lvl, u.i, u.h FROM u, s WHERE u.n > 1),
steps AS (SELECT a.k, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lt, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rt
    FROM nodes a JOIN nodes b ON a.k = b.k AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 GROUP BY ALL),
f(k, lvl, i, r, acc, proof) AS (SELECT k, 0, r, r, seen, '' FROM l UNION ALL
    SELECT f.k, f.lvl + 1, CASE WHEN f.lvl + 1 = s.height THEN s.r ELSE f.i // 3 END, f.r, sha256(lt || acc || rt), proof || lt || rt
    FROM f JOIN s ON s.k = f.k JOIN steps p ON p.k = f.k AND p.lvl = f.lvl AND p.i = CASE WHEN s.height = 0 AND f.lvl = 0 THEN s.r ELSE f.i END),
last AS (SELECT k, r, arg_max(acc, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM f GROUP BY k, r)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (k) JOIN last ON last.k = l.k AND last.r = l.r, top
"""

PLACES = " || ".join(
    "[{'label': '%s', 'at': i - 1} FOR i IN range(1, len(w) + 1) IF w[i:i + %d] = %s]" % (t.label, len(ws) - 1, [x.decode() for x in ws])
    for t in BASE for ws in [words_of(t.markup)])
EXTRA = " || ".join(f"CASE WHEN regexp_matches(t, '{as_regex(t.markup)}') THEN [{{'label': '{t.label}', 'weight': {t.weight}::DOUBLE}}] ELSE [] END" for t in TEMPLATES)

OP12 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {PLACES} AS base, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
e AS (SELECT *, {EXTRA} AS extra FROM p)
SELECT doc_id, n_words, len(base) AS n_base, list_min([b.at FOR b IN base]) AS first_word, list_max([b.at FOR b IN base]) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct([b.label FOR b IN base])), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct([b.label FOR b IN base] || [x.label FOR x IN extra])), ','), '') AS labels,
    greatest(CASE WHEN len(base) > 0 THEN 0.5::DOUBLE ELSE 0 END, coalesce(list_max([x.weight FOR x IN extra]), 0)) AS score
FROM e
"""

OP13 = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS seed, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
crc(seed, i, c) AS (SELECT DISTINCT seed, 0, 4294967295::BIGINT FROM raw UNION ALL
    SELECT seed, i + 1, list_reduce([xor(c, ascii(seed[i + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
    FROM crc WHERE i < length(seed)),
hits AS (SELECT seed, xor(c, 4294967295) % 20 AS hit FROM crc WHERE i = length(seed)),
damaged AS (SELECT coalesce('=' || conv_id, '') AS k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM raw JOIN hits USING (seed) WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
faults AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS c,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
pairs AS (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY i) || c AS pair FROM faults),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY k),
-- places 0 start, 1 system, 2 user, 3 assistant
ins(q, p, price, letters, extra) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']),
    (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 0, '', []),
    (3, 2, 3, 'I', ['user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
moves(p, edit, c, t, price) AS (SELECT p, 'D', NULL::VARCHAR, p, 4 FROM (VALUES (0), (1), (2), (3)) v(p) UNION ALL VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0),
    (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', NULL, 2, 3), (1, 'R', NULL, 2, 3), (2, 'R', NULL, 3, 3), (3, 'R', NULL, 2, 3)),
dp(k, i, q, best) AS (SELECT k, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': []::VARCHAR[]} FROM counts UNION ALL
    SELECT f.k, f.i, m.t, min({'cost': best.cost + ins.price + m.price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END, 'audit': best.audit || letters || edit,
        'said': best.said || extra || CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE m.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END})
    FROM dp JOIN faults f ON f.k = dp.k AND f.i = dp.i + 1 JOIN ins ON ins.q = dp.q JOIN moves m ON m.p = ins.p AND (m.c IS NULL OR m.c = f.c) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
    GROUP BY f.k, f.i, m.t),
done AS (SELECT k, min({'cost': best.cost + price, 'audit': best.audit || letters, 'said': best.said || extra}) AS best
    FROM dp JOIN counts USING (k) JOIN ins USING (q) WHERE i = n AND p IN (0, 3) GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id, '') AS k FROM conversations) LEFT JOIN counts USING (k) LEFT JOIN done USING (k)
"""

SQL = {
    "op2_exact_dedup": OP2,
    "op5_url_filter": OP5,
    "op7_line_spread": OP7,
    "op9_near_dedup": OP9,
    "op10_mixing": OP10,
    "op11_merkle_manifest": OP11,
    "op12_license_scan": OP12,
    "op13_conversation_repair": OP13,
}
