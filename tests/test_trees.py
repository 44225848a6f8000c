"""Semantic-tree jobs against a direct recursion on random trees, and fixed cases."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagespark.operators import ax, diff, tree_fold

ROLES = ["button", "heading", "list", "listitem", "generic", "StaticText", "InlineTextBox", "paragraph", "link"]
NAMES = ["a", "b", "x y", None, ""]


def random_tree(rng, depth=0):
    node = {"role": rng.choice(ROLES), "name": rng.choice(NAMES), "ignored": rng.random() < 0.35, "kids": []}
    if depth < 5:
        node["kids"] = [random_tree(rng, depth + 1) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    return node


def rows_of(sid, tree):
    out = []

    def walk(node, anc):
        me = len(out)
        row = [sid, me, anc[-1] if anc else None, len(anc), me, node["role"], node["name"], node["ignored"]]
        out.append(row)
        for kid in node["kids"]:
            walk(kid, [*anc, me])
        row[4] = len(out) - 1

    walk(tree, [])
    return [tuple(r) for r in out]


def prune(node):
    if node["role"] == "InlineTextBox":
        return None
    kids = [k for k in map(prune, node["kids"]) if k]
    if node["ignored"]:
        return None if not kids else kids[0] if len(kids) == 1 else {"role": "group", "name": None, "kids": kids}
    return {"role": node["role"], "name": node["name"] or None, "kids": kids}


def compact(node):
    kids = [k for k in map(compact, node["kids"]) if k]
    if node["role"] in ax.INTERACTIVE or node["role"] in ax.STRUCTURAL:
        return {**node, "kids": kids}
    return None if not kids else kids[0] if len(kids) == 1 else {"role": "group", "name": None, "kids": kids}


def collapse(node):
    kids = [collapse(k) for k in node["kids"]]
    name = node["name"]
    if not name:
        texts = [k["name"] for k in kids if k["role"] == "StaticText" and k["name"] and not k["kids"]]
        if texts:
            name = " ".join(texts)
            kids = [k for k in kids if not (k["role"] == "StaticText" and (k["name"] or "") in texts)]
    kids = [k for k in kids if not (k["role"] == "StaticText" and k["name"] and k["name"] == name and not k["kids"])]
    return {**node, "name": name, "kids": kids}


def lines(node, depth=0):
    name = f' "{node["name"]}"' if node["name"] else ""
    return [f"{'  ' * depth}- {node['role']}{name}"] + [x for k in node["kids"] for x in lines(k, depth + 1)]


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(7)
    trees = {i: random_tree(rng) for i in range(400)}
    data = [r for i, t in trees.items() for r in rows_of(i, t)]
    df = spark.createDataFrame(
        data, "snapshot_id int, ord int, parent_ord int, depth int, last int, role string, "
              "name string, ignored boolean").withColumn("p", ax._p()).withColumn("name", F.nullif("name", F.lit("")))
    return trees, df


def texts(df):
    return {r["snapshot_id"]: r["text"] for r in ax.render_tree(df).collect()}


def test_prune_and_compact_equal_recursion(forest):
    trees, df = forest
    got = texts(ax.prune_tree(df))
    want = {i: "\n".join(lines(p)) for i, t in trees.items() if (p := prune(t))}
    assert got == want
    shown = texts(ax.filter_compact(ax.prune_tree(df)))
    want = {i: "\n".join(lines(compact(p) or p)) for i, t in trees.items() if (p := prune(t))}
    assert shown == want


def test_collapse_equals_recursion(forest):
    trees, df = forest
    got = texts(ax.collapse_text(ax.prune_tree(df)))
    want = {i: "\n".join(lines(collapse(p))) for i, t in trees.items() if (p := prune(t))}
    assert got == want


def test_links_stay_sound(forest):
    _, df = forest
    tree = ax.filter_compact(ax.prune_tree(df)).cache()
    orphans = tree.filter(F.col("parent_ord").isNotNull()).join(
        tree.select("snapshot_id", F.col("ord").alias("parent_ord")), ["snapshot_id", "parent_ord"], "left_anti")
    assert orphans.count() == 0
    ends = tree.select("snapshot_id", F.col("ord").alias("last"))
    assert tree.filter("last < ord").count() == 0 and tree.join(ends, ["snapshot_id", "last"], "left_anti").count() == 0
    sigs = diff.path_signature(tree)
    assert diff.diff_snapshots(sigs, sigs).count() == 0


RAW = ("snapshot_id string, pos int, nodeId string, parentId string, childIds array<string>, ignored boolean, "
       "role string, name string, value string, description string, properties string")


def raw(spark, *rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], RAW)
    return df.withColumn("value", F.parse_json("value")).withColumn(
        "properties", F.from_json("properties", "array<struct<name:string,value:variant>>"))


def test_wiring_skips_dangling_ids_and_cycles(spark):
    tree = ax.decode_props(ax.wire_tree(raw(
        spark,
        ("r", None, ["b", "gone", "a"], None, "WebArea", "T", None, None, None),
        ("a", "r", None, None, "button", "A", None, None, None),
        ("b", "r", None, None, None, None, None, None, None))))
    assert texts(tree) == {"s": '- WebArea "T"\n  - generic\n  - button "A"'}
    loop = ax.wire_tree(raw(
        spark, ("a", "b", ["b"], None, "x", None, None, None, None), ("b", "a", ["a"], None, "y", None, None, None, None)))
    assert loop.count() == 0


def test_property_rules(spark):
    props = ('[{"name":"checked","value":"mixed"},{"name":"expanded","value":false},{"name":"level","value":2},'
             '{"name":"invalid","value":"false"},{"name":"haspopup","value":"false"},{"name":"autocomplete","value":"none"},'
             '{"name":"required","value":true},{"name":"disabled","value":false}]')
    tree = ax.decode_props(ax.wire_tree(raw(spark, ("r", None, None, None, "checkbox", 'say "hi"', "5", "d", props))))
    row = tree.select("p").first()["p"].asDict()
    shown = {k: v for k, v in row.items() if v is not None}
    assert shown == {"value": "5", "description": "d", "required": True, "expanded": False, "checked": "mixed", "level": 2.0}
    assert texts(tree) == {"s": '- checkbox "say \\"hi\\"" [value=5, checked=mixed, required, expanded=false, level=2]'}


def test_depth_limit_and_report(spark):
    data = rows_of(1, {"role": "list", "name": None, "ignored": False, "kids": [
        {"role": "listitem", "name": f"n{i}", "ignored": False, "kids": [
            {"role": "link", "name": "l", "ignored": False, "kids": []}]} for i in range(120)]})
    schema = ("snapshot_id int, ord int, parent_ord int, depth int, last int, role string, "
              "name string, ignored boolean")
    tree = spark.createDataFrame(data, schema).withColumn("p", ax._p())
    assert texts(ax.limit_depth(tree, 0)) == {1: '- list\n  - … "120 hidden children"'}
    assert texts(ax.limit_depth(tree, 1))[1].count('… "1 hidden child"') == 120
    # Markers do not survive the compact filter.
    assert "…" not in texts(ax.filter_compact(ax.limit_depth(tree, 1)))[1]
    empty = tree.filter("ord = 0")
    d = diff.diff_snapshots(diff.path_signature(empty), diff.path_signature(tree))
    text = diff.diff_report(d, tree, "before").first()["text"]
    assert text.startswith('── diff vs "before" ──\n\nAdded (240):\n  + listitem "n0"\n  + link "l"\n')
    assert text.endswith("  …(140 more)")
    same = diff.diff_report(diff.diff_snapshots(diff.path_signature(tree), diff.path_signature(tree)), tree, "before")
    assert same.first()["text"] == 'No changes since "before"'


def test_ranking_equals_walking(spark, monkeypatch):
    """Pointer doubling gives the places of the walk: chains, stars, dangling and repeated ids, several roots, cycles off the tree."""
    rng = random.Random(12)
    rows = []
    for s in range(30):
        n = rng.choice([1, 2, 3, 9, 40])
        parent = [None] + [max(0, i - 1) if s % 5 == 0 else 0 if s % 5 == 1 else rng.randrange(i) for i in range(1, n)]
        kids = {i: [j for j in range(1, n) if parent[j] == i] for i in range(n)}
        for k in kids.values():
            rng.shuffle(k)
        order = list(range(n))
        if s % 3:
            rng.shuffle(order)
        for pos, i in enumerate(order):
            listed = [f"n{j}" for j in kids[i]]
            if s % 4 == 0:
                listed = ["gone", *listed, *listed[:1], "n0"]
            rows.append((f"s{s}", pos, f"n{i}", None if parent[i] is None else f"n{parent[i]}", listed or None))
        if s % 7 == 0:  # another tree and a cycle that the root does not reach
            rows += [(f"s{s}", 1000, "x", "nobody", ["y"]), (f"s{s}", 1001, "y", "x", None), (f"s{s}", 1002, "a", "b", ["b"]), (f"s{s}", 1003, "b", "a", ["a"])]
    rows += [("loop", 0, "a", "b", ["b"]), ("loop", 1, "b", "a", ["a"])]
    df = spark.createDataFrame(rows, "snapshot_id string, pos int, nodeId string, parentId string, childIds array<string>").withColumn("role", F.lit("r"))
    walked = sorted(map(tuple, ax.wire_tree(df).collect()), key=repr)
    monkeypatch.setattr(ax, "WALK_NODES", 5)
    ranked = sorted(map(tuple, ax.wire_tree(df).select(*ax.wire_tree(df).columns).collect()), key=repr)
    assert len(walked) > 200 and ranked == walked


def test_tree_folds_of_a_deep_tree(spark):
    node = {"role": "StaticText", "name": "deep", "ignored": False, "kids": []}
    for i in range(3000):
        node = {"role": "StaticText" if i % 2 else "generic", "name": None, "ignored": i % 3 == 0, "kids": [node]}
    rows, todo = [], [(node, None, 0)]
    while todo:
        n, up, depth = todo.pop()
        rows.append([1, len(rows), up, depth, 3000, n["role"], n["name"], n["ignored"]])
        todo += [(k, len(rows) - 1, depth + 1) for k in n["kids"]]
    df = spark.createDataFrame([tuple(r) for r in rows], "snapshot_id int, ord int, parent_ord int, depth int, last int, role string, name string, ignored boolean").withColumn("p", ax._p())
    out = ax.collapse_text(ax.prune_tree(df)).collect()
    assert out and max(r["depth"] for r in out) == len(out) - 1
    assert diff.path_signature(ax.collapse_text(ax.prune_tree(df))).count() == len(out)


def test_wiring_holds_a_few_snapshots_at_a_time():
    links = [[{"nodeId": "a", "parentId": None, "childIds": ["b", "c"], "pos": 0}, {"nodeId": "b", "parentId": "a", "childIds": [], "pos": 1},
              {"nodeId": "c", "parentId": "a", "childIds": None, "pos": 2}]] * 4000
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("nodeId", pa.string()), ("parentId", pa.string()), ("childIds", pa.list_(pa.string()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(4000)]), pa.array(links, kind)], names=["snapshot_id", "links"])
    got = list(ax._place_batches([batch, batch.slice(0, 0)]))
    assert [x for b in got for x in b.column("snapshot_id").to_pylist()] == batch.column("snapshot_id").to_pylist()
    assert all(x == ax._place(links[0]) for b in got for x in b.column("places").to_pylist())
    assert max(b.num_rows for b in got) * 3 <= ax.PIECE_NODES + 3


def test_folding_takes_short_slices():
    rows = pa.RecordBatch.from_arrays([pa.array([i // 3 for i in range(9_000)])], names=["snapshot_id"])
    tables = list(tree_fold._snapshots([rows]))
    assert sum(len(ranges) for _, ranges in tables) == 3_000 and sum(t.num_rows for t, _ in tables) == 9_000
    assert max(t.num_rows for t, _ in tables) <= tree_fold.PIECE_ROWS + 3


def test_subtrees_by_condition(forest):
    ax_rows = ax.filter_compact(forest[1].filter("snapshot_id < 60"))
    want = ax.subtree(ax_rows, ax_rows.filter(F.col("role") == "list"))
    got = ax.subtree(ax_rows, F.col("role") == "list")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
