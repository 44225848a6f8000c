"""Semantic-tree jobs over node rows.

A tree is a set of rows (snapshot_id, ord, parent_ord, depth, last, role, name, p): ``ord`` is the preorder position (gaps are fine), ``last``
the highest position in the sub-tree (always a row of the tree), ``p`` the decoded properties.

What depends on a node's children (pruning, text collapse, compaction, depth limits, sub-trees) is a rule given to ``tree_fold``, which
passes over a snapshot once, deepest nodes first, for a whole chain of rules. Trees made from pages need no shuffle for it: a page's
rows leave it in order. A snapshot is one page, hence bounded.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lets import let
from ..functions.prefix import covers
from ..functions.text import json_string
from .dom import attr
from .tree_fold import PLACED, Node, bottom_up, fold_trees, hoisted, in_order
from .tree_rank import ranked_places
from .find import label_in, labels_of, may_be_named_by_content, name_from, role_of, text_of, title_col_text

# Roles kept by the compact view.
INTERACTIVE = """
button link textbox searchbox combobox listbox option checkbox radio switch slider spinbutton menuitem
menuitemcheckbox menuitemradio tab treeitem gridcell columnheader rowheader scrollbar
""".split()
STRUCTURAL = """
heading navigation main banner contentinfo form search dialog alertdialog region complementary tablist toolbar tree
grid listbox menubar menu list listitem table row rowgroup cell article figure tabpanel
""".split()

FLAGS = "disabled required readonly focused selected multiline multiselectable modal".split()
P_TYPE = (
    "struct<value:string,description:string,disabled:boolean,required:boolean,readonly:boolean,focused:boolean,"
    "selected:boolean,expanded:boolean,checked:string,pressed:string,level:double,invalid:string,valuemin:double,"
    "valuemax:double,valuetext:string,roledescription:string,haspopup:string,orientation:string,multiline:boolean,"
    "multiselectable:boolean,autocomplete:string,modal:boolean,keyshortcuts:string>"
)
P_FIELDS = [f.split(":")[0] for f in P_TYPE[7:-1].split(",")]
TREE = PLACED


def _p(**given: Column) -> Column:
    types = dict(f.split(":") for f in P_TYPE[7:-1].split(","))
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def _page() -> Window:
    return Window.partitionBy("snapshot_id").orderBy("ord")


# --- from pages and from raw node lists ---

def ax_from_dom(dom: DataFrame) -> DataFrame:
    """Raw semantic nodes of parsed pages (our definition of roles and names).

    The document is ``RootWebArea``; elements without a role are ``ignored``; text becomes
    ``StaticText``; hidden parts, scripts and void decoration are left out, ``last`` still counts them. A page's rows follow each other in preorder.
    """
    nodes = F.col("nodes")
    hidden_tags = ("head", "script", "style", "noscript", "template", "br", "wbr", "meta", "link")
    hidden = covers(nodes, lambda n: n["tag"].isin(*hidden_tags)
                    | F.coalesce(attr(n, "aria-hidden") == "true", F.lit(False)) | attr(n, "hidden").isNotNull())

    def marked(x: Column) -> Column:
        # Only what needs the whole page is taken inside the array; the rest runs on single nodes below.
        return F.transform(nodes, lambda n, i: F.struct(
            n.alias("n"),
            F.when(n["ord"] == 0, title_col_text(nodes)).when(may_be_named_by_content(n), text_of(nodes, n)).alias("said"),
            label_in(nodes, x["labels"], n).alias("label"),
            F.get(x["gone"], i).alias("gone")))

    def shown(m: Column, role: Column) -> Column:
        n = m["n"]
        text, root = n["kind"] == "text", n["ord"] == 0
        name = F.when(text, F.trim(F.regexp_replace(n["text"], "\\s+", " "))).when(root, m["said"]).otherwise(
            name_from(n, role, m["label"], m["said"]))
        checked = F.when(role.isin("checkbox", "radio", "switch"), F.coalesce(
            attr(n, "aria-checked"), F.when(attr(n, "checked").isNotNull(), "true").otherwise("false")))
        level = F.when(n["tag"].rlike("^h[1-6]$"), F.substring(n["tag"], 2, 1))
        valued = (n["tag"] == "input") & role.isin("textbox", "searchbox", "spinbutton", "slider")
        props = _p(
            value=F.when(valued & (F.length(attr(n, "value")) > 0), json_string(attr(n, "value"))),
            disabled=F.when(attr(n, "disabled").isNotNull(), True),
            required=F.when(attr(n, "required").isNotNull(), True),
            readonly=F.when(attr(n, "readonly").isNotNull(), True),
            expanded=F.when(attr(n, "aria-expanded").isin("true", "false"), attr(n, "aria-expanded") == "true"),
            checked=checked,
            pressed=attr(n, "aria-pressed"),
            level=F.coalesce(attr(n, "aria-level"), level).try_cast("double"),
        )
        shown_role = F.when(text, "StaticText").when(root, "RootWebArea").otherwise(role)
        return F.struct(shown_role.alias("role"), name.alias("name"), props.alias("p"))

    known = F.struct(hidden.alias("gone"), labels_of(nodes).alias("labels"))
    seen = dom.select(F.col("page_id").alias("snapshot_id"), F.explode(let(known, marked)).alias("m"))
    n = F.col("m.n")
    blank = (n["kind"] == "comment") | ((n["kind"] == "text") & ~n["text"].rlike("\\S"))
    # Bound by ``let``, so that the code made for a node stays short: the JVM compiles no method of more than 8000 bytes.
    told = let(F.col("m"), lambda m: let(F.when(m["n"]["kind"] == "element", role_of(m["n"])), lambda role: shown(m, role)))
    rows = seen.filter(~(F.col("m.gone") | blank)).select("snapshot_id", n.alias("n"), told.alias("t")).select(
        "snapshot_id", F.col("n.ord").alias("ord"), F.col("n.parent").alias("parent_ord"), F.col("n.depth").alias("depth"),
        F.col("n.last").alias("last"), "t.role", "t.name", "t.p", F.col("t.role").isNull().alias("ignored"))
    return rows


RAW = (
    "snapshot_id string, pos int, nodeId string, parentId string, childIds array<string>, ignored boolean, "
    "role string, name string, value variant, description string, "
    "properties array<struct<name:string,value:variant>>"
)


PLACE = "array<struct<nodeId:string,ord:int,parent_ord:int,depth:int,last:int>>"
_ARROW_PLACE = pa.list_(pa.struct([
    ("nodeId", pa.string()), ("ord", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()),
    ("last", pa.int32()),
]))


def _place(links: list[dict]) -> list[dict]:
    """Preorder positions of one snapshot's nodes, from their ids alone."""
    by_id = {n["nodeId"]: n for n in links}
    root = next((n for n in links if not n["parentId"] or n["parentId"] not in by_id), None)
    kids: dict[str, list] = {}
    taken = {root["nodeId"]} if root else set()
    for n in links:  # a node in several child lists belongs to the first
        for c in n["childIds"] or []:
            if c in by_id and c not in taken:
                taken.add(c)
                kids.setdefault(n["nodeId"], []).append(by_id[c])
    out, todo = [], [(root, None, 0)] if root else []
    while todo:
        node, parent, depth = todo.pop()
        me = len(out)
        out.append({"nodeId": node["nodeId"], "ord": me, "parent_ord": parent, "depth": depth, "last": me})
        todo.extend((k, me, depth + 1) for k in reversed(kids.get(node["nodeId"], [])))
    for row in reversed(out):
        if row["parent_ord"] is not None:
            up = out[row["parent_ord"]]
            up["last"] = max(up["last"], row["last"])
    return out


PIECE_NODES = 5_000


def _place_batches(batches):
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.list_value_length(batch.column("links")).to_pylist()):  # a few snapshots at a time
            size += n or 0
            if size >= PIECE_NODES or i + 1 == batch.num_rows:
                piece = batch.slice(start, i + 1 - start)
                placed = pa.array([_place(links) for links in piece.column("links").to_pylist()], _ARROW_PLACE)
                yield pa.RecordBatch.from_arrays([piece.column("snapshot_id"), placed], names=["snapshot_id", "places"])
                pa.default_memory_pool().release_unused()
                start, size = i + 1, 0


WALK_NODES = 100_000


def _ranked(links: DataFrame) -> DataFrame:
    """The places that ``_place`` gives, without holding a snapshot in a task."""
    ids = links.select("snapshot_id", F.col("nodeId").alias("id"))
    orphan = links.join(ids, (links["snapshot_id"] == ids["snapshot_id"]) & (F.col("parentId") == F.col("id")) & (F.col("parentId") != ""), "left_anti")
    roots = orphan.groupBy("snapshot_id").agg(F.min_by("nodeId", "pos").alias("root"))
    lists = links.filter(F.size("childIds") > 0).select("snapshot_id", F.col("nodeId").alias("parent"), "pos", F.posexplode("childIds").alias("i", "nodeId"))
    claims = lists.join(links.select("snapshot_id", "nodeId"), ["snapshot_id", "nodeId"]).groupBy("snapshot_id", "nodeId").agg(
        F.min(F.struct("pos", "i", "parent")).alias("c")).join(roots, "snapshot_id").filter("nodeId <> root")
    return ranked_places(links, claims.select("snapshot_id", "nodeId", F.col("c.parent").alias("parent"), F.col("c.i").alias("place")), roots)


def wire_tree(raw: DataFrame) -> DataFrame:
    """Place raw nodes (see ``RAW``) in trees: root, then children in ``childIds`` order.

    The root is the first node whose parent is absent; ids that name no node are skipped; a node in several child lists belongs to the first;
    nodes the root does not reach are left out. The ids of a snapshot of up to ``WALK_NODES`` nodes are walked in one group, those of larger ones
    are ranked by pointer doubling; names and properties stay outside and are joined afterwards.
    """
    links = raw.select("snapshot_id", "pos", "nodeId", "parentId", "childIds")
    big = links.groupBy("snapshot_id").count().filter(F.col("count") > WALK_NODES).select("snapshot_id")
    huge = not big.isEmpty()
    walked = links.join(big, "snapshot_id", "left_anti") if huge else links
    grouped = walked.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(F.struct("pos", "nodeId", "parentId", "childIds"))).alias("links"))
    placed = grouped.mapInArrow(_place_batches, f"snapshot_id string, places {PLACE}")
    rows = placed.select("snapshot_id", F.explode("places").alias("t")).select("snapshot_id", "t.*")
    if huge:
        rows = rows.unionByName(_ranked(links.join(big, "snapshot_id", "left_semi")))
    return rows.join(raw.drop("pos", "parentId", "childIds"), ["snapshot_id", "nodeId"])


def _truthy(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.rlike("^(OBJECT|ARRAY)"), True)
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
    )


def decode_props(wired: DataFrame) -> DataFrame:
    """Typed properties of wired raw nodes; noise values vanish, absent stays null."""

    def prop(name: str) -> Column:
        return F.try_element_at(F.filter("properties", lambda x: x["name"] == name), F.lit(-1))["value"]

    def kind(name: str) -> Column:
        return F.schema_of_variant(prop(name))

    def flag(name: str) -> Column:
        return F.when(_truthy(prop(name)), True)

    def text(name: str, noise: str | None = None) -> Column:
        said = F.when(kind(name) == "STRING", F.try_variant_get(prop(name), "$", "string"))
        return F.when(said != noise, said) if noise else said

    def number(name: str) -> Column:
        numeric = kind(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(numeric, F.try_variant_get(prop(name), "$", "double"))

    def tri(name: str) -> Column:
        mixed = (kind(name) == "STRING") & (F.try_variant_get(prop(name), "$", "string") == "mixed")
        return F.when(prop(name).isNotNull(), F.when(mixed, "mixed").otherwise(_truthy(prop(name)).cast("string")))

    shown = F.when(F.schema_of_variant(F.col("value")) != "VOID", F.to_json("value"))
    props = _p(
        value=shown, description=F.nullif("description", F.lit("")),
        expanded=F.when(prop("expanded").isNotNull(), _truthy(prop("expanded"))),
        checked=tri("checked"), pressed=tri("pressed"), level=number("level"),
        invalid=text("invalid", "false"), valuemin=number("valuemin"), valuemax=number("valuemax"),
        valuetext=text("valuetext"), roledescription=text("roledescription"), haspopup=text("haspopup", "false"),
        orientation=text("orientation"), autocomplete=text("autocomplete", "none"),
        keyshortcuts=text("keyshortcuts"), **{f: flag(f) for f in FLAGS},
    )
    return wired.select(
        *[c for c in TREE if c not in ("role", "name", "p")],
        F.coalesce("role", F.lit("generic")).alias("role"), F.nullif("name", F.lit("")).alias("name"),
        props.alias("p"), F.coalesce("ignored", F.lit(False)).alias("ignored"))


# --- rules given to the fold ---

def _prune(root: Node, rows: dict) -> Node | None:
    ignored = rows["ignored"]

    def rule(n: Node) -> Node | None:
        if n.role == "InlineTextBox":
            return None
        return hoisted(n) if ignored[n.row] else n
    return bottom_up(root, rule)


def _collapse(root: Node, rows: dict) -> Node | None:
    def rule(n: Node) -> Node:
        if any(k.role == "StaticText" for k in n.kids):
            if not n.name:
                said = [k.name for k in n.kids if k.role == "StaticText" and k.name and not k.kids]
                if said:
                    n.name = " ".join(said)
                    known = set(said)
                    n.kids = [k for k in n.kids if k.role != "StaticText" or (k.name or "") not in known]
            n.kids = [k for k in n.kids if k.role != "StaticText" or not k.name or k.name != n.name or k.kids]
        return n
    return bottom_up(root, rule)


SHOWN = frozenset(INTERACTIVE) | frozenset(STRUCTURAL)


def _compact(root: Node, rows: dict) -> Node | None:
    some = False

    def look(n: Node) -> Node:
        nonlocal some
        some = some or n.role in SHOWN
        return n
    bottom_up(root, look)
    return bottom_up(root, lambda n: n if n.role in SHOWN else hoisted(n)) if some else root


def prune_tree(ax: DataFrame, interesting_only: bool = True) -> DataFrame:
    """Drop inline text boxes with their sub-trees and dissolve ignored nodes: those vanish, give way to their only child, or become a ``group``."""
    return fold_trees(ax, [_prune] if interesting_only else [], extra=["ignored"] if interesting_only else [])


def filter_compact(ax: DataFrame) -> DataFrame:
    """Only interactive and structural roles; a tree with none of them stays as it is."""
    return fold_trees(ax, [_compact])


def collapse_text(ax: DataFrame) -> DataFrame:
    """Nameless parents take the joined names of their childless texts, deepest parents first; those texts go, and so does any text (even with
    children) that repeats one of them. A named parent only sheds childless texts that repeat its name.
    """
    return fold_trees(ax, [_collapse])


# --- depth, sub-trees, rendering ---

def limit_depth(ax: DataFrame, max_depth: int) -> DataFrame:
    """Replace the children of nodes at ``max_depth`` by one node that counts them."""
    if not 0 <= max_depth <= 50:
        raise ValueError("max_depth must be between 0 and 50")

    def cut(root: Node, rows: dict) -> Node:
        level = [root]
        for _ in range(max_depth):
            level = [k for n in level for k in n.kids]
        for n in level:
            if n.kids:
                many = len(n.kids)
                n.kids = [Node(n.kids[0].row, "…", f"{many} hidden child{'' if many == 1 else 'ren'}", False)]
        return root
    return fold_trees(ax, [cut])


def subtree(ax: DataFrame, targets: DataFrame | Column) -> DataFrame:
    """Target nodes with their descendants and ancestors. Targets are a table (snapshot_id, ord), or a condition on the nodes of ``ax``, which
    takes no second look at the trees."""
    if by_rule := isinstance(targets, Column):
        place = Window.partitionBy("snapshot_id", "ord")  # rows of one place are targets together; a tree without an id has none
        marked = in_order(ax).withColumn("_t", F.max(F.when(targets & F.col("snapshot_id").isNotNull(), True)).over(place))
    else:
        marked = ax.join(targets.select("snapshot_id", "ord").distinct().withColumn("_t", F.lit(True)), ["snapshot_id", "ord"], "left")

    def near(root: Node, rows: dict) -> Node | None:
        hit, held, todo = rows["_t"], set(), [(root, False)]
        while todo:
            n, below = todo.pop()
            below = below or bool(hit[n.row])
            if below:
                held.add(n.row)
            todo.extend((k, below) for k in n.kids)
        return bottom_up(root, lambda n: n if n.kids or n.row in held else None)
    return fold_trees(marked, [near], extra=["_t"], ordered=by_rule)


def number_text(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def attributes() -> Column:
    """Shown attributes of a node, in fixed order."""

    def said(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), value)

    p = F.col("p")
    return F.array_compact(F.array(
        said("value", p["value"]), said("checked", p["checked"]), said("pressed", p["pressed"]),
        *[F.when(p[f], f) for f in ("selected", "disabled", "required", "readonly")],
        said("expanded", p["expanded"].cast("string")), F.when(p["focused"], "focused"),
        said("level", number_text(p["level"])), said("invalid", F.nullif(p["invalid"], F.lit(""))),
    ))


def state_summary() -> Column:
    p = F.col("p")
    return F.concat_ws(
        ",",
        F.concat(F.lit("value="), p["value"]), F.concat(F.lit("checked="), p["checked"]),
        F.concat(F.lit("pressed="), p["pressed"]), F.when(p["selected"], "selected"), F.when(p["disabled"], "disabled"),
        F.concat(F.lit("expanded="), p["expanded"].cast("string")), F.when(p["focused"], "focused"),
    )


def node_line() -> Column:
    quoted = F.concat(F.lit(' "'), F.replace(F.col("name"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    name = F.when(F.length("name") > 0, quoted).otherwise("")
    attrs = F.array_join(attributes(), ", ")
    tail = F.when(attrs != "", F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise("")
    return F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("role"), name, tail)


def render_tree(ax: DataFrame) -> DataFrame:
    """Indented text per tree (one page's nodes per group)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", node_line().alias("line")))), lambda r: r["line"])
    return ax.groupBy("snapshot_id").agg(F.array_join(lines, "\n").alias("text"))


def snapshot_format(ax: DataFrame, kind: str = "yaml") -> DataFrame:
    """Trees as indented text, or as nested JSON built from each node's opening and closing pieces."""
    if kind == "yaml":
        return render_tree(ax)
    if kind != "json":
        raise ValueError(f"unknown format: {kind}")
    p = F.col("p")
    fields = F.to_json(F.struct(
        F.col("role").alias("role"), F.nullif("name", F.lit("")).alias("name"),
        *[p[f].alias(f) for f in P_FIELDS if f not in ("value", "checked", "pressed", "level", "valuemin", "valuemax")],
    ))
    raw = F.concat_ws(
        "", *[F.concat(F.lit(f',"{f}":'), v) for f, v in (
            ("value", p["value"]),
            ("checked", F.when(p["checked"] == "mixed", '"mixed"').otherwise(p["checked"])),
            ("pressed", F.when(p["pressed"] == "mixed", '"mixed"').otherwise(p["pressed"])),
            *[(f, number_text(p[f])) for f in ("level", "valuemin", "valuemax")])])
    head = F.concat(F.regexp_replace(fields, "\\}$", ""), raw)
    w = _page()
    after = F.coalesce(F.lead("depth").over(w), F.lit(0))
    final = F.lead("depth").over(w).isNull()
    up = F.when(final, F.col("depth")).otherwise(F.col("depth") - after)
    # Down one level opens a list of children; otherwise close this node and as many parents as needed.
    tail = F.when(~final & (after > F.col("depth")), ',"children":[').otherwise(
        F.concat(F.lit("}"), F.repeat(F.lit("]}"), F.greatest(up, F.lit(0))), F.when(final, "").otherwise(",")))
    pieces = ax.withColumn("_piece", F.concat(head, tail))
    return pieces.groupBy("snapshot_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "_piece"))), lambda r: r["_piece"]), "").alias("text"))


def semantic_tree(dom: DataFrame, interesting_only: bool = True) -> DataFrame:
    """Pages to pruned and collapsed trees, without a shuffle."""
    raw = ax_from_dom(dom)
    if not interesting_only:
        return fold_trees(raw.withColumn("role", F.coalesce("role", F.lit("generic"))), [], ordered=True)
    return fold_trees(raw, [_prune, _collapse], extra=["ignored"], ordered=True)


def compact_tree(dom: DataFrame) -> DataFrame:
    """Pages to compact trees in the same pass."""
    return fold_trees(ax_from_dom(dom), [_prune, _collapse, _compact], extra=["ignored"], ordered=True)
