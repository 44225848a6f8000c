"""From pages to node trees.

A parsed page stays one row: its preorder nodes are an array of structs, and a node's
position in the array is its ``ord``. Operators on a page are then array expressions with
no shuffle at all; ``dom_nodes`` explodes the arrays where rows are wanted. A page is
bounded by the size cap, so its array is too.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html_tree import parse_nodes
from ..functions.lets import let
from ..functions.prefix import covers
from ..functions.text import MAX_HTML_CHARS

NODE = (
    "struct<ord:int,parent:int,depth:int,last:int,kind:string,tag:string,attrs:map<string,string>,"
    "text:string,nth:int,nth_n:int,pos:int,pos_n:int,prev:int>"
)
_ARROW_NODE = pa.struct([
    ("ord", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("last", pa.int32()),
    ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("nth", pa.int32()), ("nth_n", pa.int32()), ("pos", pa.int32()), ("pos_n", pa.int32()), ("prev", pa.int32()),
])
_FIELDS = [f.name for f in _ARROW_NODE]


def cap_html(pages: DataFrame, n: int = MAX_HTML_CHARS) -> DataFrame:
    """Cut HTML at ``n`` characters; ``cut`` marks pages that were longer."""
    over = F.length("html") > n
    return pages.withColumn("cut", over).withColumn(
        "html", F.when(over, F.substring("html", 1, n)).otherwise(F.col("html"))
    )


PIECE_BYTES = 512_000


def _pieces(batch):
    """Slices of a batch with a bounded amount of HTML, so node lists of many pages never pile up. Only the lengths of the texts are looked at."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column("html")).to_pylist()):
        size += n or 0
        if size >= PIECE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _parsed(html: pa.Array) -> list[pa.Array]:
    """Node lists and errors of some pages; nodes go into one list a field, so that no page's rows are held as objects."""
    columns: dict[str, list] = {f: [] for f in _FIELDS}
    ends, errors, keys, values, attr_ends = [0], [], [], [], [0]
    for doc in html:
        try:
            rows = parse_nodes(doc.as_py() or "")
            error = None
        except Exception as exc:  # a bad document must not fail the job
            rows, error = [], f"{type(exc).__name__}: {exc}"
        for name, column in zip(_FIELDS, zip(*rows)):
            columns[name] += column
        errors.append(error)
        ends.append(len(columns["ord"]))
    for pairs in columns["attrs"]:
        for k, v in pairs or ():
            keys.append(k)
            values.append(v)
        attr_ends.append(len(keys))
    told = pa.array([pairs is None for pairs in columns.pop("attrs")], pa.bool_())
    kinds = {f.name: f.type for f in _ARROW_NODE}
    made = {name: pa.array(column, kinds[name]) for name, column in columns.items()}
    made["attrs"] = pa.MapArray.from_arrays(pa.array(attr_ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()), mask=told)
    nodes = pa.StructArray.from_arrays([made[f] for f in _FIELDS], fields=list(_ARROW_NODE))
    bad = pa.array([e is not None for e in errors], pa.bool_())
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes, type=pa.list_(_ARROW_NODE), mask=bad), pa.array(errors, pa.string())]


def _parse_batches(batches):
    for whole in batches:
        for batch in _pieces(whole):
            keep = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _parsed(batch.column("html")), names=[*keep, "nodes", "error"])
            pa.default_memory_pool().release_unused()


def _parse(docs: DataFrame) -> DataFrame:
    keep = [f for f in docs.schema.fields if f.name != "html"]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return docs.mapInArrow(_parse_batches, f"{head}nodes array<{NODE}>, error string")


def build_dom(pages: DataFrame, dedupe: bool = False, copies_per_task: int = 10_000) -> DataFrame:
    """Parse pages (page_id, url, html): adds ``cut``, ``nodes`` and ``error``, drops ``html``.

    The plain form parses in place and shuffles nothing. With ``dedupe`` every distinct
    document is parsed once and joined back; a document with many copies is spread over
    several join keys, so a third of all pages sharing one text still split evenly.
    """
    capped = cap_html(pages)
    if not dedupe:
        return _parse(capped)
    keyed = capped.withColumn("_doc", F.sha2("html", 256))
    copies = keyed.groupBy("_doc").agg(F.count("*").alias("n"), F.min("page_id").alias("_first"))
    spread = copies.select(
        "_doc", "_first", F.ceil(F.col("n") / copies_per_task).cast("int").alias("_parts"))
    # The representative row of each document carries its text; only ids and hashes were grouped.
    owners = keyed.select(F.col("page_id").alias("_first"), "_doc", "html")
    trees = _parse(owners.join(spread, ["_doc", "_first"]).drop("_first"))
    fanned = trees.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    slim = keyed.drop("html").join(spread.drop("_first"), "_doc")
    placed = slim.withColumn("_part", F.pmod(F.xxhash64("page_id"), F.col("_parts")).cast("int")).drop("_parts")
    return placed.join(fanned, ["_doc", "_part"]).drop("_doc", "_part")


def dom_nodes(dom: DataFrame) -> DataFrame:
    """One row per node of the pages that parsed."""
    return dom.select("page_id", F.explode("nodes").alias("n")).select(
        "page_id", F.col("n.ord").alias("node_ord"), F.col("n.parent").alias("parent_ord"),
        "n.depth", "n.kind", "n.tag", "n.attrs", "n.text",
        F.col("n.last").alias("last_ord"), F.col("n.nth").alias("sib_same_tag"),
        F.col("n.nth_n").alias("sib_same_tag_n"),
    )


def bad_pages(dom: DataFrame) -> DataFrame:
    """Quarantine: pages that could not be parsed, with the reason."""
    return dom.filter(F.col("error").isNotNull()).select("page_id", "url", "error")


# --- array helpers ---

def attr(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def drop_subtrees(nodes: Column, doomed) -> Column:
    """Nodes outside every sub-tree whose root satisfies ``doomed``; earlier cuts do not matter."""
    gone = covers(nodes, lambda n: (n["kind"] == "element") & doomed(n))
    return let(gone, lambda g: F.filter(nodes, lambda n, i: ~F.get(g, i)))


def inside(nodes: Column, root: Column) -> Column:
    """The node ``root`` (a struct) and everything below it."""
    return let(root, lambda r: F.filter(nodes, lambda n: n["ord"].between(r["ord"], r["last"])))
