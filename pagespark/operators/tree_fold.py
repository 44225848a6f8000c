"""Bottom-up work on semantic trees: rows of a snapshot in preorder go by, and a stack of open nodes turns them into a tree.

Rows are sorted once by (snapshot, ord); a task holds one snapshot, that is one page, at a time, and only positions, roles and names are looked at:
properties travel as Arrow columns. Steps are small rules that a node and its finished children are given to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Node:
    __slots__ = ("row", "role", "name", "own", "kids")

    def __init__(self, row: int, role: str | None, name: str | None, own: bool = True, kids: list | None = None):
        self.row, self.role, self.name, self.own, self.kids = row, role, name, own, kids or []


Step = Callable[[Node, dict[str, list]], Node | None]


def bottom_up(root: Node, rule: Callable[[Node], Node | None]) -> Node | None:
    """Replace every node by what the rule makes of it once its children are done; None drops it. Any depth."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.kids)
    done: dict[int, Node | None] = {}
    for node in reversed(order):
        if node.kids:
            node.kids = [k for k in (done.pop(id(k)) for k in node.kids) if k is not None]
        done[id(node)] = rule(node)
    return done[id(root)]


def hoisted(node: Node) -> Node | None:
    """What is left of a node that goes: nothing, its only child, or a group of its children."""
    if len(node.kids) > 1:
        return Node(node.row, "group", None, False, node.kids)
    return node.kids[0] if node.kids else None


def _grow(columns: dict[str, list], start: int, end: int) -> Node | None:
    """The tree of rows start..end; rows that the first one does not hold are left out."""
    root, stack = None, []
    at, last = columns["ord"], columns["last"]
    for i in range(start, end):
        node = Node(i, columns["role"][i], columns["name"][i])
        while stack and last[stack[-1].row] < at[i]:
            stack.pop()
        if stack:
            stack[-1].kids.append(node)
        elif root is None:
            root = node
        else:
            continue
        stack.append(node)
    return root


def _rows(root: Node, at: list[int], out: dict[str, list], blank: int) -> None:
    """Append the tree in preorder: places, and where each row's properties are (``blank``: nowhere)."""
    first, todo, lasts = len(out["row"]), [(root, None, 0)], []
    parents = []
    while todo:
        node, parent, depth = todo.pop()
        me = len(out["row"])
        parents.append(parent)
        lasts.append(at[node.row])
        for name, value in (("row", node.row), ("p", node.row if node.own else blank), ("role", node.role), ("name", node.name), ("depth", depth),
                            ("parent_ord", None if parent is None else at[out["row"][parent]])):
            out[name].append(value)
        todo.extend((k, me, depth + 1) for k in reversed(node.kids))
    for i in range(len(lasts) - 1, 0, -1):  # a parent stands before its children
        up = parents[i] - first
        lasts[up] = max(lasts[up], lasts[i])
    out["last"] += lasts


PIECE_ROWS = 2_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short slices of the batches, so that few rows at a time become objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)
            pa.default_memory_pool().release_unused()


def _snapshots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole snapshots with the row ranges of each; a snapshot may go on in the next piece."""
    held: list[pa.RecordBatch] = []
    for batch in _pieces(batches):
        ids = batch.column("snapshot_id")
        newest = ids[batch.num_rows - 1].as_py()
        cut = batch.num_rows
        while cut and ids[cut - 1].as_py() == newest:
            cut -= 1
        if held and (cut or held[0].column("snapshot_id")[0].as_py() != newest):
            yield _ranges(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield _ranges(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield _ranges(pa.Table.from_batches(held))


def _ranges(table: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    ids = table.column("snapshot_id").to_pylist()
    edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    return table, list(zip(edges, edges[1:]))


def in_order(ax: DataFrame) -> DataFrame:
    return ax.repartition("snapshot_id").sortWithinPartitions("snapshot_id", "ord")


PLACED = ["snapshot_id", "ord", "parent_ord", "depth", "last", "role", "name", "p"]


def fold_trees(ax: DataFrame, steps: Sequence[Step], extra: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """``ax`` after the steps, with places brought up to date. Steps may look at ``extra`` columns by a node's row.

    ``ordered`` promises that a snapshot's rows already follow each other in preorder, as they do when pages are taken apart; nothing is moved then.
    """
    rows = ax.select("snapshot_id", "ord", "last", "role", "name", "p", *extra)
    kinds = {f.name: f.dataType for f in rows.schema} | {"parent_ord": T.IntegerType(), "depth": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in PLACED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _snapshots(batches):
            columns = {c: table.column(c).to_pylist() for c in ("ord", "last", "role", "name", *extra)}
            out: dict[str, list] = {c: [] for c in ("row", "p", "role", "name", "depth", "parent_ord", "last")}
            for start, end in ranges:
                root = _grow(columns, start, end)
                for step in steps:
                    root = step(root, columns) if root is not None else None
                if root is not None:
                    _rows(root, columns["ord"], out, table.num_rows)
            props = table.column("p").combine_chunks()
            nothing = pa.array([dict.fromkeys(f.name for f in props.type)], props.type)
            kept = pa.array(out["row"], pa.int64())
            ready = {
                "snapshot_id": table.column("snapshot_id").combine_chunks().take(kept), "ord": table.column("ord").combine_chunks().take(kept),
                "parent_ord": pa.array(out["parent_ord"], pa.int32()), "depth": pa.array(out["depth"], pa.int32()),
                "last": pa.array(out["last"], table.column("last").type), "role": pa.array(out["role"], pa.string()), "name": pa.array(out["name"], pa.string()),
                "p": pa.concat_arrays([props, nothing]).take(pa.array(out["p"], pa.int64()))}
            yield pa.RecordBatch.from_arrays([ready[c] for c in PLACED], names=PLACED)

    return (rows if ordered else in_order(rows)).mapInArrow(run, schema)


def path_rows(ax: DataFrame) -> DataFrame:
    """snapshot_id, signature, role, name, state, pos of every distinct path, from ``part`` and ``state``: what the last node with it shows.

    The paths to the open nodes are on a stack, so a node's path is its parent's and one part more.
    """
    rows = ax.select("snapshot_id", "ord", "last", "role", "name", "part", "state")
    kind = rows.schema["snapshot_id"].dataType
    schema = T.StructType([T.StructField("snapshot_id", kind), T.StructField("signature", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("name", T.StringType()), T.StructField("state", T.StringType()), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, ranges in _snapshots(batches):
            at, last, part = (table.column(c).to_pylist() for c in ("ord", "last", "part"))
            paths, newest, first = [], [], []
            for start, end in ranges:
                stack: list[tuple[int, str]] = []
                seen: dict[str, list[int]] = {}
                for i in range(start, end):
                    while stack and stack[-1][0] < at[i]:
                        stack.pop()
                    path = (stack[-1][1] if stack else "") + "/" + part[i]
                    stack.append((last[i], path))
                    seen.setdefault(path, [at[i], i])[1] = i
                paths += seen
                first += [pos for pos, _ in seen.values()]
                newest += [i for _, i in seen.values()]
            kept = pa.array(newest, pa.int64())
            take = lambda c: table.column(c).combine_chunks().take(kept)
            yield pa.RecordBatch.from_arrays(
                [take("snapshot_id"), pa.array(paths, pa.string()), take("role"), take("name"), take("state"), pa.array(first, pa.int32())], names=schema.names)

    return in_order(rows).mapInArrow(run, schema)
