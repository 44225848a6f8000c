"""Near-duplicates by a chosen-path set similarity join on word shingles.

Equal shingle sets are one class. Each class has minwise tokens (one per hash function). In each of several independent trees a
class starts at the node of one selected token; a node with more than ``NODE_ROWS`` classes branches by another token, selected
by a hash of the path, until nodes are small. Small nodes are compared exhaustively on packed sketches of the tokens. Nodes whose members
are similar on average (groups of near copies) do not branch; they are dealt into random blocks, other ones in each tree, that share
a few leaders.

First a node's best spanning links are confirmed on the full sets. Members of one dense root are taken as joined by it when later trees are looked at, so dense
groups are joined by a few links a class however many trees hold them. Then components that are still apart are joined by the best links
between them, and at last whatever looks similar and is not in one component even so is confirmed too; in nodes that stayed large every class
outside the largest component meets all others, block by block. So a link is left out only where its two ends are already
connected; no partner or candidate is capped. A large node has as many blocks as their rows' square root tells, so a class is copied to few of them, and
what met in a dense root of an earlier tree is not dealt again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, forget, row_key, settle

TREES = 12
TOKENS = 512
TOKEN_BITS = 2  # of a token, in a sketch
LETTERS = 64  # tokens that nodes branch by, four bits each; the first PROBES only tell dense nodes
PROBES = 8
BIN_ROWS = 48
FILTER_WORDS = 1 << 18  # 64-bit words of the filter in front of texts: 2 MB however many keys
NODE_ROWS = 96
DEPTH = 10
ROOT_TREES = TREES  # trees whose dense roots are compared: a pair at 0.8 is in none of them with 0.2**12
LEADERS = 6
SEATS = [f"seat{k}" for k in range(ROOT_TREES)]  # a class' dense root in each of those trees, or 0
SLACK = 3.5  # standard errors below the threshold that still count as a candidate
_RNG = np.random.Generator(np.random.PCG64(9))
_A = _RNG.integers(1, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of all words, if there are fewer. ASCII is lower-cased."""
    parts = text.encode("utf-8").lower().split() if text else []
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, n)
    size = min(n, words)
    x = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        x = _mix(x * _ODD[i % len(_ODD)] + h[i:n - size + 1 + i])
    if size < words:
        x = _mix(x + np.uint64(size))
    return np.unique(x)


def minwise(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 128):
        part = x[i:i + 128, None] * _A + _B
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(best, part.min(0), out=best)
    return best


def _signatures(words: int):
    def run(batches):
        forget()
        for batch in batches:
            n, cids, sketches, letters, keys = [], [], [], [], []
            for value in batch.column("text"):
                found = shingles(value.as_py(), words)
                n.append(len(found))
                if not len(found):
                    cids.append(None)
                    sketches.append(None)
                    letters.append(None)
                    keys.append(None)
                    continue
                tokens = minwise(found)
                cids.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True))
                low = (tokens & np.uint32(3)).astype(np.uint8)
                sketches.append((low[::4] << 6 | low[1::4] << 4 | low[2::4] << 2 | low[3::4]).tobytes())
                letters.append("".join(f"{t & 15:x}" for t in tokens[TREES:TREES + LETTERS].tolist()))
                roots = tokens[:TREES].astype(np.uint64) + (np.arange(TREES, dtype=np.uint64) << np.uint64(40))
                keys.append(_mix(roots * _ODD[0]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rk"), pa.array(n, pa.int64()), pa.array(cids, pa.int64()), pa.array(sketches, pa.binary()), pa.array(letters, pa.string()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "rk", "n", "cid", "sketch", "letters", "roots"])
    return run


def dense(large: DataFrame) -> DataFrame:
    """``node`` of the nodes whose members agree with each other in half of their tokens, on average.

    Members are dealt at random into bins of a few dozen; neighbours in a bin are compared in PROBES letters, one comparison a member.
    """
    bins = F.expr(f"cast(ceil(count / {BIN_ROWS}) as long)")
    binned = large.groupBy("node", F.pmod(F.xxhash64("cid", F.lit(5)), bins).alias("bin")).agg(F.collect_list(F.substring("letters", 1, PROBES)).alias("l"))
    same = lambda a, b: F.size(F.filter(F.sequence(F.lit(1), F.lit(PROBES)), lambda k: F.substr(a, k, F.lit(1)) == F.substr(b, k, F.lit(1))))
    agreed = F.aggregate(F.transform("l", lambda a, i: F.when(i > 0, same(a, F.get("l", i - 1))).otherwise(0)), F.lit(0), lambda acc, x: acc + x)
    share = F.sum(agreed) / F.sum(F.size("l") - 1) / PROBES
    return binned.groupBy("node").agg(share.alias("agree")).filter((F.col("agree") * 16 - 1) / 15 >= 0.5).select("node")


def nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, cid, tree) of the small leaves, and (node, cid, size, tree) of the large nodes that are compared as they are; below the
    roots their ``tree`` is ROOT_TREES.

    Those are dense nodes, which would branch in vain, and what is still large at DEPTH. Two similar classes share a
    root with a probability of their similarity, so the dense roots of all trees count.
    """
    level = classes.select("cid", F.posexplode("roots").alias("tree", "node"))
    small, big, depth = [], [], 0
    while True:
        sizes = level.groupBy("node").count().filter("count > 1")
        met = settle(level.join(sizes, "node"), f"near-level-{depth}")
        small.append(met.filter(F.col("count") <= NODE_ROWS).select("node", "cid", "tree"))
        large = met.filter(F.col("count") > NODE_ROWS)
        if large.isEmpty():
            break
        if not depth:  # from here on letters travel with the members of large nodes
            large = settle(large.join(classes.select("cid", "letters"), "cid"), "near-large")
        if depth == DEPTH:
            big.append(large.select("node", "cid", F.col("count").alias("size"), F.lit(ROOT_TREES).alias("tree")))
            break
        packed = settle(dense(large), "near-dense")
        as_is = large.join(packed, "node", "left_semi")
        at_root = as_is.filter(F.col("tree") < ROOT_TREES)
        big.append((as_is.withColumn("tree", F.lit(ROOT_TREES)) if depth else at_root).select("node", "cid", F.col("count").alias("size"), "tree"))
        depth += 1
        at = (F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(LETTERS - PROBES)) + PROBES).cast("int")  # the token selected at this node
        level = large.join(packed, "node", "left_anti").select(
            "cid", "tree", F.xxhash64("node", F.substr("letters", at + 1, F.lit(1))).alias("node"), "letters")
    empty = classes.select(F.col("cid").alias("node"), "cid", F.lit(0).alias("tree")).limit(0)
    for s in small:
        empty = empty.unionByName(s)
    none = classes.select(F.col("cid").alias("node"), "cid", F.col("n").alias("size"), F.lit(0).alias("tree")).limit(0)
    for s in big:
        none = none.unionByName(s)
    return empty, none


def _pairs(units, side, cid, n, sketch, comp, tree, seats, least: float, floor: float):
    """Index pairs within equal units (rows sorted by unit) that may be similar, with their estimates.

    Rows of side 0 are compared with each other; rows of side 1 with those of side 2, and, once for each pair, with those of side 3. Rows
    of one component are not compared at all (component -1: unknown). Two rows that also sit in one dense root of an earlier tree than their
    unit's are compared there.
    """
    out = []
    at = np.arange(len(units))
    step = 1
    while True:
        at = at[at + step < len(units)]
        at = at[units[at] == units[at + step]]
        if not len(at):
            break
        b = at + step
        s, t = side[at], side[b]
        meet = (s + t == 0) | (s * t == 2) | ((s == 1) & (t == 3) & (cid[at] < cid[b])) | ((s == 3) & (t == 1) & (cid[at] > cid[b]))
        ok = meet & (np.minimum(n[at], n[b]) >= floor * np.maximum(n[at], n[b])) & ((comp[at] < 0) | (comp[at] != comp[b]))
        for k, seat in enumerate(seats):
            ok &= ~((tree[at] > k) & (seat[at] == seat[b]) & (seat[at] != 0))
        i, j = at[ok], b[ok]
        for k in range(0, len(i), 1 << 13):
            p, q = i[k:k + (1 << 13)], j[k:k + (1 << 13)]
            share = (np.count_nonzero(sketch[p] == sketch[q], axis=1) * (4 / TOKENS) - 1) / 3  # a quarter of unequal tokens agrees by chance
            like = share >= least
            out.append((p[like], q[like], share[like]))
        step += 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _candidates(threshold: float, forest: bool):
    chance = 2.0 ** -TOKEN_BITS
    share = threshold + (1 - threshold) * chance
    least = threshold - SLACK * (share * (1 - share) / TOKENS) ** 0.5 / (1 - chance)

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        _, units = np.unique(rows.column("unit").to_numpy(), return_inverse=True)
        order = np.argsort(units, kind="stable")
        units = units[order]
        take = lambda name: rows.column(name).to_numpy()[order]
        packed = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS // 4)[order]
        sketch = np.concatenate([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1)
        i, j, share = _pairs(units, take("side"), take("cid"), take("n"), sketch, take("place"), take("tree"), [take(x) for x in SEATS], least, threshold)
        if forest and len(i):
            _, part = np.unique(take("place"), return_inverse=True)
            apart = np.where(take("place") < 0, np.arange(len(units)), len(units) + units * (part.max() + 1) + part)
            _, known = np.unique(apart, return_inverse=True)  # a unit's rows of one component are one from the start
            top = list(range(len(units)))

            def root(x):
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            kept = []
            for e in np.argsort(-share, kind="stable").tolist():  # rows of different units never meet, so one forest does for all
                a, b = root(int(known[i[e]])), root(int(known[j[e]]))
                if a != b:
                    top[a] = b
                    kept.append(e)
            i, j = i[kept], j[kept]
        cid = take("cid")
        a, b = np.minimum(cid[i], cid[j]), np.maximum(cid[i], cid[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        """The partition is sorted by unit; units may go on in the next batch."""
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("unit")[batch.num_rows - 1].as_py()
            own = np.flatnonzero(batch.column("unit").to_numpy() != last)
            cut = int(own[-1]) + 1 if len(own) else 0
            if cut or (held and held[0].column("unit")[0].as_py() != last):
                ready = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if ready.num_rows:
                    yield solve(ready)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))
    return run


def candidates(units: DataFrame, sketches: DataFrame, threshold: float, forest: bool) -> DataFrame:
    """(a, b) of unit members whose sketches agree enough; units are (unit, cid, side, place, tree), sketches (cid, n, sketch, *SEATS)."""
    seats = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in SEATS]
    return _solved(units.join(sketches, "cid").select("unit", "cid", "side", "place", "tree", *seats, "n", "sketch"), threshold, forest)


def _solved(rows: DataFrame, threshold: float, forest: bool) -> DataFrame:
    rows = rows.repartition("unit").sortWithinPartitions("unit").select("unit", "cid", "side", "place", "tree", *SEATS, "n", "sketch")
    return rows.mapInArrow(_candidates(threshold, forest), "a long, b long").distinct()


def positive(c: str) -> Column:
    """A key as a place: places that are not known are negative."""
    return F.col(c).bitwiseAND(F.lit((1 << 62) - 1))


def held() -> Column:
    """The first dense root of an earlier tree stands for the component that it is taken to make; where it does not, what is still apart is tried later."""
    return F.coalesce(*[F.when(F.col("tree") > k, positive(x)) for k, x in enumerate(SEATS)], F.lit(-1).cast("long"))


def seats_of(large: DataFrame) -> DataFrame:
    """(cid, *SEATS) of the classes in dense roots; null where a tree has none."""
    return settle(large.filter(F.col("tree") < ROOT_TREES).groupBy("cid").agg(*[F.max(F.when(F.col("tree") == k, F.col("node"))).alias(x) for k, x in enumerate(SEATS)]), "near-seats")


def crossing(large: DataFrame, placed: DataFrame) -> DataFrame:
    """Units (unit, cid, side, place, tree) in which the classes of a large node meet that are not in one component.

    ``large``: (node, cid, size, tree, held); ``placed``: (cid, place).
    Classes of one component, or that sit in one dense root of an earlier tree, need not meet here; the largest such group of a node meets only the
    classes outside. A node of n classes has sqrt(n / NODE_ROWS) blocks, and as many chunks of outsiders at most, so rows grow with n ** 1.5.
    """
    at_large = large.join(placed, "cid").withColumn("place", positive("place"))
    group = lambda by: at_large.filter(f"{by} >= 0").groupBy("node", F.col(by).alias("of")).count().withColumn("seat", F.lit(by == "held"))
    biggest = group("place").unionByName(group("held")).groupBy("node").agg(F.max(F.struct("count", "seat", "of")).alias("main"))
    inside = F.when(F.col("main.seat"), F.col("held")).otherwise(F.col("place")) == F.col("main.of")
    blocks = F.expr(f"cast(ceil(sqrt(size / {NODE_ROWS})) as long)")
    out_in = settle(at_large.join(biggest, "node").select("node", "cid", "place", "tree", blocks.alias("blocks"), (~inside).alias("out"), "size"), "near-outside")
    outside = out_in.filter("out").groupBy("node").agg(F.expr("cast(ceil(count(*) * max(blocks) / max(size)) as long)").alias("chunks"))
    met = out_in.join(outside, "node").drop("size")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outs = met.filter("out").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("chunks"))).withColumn("block", upto("blocks")).withColumn("side", F.lit(1))
    ins = met.withColumn("block", F.pmod(F.xxhash64("node", "cid"), F.col("blocks"))).withColumn("chunk", upto("chunks")).withColumn("side", F.when(F.col("out"), 3).otherwise(2))
    return outs.unionByName(ins).select(F.xxhash64("node", "chunk", "block", F.lit(1)).alias("unit"), "cid", "side", "place", "tree")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar; ``texts``: (cid, text).

    Pairs are handled in units of one class and a few dozen partners, however many it has.
    """
    busy = pairs.groupBy("a").agg(F.expr("cast(ceil(count(*) / 48) as long)").alias("parts"))
    placed = settle(pairs.join(busy, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "b", "part"), "near-pairs")
    needed = placed.select("a", "part", F.col("b").alias("cid")).unionByName(placed.select("a", "part", F.col("a").alias("cid"))).distinct()
    rows = needed.join(texts, "cid").repartition("a", "part").sortWithinPartitions("a", "part").select("a", "part", "cid", "text")
    percent = round(threshold * 100)

    def run(batches):
        now, sets = None, {}

        def solve():
            mine = sets.get(now[0])
            for cid, other in sets.items():
                if cid != now[0] and mine is not None:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        yield now[0], cid

        for batch in batches:
            good = []
            for a, part, cid, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "cid")), batch.column("text")):
                if (a, part) != now:
                    if now is not None:
                        good += solve()
                    now, sets = (a, part), {}
                sets[cid] = shingles(text.as_py(), words)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])
        if now is not None:
            good = list(solve())
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``rk`` is not among the keys; none that is among them goes.

    A Bloom filter of one bit a key, as a table of at most FILTER_WORDS rows (so its broadcast is bounded); where keys are
    many it passes more rows, and the exact join that follows drops them.
    """
    word, bit = F.pmod("rk", F.lit(FILTER_WORDS)), F.pmod(F.shiftrightunsigned("rk", 40), F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("bits"))
    hit = F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(one) == 1
    return rows.join(F.broadcast(words), word == F.col("word")).filter(hit).select(rows.columns)


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of every linked class: smallest label of the neighbours, with pointer jumping, until nothing changes."""
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cid"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        seen = both.join(labels.select(F.col("cid").alias("b"), F.col("label").alias("next")), "b").groupBy("a").agg(F.min("next").alias("next"))
        nearer = labels.join(seen.withColumnRenamed("a", "cid"), "cid").select("cid", "label", F.least("label", "next").alias("next"))
        jump = labels.select(F.col("cid").alias("next"), F.col("label").alias("far"))
        new = settle(nearer.join(jump, "next").select("cid", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "near-labels")
        labels = new.select("cid", "label")
        if new.filter("moved").isEmpty():
            return labels


def contract(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` (cid, place: component so far) after further links between classes; only components that are still apart meet."""
    at = lambda end: placed.select(F.col("cid").alias(end), F.col("place").alias(f"p{end}"))
    across = links.join(at("a"), "a").join(at("b"), "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
    moved = components(across).select(F.col("cid").alias("place"), F.col("label").alias("to"))
    return settle(placed.join(moved, "place", "left").select("cid", F.coalesce("to", "place").alias("place")), "near-places")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``, ``class_id``.

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is at least ``threshold`` (in whole
    percent); components are what links reach, named by their smallest id. A text without words has no shingles and no links. Rows that repeat an id
    share its fate; a null id is never smallest unless the component has no other. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).withColumn("rk", row_key(F.col("id"), F.col("text")))
    out = T.StructType([base.schema["id"], *T.StructType.fromDDL("rk long, n long, cid long, sketch binary, letters string, roots array<long>").fields])
    signed = settle(base.select("id", "rk", "text").mapInArrow(_signatures(words), out), "near-signatures")
    classes = settle(signed.filter("n > 0").groupBy("cid").agg(
        F.min("id").alias("first_id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("letters").alias("letters"), F.first("roots").alias("roots")), "near-classes")

    def texts_of(cids: DataFrame, purpose: str) -> DataFrame:
        """(cid, text) of some classes: their keys meet first, and few texts of other keys are shuffled."""
        keys = settle(classes.select("cid", "rk").join(cids, "cid", "left_semi"), "near-keys")
        return settle(likely(base.select("rk", "text"), keys).join(keys, "rk").dropDuplicates(["cid"]).select("cid", "text"), purpose)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()

    small, large = nodes(classes)
    large = settle(large, "near-dense-nodes")
    seats = seats_of(large)
    large = settle(large.join(seats, "cid", "left").select("node", "cid", "size", "tree", held().alias("held")), "near-nodes")
    sketches = settle(classes.select("cid", "n", "sketch").join(seats, "cid", "left"), "near-sketches")
    blocks = F.expr(f"cast(ceil(size / {NODE_ROWS}) as long)")
    dealt = large.select("node", "cid", "tree", F.pmod(F.xxhash64("node", "cid"), blocks).alias("block"), blocks.alias("blocks"))
    lead = large.groupBy("node", "size", "tree").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("cid", "node"), F.greatest(F.lit(1), (F.col("size") / (4 * LEADERS)).cast("long"))) == 0, F.col("cid")))), 1, LEADERS).alias("leaders"))
    led = lead.select("node", "tree", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "leaders").select("node", "tree", "block", F.explode("leaders").alias("cid"))
    in_blocks = dealt.select("node", "tree", "block", "cid").unionByName(led).distinct().select(F.xxhash64("node", "block").alias("unit"), "cid", "tree")
    units = small.select(F.col("node").alias("unit"), "cid", "tree").unionByName(in_blocks)
    zero = F.lit(0).cast("long")
    rows = units.join(sketches, "cid").select(
        "unit", "cid", F.lit(0).alias("side"), held().alias("place"), F.lit(0).alias("tree"), *[zero.alias(x) for x in SEATS], "n", "sketch")
    tried = settle(_solved(rows, threshold, forest=True), "near-forest")
    texts = texts_of(ends(tried), "near-texts")

    # A class' place is its component's label, or itself.
    label = components(settle(confirm(tried, texts, words, threshold), "near-sure"))
    placed = settle(classes.select("cid").join(label, "cid", "left").select("cid", F.coalesce("label", "cid").alias("place")), "near-places")

    def apart(placed: DataFrame) -> DataFrame:
        """Units (unit, cid, side, place, tree) in which all classes of a node meet that are not in one component."""
        place = positive("place").alias("place")
        again = small.select(F.col("node").alias("unit"), "cid", F.lit(0).alias("side")).join(placed, "cid").select("unit", "cid", "side", place, F.lit(ROOT_TREES).alias("tree"))
        mixed = again.groupBy("unit").agg((F.min("place") < F.max("place")).alias("apart")).filter("apart").select("unit")
        again = again.join(mixed, "unit", "left_semi")
        return again.unionByName(crossing(large, placed))

    # What is apart is joined by a unit's best links first; then every pair that may be similar and is apart even so is confirmed.
    for forest, purpose in ((True, "near-across"), (False, "near-more")):
        more = settle(candidates(apart(placed), sketches, threshold, forest).join(tried, ["a", "b"], "left_anti"), purpose)
        unread = ends(more).join(texts, "cid", "left_anti")
        if not unread.isEmpty():  # met only in a large node
            texts = texts.unionByName(texts_of(unread, "near-texts"))
        placed = contract(placed, settle(confirm(more, texts, words, threshold), "near-late"))
        tried = tried.unionByName(more)

    named = classes.select("cid", "first_id").join(placed, "cid").withColumnRenamed("place", "label")
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = named.select("cid", "label").join(names, "label").select("cid", "component_id")
    whole = signed.select("id", "n", "cid").filter("n > 0").join(found, "cid").unionByName(
        signed.filter("n = 0").select("cid", "id", "n", F.col("id").alias("component_id")))
    return whole.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("cid").alias("class_id"))
