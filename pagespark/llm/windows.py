"""Repeated byte windows by a depth-limited most-significant-digit radix sort of suffixes.

A window of ``WIDTH`` bytes is removed where an equal one starts anywhere else. Sorting all suffixes to that depth would
shuffle every byte hundreds of times, so passes sort what they must, by longer and longer digits; a
suffix alone in its group leaves, and groups still equal at depth ``WIDTH`` are exactly the repeated windows.

* Each window has an anchor, the leftmost of its ``GRAM``-byte strings with the smallest hash. Equal windows have the
  same anchor at the same offset, so they are sorted as (offset, bytes around the anchor), and consecutive windows that share an
  anchor travel as one item (anchor, range of offsets) per node, a fixed range of ``NODE`` offsets.
* First digit: the bytes that all of a node's windows have in common (core). Items alone under their core have no repeated
  window and leave the sort.
* Second digit: the bytes that any of them has (outer). If another item has the same, all windows of the range are repeated.
* Last digit: windows of the remaining items, at the edges of repeated passages, one by one. They are first
  narrowed to nodes of ``FINE`` offsets, by cores and outers again.

Digits are compared as polynomial fingerprints of 64 bits (cores, which only decide what is looked at further) or
128 bits (outers and windows). Counts are summed where the items are made before anything is shuffled, and items meet the counts in
joins that adaptive execution can split, so a passage in a third of all documents is no task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, row_key, settle

WIDTH = 400
GRAM = 17
NODE = 96
FINE = 12
BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_POSITION = np.uint64((1 << 20) - 1)


class Prints:
    """Two independent polynomial fingerprints of any stretch of a buffer, from prefix sums modulo 2**64."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they can be divided by
    _powers: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    _bytes = [np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (11, 12)]

    @classmethod
    def powers(cls, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        room = 1 << max(10, (size - 1).bit_length())
        if room not in cls._powers:
            made = []
            for m in cls.MULTIPLIERS:
                pair = []
                for base in (m, pow(m, -1, 1 << 64)):
                    steps = np.full(room, base, np.uint64)
                    steps[0] = 1
                    pair.append(np.multiply.accumulate(steps))
                made.append(tuple(pair))
            cls._powers[room] = made
        return cls._powers[room]

    def __init__(self, buffer: np.ndarray):
        self.n = len(buffer)
        self.power = self.powers(self.n + 1)
        self.sums = []
        for values, (up, _) in zip(self._bytes, self.power):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(values[buffer] * up[:self.n], out=s[1:])
            self.sums.append(s)

    def of(self, which: int, start, end) -> np.ndarray:
        s = self.sums[which]
        x = (s[end] - s[start]) * self.power[which][1][start]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def anchors(prints: Prints, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of all windows in a buffer; ``ends[i]`` is the end of byte i's text."""
    at = np.arange(prints.n - gram + 1)
    v = (prints.of(0, slice(0, prints.n - gram + 1), slice(gram, prints.n + 1)) & ~_POSITION) | at.astype(np.uint64)
    span, m, wanted = 1, v, width - gram + 1
    while span * 2 <= wanted:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < wanted:
        m = np.minimum(m[:len(v) - wanted + 1], m[wanted - span:])
    whole = np.flatnonzero(ends[:len(m)] - at[:len(m)] >= width)
    place = (m[whole] & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    begin = np.concatenate([[0], cut]).astype(np.int64)
    end = np.concatenate([cut, [len(place)]]).astype(np.int64) - 1
    if not len(place):
        begin = end = begin[:0]
    return place[begin], whole[begin], whole[end]


def split(prints: Prints, begins: np.ndarray, ends: np.ndarray, a, low, high, width: int, node: int):
    """Items (core, outer1, outer2, has_outer, anchor, low, high, row) of anchors with offsets low..high, one per node they touch.

    ``begins`` and ``ends``: text borders by byte. ``row`` is the index of the anchor given.
    """
    first = low // node
    times = high // node - first + 1
    row = np.repeat(np.arange(len(a)), times)
    t = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + first[row]
    lo, hi, x = t * node, (t + 1) * node - 1, a[row]
    core = prints.of(0, x - lo, x + width - hi) + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    o0, o1 = x - hi, x + width - lo
    ok = (o0 >= begins[x]) & (o1 <= ends[x])
    p, q = np.where(ok, o0, 0), np.where(ok, o1, 0)
    return core, prints.of(0, p, q), prints.of(1, p, q), ok, x, np.maximum(low[row], lo), np.minimum(high[row], hi), row


def stretches(texts: list[bytes], margin: int):
    """Buffers of about BLOCK bytes: (bytes, text of each byte, its begin and end in the buffer, offset in the text, own range).

    Short texts share a buffer; a long one is cut, with ``margin`` bytes of context on either side of the own range.
    """
    def made(which, parts, offset, own):
        sizes = np.array([len(p) for p in parts])
        stop = np.cumsum(sizes)
        return (np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.array(which), sizes), np.repeat(stop - sizes, sizes), np.repeat(stop, sizes), offset, own)

    which, parts, room = [], [], 0
    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            for s in range(0, len(text), BLOCK):
                e, left = min(len(text), s + BLOCK), max(0, s - margin)
                part = text[left:e + margin]
                yield made([i], [part], left, (s - left, e - left))
        elif text:
            if room + len(text) > BLOCK:
                yield made(which, parts, 0, (0, room))
                which, parts, room = [], [], 0
            which.append(i)
            parts.append(text)
            room += len(text)
    if parts:
        yield made(which, parts, 0, (0, room))


_NAMES = ["core", "outer1", "outer2", "rk", "anchor", "low", "high", "open"]
_ITEM = "core long, outer1 long, outer2 long, rk long, anchor long, low int, high int, open boolean"


def _batch(found, keys: np.ndarray, which, begins, offset: int, is_open: np.ndarray) -> pa.RecordBatch:
    core, one, two, ok, x, low, high, row = found
    null = ~ok
    return pa.RecordBatch.from_arrays([
        pa.array(core.view(np.int64)), pa.array(one.view(np.int64), mask=null), pa.array(two.view(np.int64), mask=null),
        pa.array(keys[which[x]]), pa.array(x - begins[x] + offset), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(is_open[row])], names=_NAMES)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _first_digit(width: int, gram: int, node: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("rk").to_numpy()
            for buffer, which, begins, ends, offset, (s, e) in stretches(_texts(batch), 2 * width + node):
                if len(buffer) < width:
                    continue
                prints = Prints(buffer)
                a, w0, w1 = anchors(prints, ends, width, gram)
                own = (a >= s) & (a < e)
                a, w0, w1 = a[own], w0[own], w1[own]
                yield _batch(split(prints, begins, ends, a, a - w1, a - w0, width, node), keys, which, begins, offset, np.ones(len(a), bool))
    return run


def _marked(batch: pa.RecordBatch, width: int, node: int):
    """Buffers with the anchors asked for inside their own range: (prints, begins, ends, which, offset, a, low, high, open)."""
    asked = batch.column("asked").to_pylist()
    for buffer, which, begins, ends, offset, (s, e) in stretches(_texts(batch), 2 * width + node):
        rows = []
        for i in np.unique(which):
            at = int(np.argmax(which == i)) if len(buffer) else 0
            rows += [(q["anchor"] - offset + at, q["low"], q["high"], q["open"]) for q in asked[i] if s <= q["anchor"] - offset + at < e]
        if rows:
            a, low, high, is_open = (np.array(c) for c in zip(*sorted(rows)))
            yield Prints(buffer), begins, ends, which, offset, a, low, high, is_open


def _next_digit(width: int, node: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("rk").to_numpy()
            for prints, begins, ends, which, offset, a, low, high, is_open in _marked(batch, width, node):
                yield _batch(split(prints, begins, ends, a, low, high, width, node), keys, which, begins, offset, is_open)
    return run


def _last_digit(width: int):
    def run(batches):
        for batch in batches:
            keys = batch.column("rk").to_numpy()
            for prints, begins, _, which, offset, a, low, high, is_open in _marked(batch, width, 0):
                times = high - low + 1
                row = np.repeat(np.arange(len(a)), times)
                x = a[row] - (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + low[row])
                yield pa.RecordBatch.from_arrays([
                    pa.array(prints.of(0, x, x + width).view(np.int64)), pa.array(prints.of(1, x, x + width).view(np.int64)),
                    pa.array(keys[which[x]]), pa.array(x - begins[x] + offset), pa.array(is_open[row])], names=["k1", "k2", "rk", "start", "open"])
    return run


def narrow(items: DataFrame, purpose: str) -> tuple[DataFrame, DataFrame]:
    """One pass: (rk, anchor, low, high) of ranges whose windows are all repeated; and what the next pass must look at.

    The next pass gets the open items that share their core but not their outer, and, to compare them with, one item for
    each outer under those cores (equal outers have equal windows).
    """
    cores = items.groupBy("core").agg(F.count("*").alias("n"), F.max("open").alias("any")).filter("n > 1 and any").select("core")
    shared = settle(items.join(cores, "core", "left_semi"), f"{purpose}-shared")
    has = F.col("outer1").isNotNull()
    outers = shared.filter(has).groupBy("outer1", "outer2").count().filter("count > 1").withColumn("hit", F.lit(True)).drop("count")
    judged = settle(shared.filter(has).join(outers, ["outer1", "outer2"], "left").unionByName(
        shared.filter(~has).withColumn("hit", F.lit(None).cast("boolean"))).withColumn("hit", F.coalesce("hit", F.lit(False))), f"{purpose}-judged")
    resolved = judged.filter("open and hit").select("rk", "anchor", "low", "high")
    still = judged.filter("open and not hit")
    others = judged.filter("not open or hit").join(still.select("core").distinct(), "core", "left_semi")
    item = F.struct("rk", "anchor", "low", "high")
    one_each = others.filter(has).groupBy("core", "outer1", "outer2").agg(F.min(item).alias("item")).select("item.*")
    rest = others.filter(~has).select("rk", "anchor", "low", "high")
    following = still.select("rk", "anchor", "low", "high", F.lit(True).alias("open")).unionByName(
        one_each.unionByName(rest).withColumn("open", F.lit(False)))
    return resolved, following


def _asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with their list of items to look at (bounded by the text's length)."""
    lists = wanted.groupBy("rk").agg(F.collect_set(F.struct("anchor", "low", "high", "open")).alias("asked"))
    return texts.join(lists, "rk").select("rk", "text", "asked")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                    node: int = NODE, fine: int = FINE) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, in bytes) and ``kept`` (binary).

    Each byte under a window of ``width`` bytes that also starts anywhere else, in the same text or another, is removed; windows are
    judged on the input. A null text is empty; texts shorter than ``width`` stay whole; a row repeated in the table repeats
    all its windows. An empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).withColumn("rk", row_key(F.col("id"), F.col("text")))
    slim = texts.select("rk", "text").filter(F.octet_length("text") >= width)
    first = settle(slim.mapInArrow(_first_digit(width, gram, node), _ITEM), "windows-items")
    done1, next1 = narrow(first, "windows-1")
    second = settle(_asked(slim, next1).mapInArrow(_next_digit(width, fine), _ITEM), "windows-fine")
    done2, next2 = narrow(second, "windows-2")
    last = settle(_asked(slim, next2).mapInArrow(_last_digit(width), "k1 long, k2 long, rk long, start long, open boolean"), "windows-last")
    again = last.groupBy("k1", "k2").count().filter("count > 1").drop("count")
    done3 = last.filter("open").join(again, ["k1", "k2"], "left_semi").select("rk", "start", (F.col("start") + width).alias("end"))
    ranges = done1.unionByName(done2).select("rk", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + width).alias("end"))
    covers = ranges.unionByName(done3).groupBy("rk").agg(F.collect_set(F.struct("start", "end")).alias("covers"))
    joined = texts.join(settle(covers, "windows-covers"), "rk", "left").select("id", "text", "covers")
    out = T.StructType([
        docs.select(col(id_col).alias(id_col)).schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType())])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, covers in zip(_texts(batch), batch.column("covers").to_pylist()):
                runs = []
                for s, e in sorted((c["start"], c["end"]) for c in covers or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans.append([{"start": s, "end": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, out)
