"""Language ID by prediction by partial matching.

Every language has a context tree over bytes, up to three bytes deep, with counts from its training texts. A byte's code length is
found as in PPM (method C, with exclusion): from the longest context in the tree, escaping to shorter ones, down to a
uniform order -1. Training ends before scoring, so the statistics are frozen and every (context, byte) has one exact
code length; they are laid out in a table of (node, symbol, language), and a text's code length is a sum of looked-up rows. The
shortest code names the language; the score is the posterior of that language among the learned ones.

The trees share their set of contexts, the most frequent ones, so that the table has at most ``table_cells`` cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, packed, settle, unpacked

ORDER = 3
PAD = b"\n" * ORDER  # stands before every text
SLICE = 1 << 20
DOCS_PER_LANG = 2000
TABLE_CELLS = 6_000_000


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    node: np.ndarray  # last three symbols -> node of the longest known context
    size: int  # symbols
    bits: np.ndarray  # (node * symbols + symbol) -> code length per language


def _grams(buffer: bytes) -> np.ndarray:
    """Four consecutive bytes ending at each position, as one number."""
    b = np.frombuffer(buffer, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
          docs_per_lang: int = DOCS_PER_LANG, table_cells: int = TABLE_CELLS) -> Model | None:
    """Fit the trees. Rows with a null language or text are not used; None if nothing is left.

    About ``docs_per_lang`` documents of a language are read (all, if it has fewer), chosen by a hash of their ids: the bound on the
    sample. Their whole texts are counted.
    """
    rows = labelled.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).filter(
        "lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, docs_per_lang / r["count"]))).otherwise(rate)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1_000_003)) < rate * 1_000_003).select("lang", "text")

    def count(batches):
        for batch in batches:
            names, found = batch.column("lang").to_pylist(), {}
            for name, text in zip(names, batch.column("text").to_pylist()):
                found.setdefault(name, []).append(PAD + text.encode("utf-8"))
            for name, texts in found.items():
                grams, n = np.unique(np.concatenate([_grams(t) for t in texts]) if any(len(t) > 3 for t in texts) else np.zeros(0, np.uint32), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = settle(counted, "lang-grams").toPandas()  # distinct grams of the bounded sample
    return fit(langs, got["lang"].to_numpy(), got["gram"].to_numpy(np.int64), got["n"].to_numpy(np.int64), table_cells)


def fit(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, table_cells: int = TABLE_CELLS) -> Model:
    which = np.searchsorted(np.array(langs, dtype=object), lang) if len(lang) else np.zeros(0, np.int64)
    part = [gram >> s & 255 for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate([*part, np.frombuffer(PAD, np.uint8)]))
    size = min(len(seen) + 1, 256)  # one more symbol stands for each byte that was never seen
    symbol = np.full(256, size - 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    a, b, c, d = (symbol[p] for p in part)
    n_lang = len(langs)
    room = max(256, table_cells // (size * n_lang))

    def tree(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Known contexts (sorted keys) and their counts, (context, language, symbol)."""
        found, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=n, minlength=len(found))
        if len(found) > most:
            keep = np.sort(np.argsort(-total, kind="stable")[:most])
            place = np.full(len(found), -1)
            place[keep] = np.arange(most)
            found, inverse = found[keep], place[inverse]
        counts = np.zeros((len(found), n_lang, size), np.float32)
        ok = inverse >= 0
        np.add.at(counts, (inverse[ok], which[ok], d[ok]), n[ok])
        return found, counts

    keys = [np.zeros(len(gram), np.int64), c, b * size + c, (a * size + b) * size + c]
    trees = [tree(k, m) for k, m in zip(keys, (1, 256, max(1, room // 4), room))]
    if not len(gram):
        trees[0] = (np.zeros(1, np.int64), np.zeros((1, n_lang, size), np.float32))

    def place(order: int, wanted: np.ndarray) -> np.ndarray:
        known = trees[order][0]
        at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
        return np.where(known[at] == wanted, at, -1) if len(known) else np.full(len(wanted), -1)

    bits = []
    for order in range(ORDER + 1):
        context = trees[order][0]
        shape = (len(context), n_lang, size)
        chance, escape, shut = np.zeros(shape, np.float32), np.ones((*shape[:2], 1), np.float32), np.zeros(shape, bool)
        for shorter in range(order, -1, -1):
            at = place(shorter, context % size ** shorter)
            counts = np.where((at >= 0)[:, None, None], trees[shorter][1][np.maximum(at, 0)], 0)
            counts[shut] = 0
            kinds, total = (counts > 0).sum(2, keepdims=True), counts.sum(2, keepdims=True)
            both = np.maximum(kinds + total, 1)
            chance += escape * counts / both
            escape = np.where(kinds > 0, escape * kinds / both, escape)
            shut |= counts > 0
        left = 256 - shut.sum(2, keepdims=True)
        chance = np.where(shut, chance, escape / np.maximum(left, 1))
        bits.append(-np.log2(np.maximum(chance, 1e-30)).transpose(0, 2, 1).reshape(-1, n_lang).astype(np.float32))

    first = np.cumsum([0, *[len(t[0]) for t in trees]])
    every = np.arange(size ** ORDER)
    node = np.zeros(len(every), np.int32)
    for order in range(1, ORDER + 1):
        at = place(order, every % size ** order)
        node = np.where(at >= 0, at + first[order], node).astype(np.int32)
    return Model(langs, symbol.astype(np.int32), node, size, np.concatenate(bits))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits per text and language; long texts are taken in slices that keep their context."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        held = PAD
        for at in range(0, len(text), SLICE):
            pieces.append(held + text[at:at + SLICE])
            owner.append(i)
            held = pieces[-1][-ORDER:]
    out = np.zeros((len(texts), len(model.langs)))
    size = model.size
    start = 0
    while start < len(pieces):
        end, room = start, 0
        while end < len(pieces) and (end == start or room + len(pieces[end]) <= SLICE):
            room += len(pieces[end])
            end += 1
        lengths = np.array([len(p) for p in pieces[start:end]])
        s = model.symbol[np.frombuffer(b"".join(pieces[start:end]), np.uint8)]
        key = (s[:-3] * size + s[1:-2]) * size + s[2:-1]
        cell = model.node[key].astype(np.int64) * size + s[3:]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # Position p of ``cell`` is the byte at p + 3; those that would look across a piece's start are left out.
        inner = np.ones(len(cell), bool)
        for back in range(ORDER):
            at = begin[1:] - ORDER + back
            inner[at] = False
        cost = model.bits[cell[inner]]
        sums = np.add.reduceat(cost, np.concatenate([[0], np.cumsum(lengths - ORDER)[:-1]]), axis=0, dtype=np.float64)
        np.add.at(out, owner[start:end], sums)
        start = end
    return out


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; only the text is looked at.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the language that sorts first. The
    rows are independent; an empty table gives no rows.
    """
    text = col(text_col)
    if model is None:
        kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
        return docs.select(*[col(c) for c in kept], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    df = packed(docs, text=F.when(has_letter(text), text))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = [t.encode("utf-8") if t is not None else b"" for t in batch.column("text").to_pylist()]
            bits = code_lengths(m, texts)
            best = bits.argmin(1)
            score = 1 / np.exp2(np.maximum(bits[np.arange(len(texts)), best][:, None] - bits, -1000)).sum(1)
            name = [m.langs[k] if t else "und" for k, t in zip(best, texts)]
            score = np.where([bool(t) for t in texts], score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(name, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    out = T.StructType([df.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return unpacked(df.mapInArrow(run, out), docs.columns, ["lang_pred", "score"])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
