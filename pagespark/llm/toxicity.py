"""Toxic passages as maximum-scoring segments of token log-odds.

Weights: the log-odds of a word between toxic and clean documents under a Dirichlet prior that follows the word's overall
frequency; words whose log-odds are not significant and large weigh nothing. Leading letters are counted like words, and judge
those that are too rare themselves. A token scores its weight minus a drift, so clean
text sinks. One linear scan per text finds all maximal scoring segments. Their scores follow an extreme-value law with a
rate (lambda) fixed by the clean documents' token scores; lambda times the segments' scores with the text's length gives
calibrated evidence, and a logistic curve fitted on documents that gave no weights turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, forget, packed, settle, unpacked

TRAIN_DOCS = 24_000
MAX_WORDS = 20_000
PRIOR_SHARE = 0.1  # weight of the prior, as a share of all counts
MIN_Z = 3.5
MIN_ODDS = 1.0  # a marker is at least e times as likely in toxic documents; topics and languages differ by less
STEMS = (5, 4)  # leading letters that stand for words too rare to judge
MEMO = 100_000
DRIFT = 0.5
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # word, or leading letters and "*" -> log-odds
    rate: float = 1.0  # lambda of the extreme-value law
    logit: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    base: float = 0.0


def segments(scored: Iterable[tuple[int, float]], length: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text of ``length`` tokens, in linear time.

    ``scored``: (position, weight) of the tokens that weigh anything; a token scores weight - drift.
    """
    # Candidates: [start, end, total before it, total at its end], with a link to the last earlier candidate that starts lower.
    found: list[list] = []
    total, at = 0.0, 0
    for place, weight in scored:
        total -= drift * (place - at)
        at = place + 1
        gain = weight - drift
        if gain <= 0:
            total += gain
            continue
        start, before, end, after = place, total, place + 1, total + gain
        total = after
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append([start, end, before, after, j])
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, b - a) for s, e, a, b, _ in found]


class Weigher(dict):
    """Weight (or None) by word, remembered; emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float | None:
        found = self.weights.get(word)
        for n in STEMS:
            if found is None and len(word) > n:
                found = self.weights.get(word[:n] + "*")
        if len(self) >= MEMO:
            self.clear()
        self[word] = found
        return found


def features(model: Model, weigh: Weigher, text: str | None) -> tuple[list[tuple[int, int, float]], list[float]]:
    words = TOKEN.findall(text.lower()) if text else []
    hits = [(i, w) for i, w in enumerate(map(weigh.__getitem__, words)) if w is not None]
    segs = segments(hits, len(words)) if hits else []
    best = max((s[2] for s in segs), default=0.0)
    spread = math.log1p(sum(math.expm1(min(40.0, model.rate * s[2])) for s in segs))
    return segs, [model.rate * best, spread, math.log1p(len(words))]


def chance(model: Model, x: list[float]) -> float:
    z = model.base + sum(a * b for a, b in zip(model.logit, x))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_docs: int = TRAIN_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Fit on about ``train_docs`` labelled documents, chosen by a hash of their ids (the bound on the sample).

    Two thirds give the weights, one third the calibration. Null ids, labels and texts are not used; of several labels of an id
    the largest counts. Without labels the model gives every text 0; with one class only, that class' smoothed share.
    """
    marks = labels.select(col(id_col).alias("l_id"), col(label_col).cast("int").alias("y")).filter("l_id is not null and y is not null").groupBy("l_id").agg(
        F.max("y").alias("y"))
    n = marks.count()
    if not n:
        return Model(base=-700.0)
    rate = min(1.0, train_docs / n)
    dice = lambda c: F.pmod(F.xxhash64(c, F.lit("toxic")), F.lit(3_000_000))
    texts = docs.select(col(id_col).alias("l_id"), col(text_col).alias("text")).filter(F.col("text").isNotNull() & (dice(F.col("l_id")) < rate * 3_000_000))
    sample = settle(texts.join(marks.filter(dice(F.col("l_id")) < rate * 3_000_000), "l_id").withColumn("part", F.pmod(dice(F.col("l_id")), F.lit(3))), "toxic-sample")

    once = sample.filter("part < 2").groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.first("text").alias("text"))  # a copied text counts once
    bag = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    stems = [F.transform(F.filter("bag", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    words = once.select("y", bag.alias("bag")).select("y", "bag", F.array_distinct(F.concat(*stems)).alias("stems"))
    listed = words.select("y", F.explode(F.concat("bag", "stems")).alias("w"))
    counts = settle(listed.groupBy("w").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") != 1, 1).otherwise(0)).alias("n0")), "toxic-words")
    sums = counts.filter(~F.endswith("w", F.lit("*"))).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0")).first()
    t1, t0 = sums["t1"] or 0, sums["t0"] or 0
    model = Model()
    if t1 and t0:
        strength = PRIOR_SHARE * (t1 + t0)
        prior = (F.col("n1") + F.col("n0")) / F.lit(t1 + t0) * strength
        p1, p0 = F.col("n1") + prior, F.col("n0") + prior
        odds = F.log(p1 / F.greatest(F.lit(t1 + strength) - p1, F.lit(1.0))) - F.log(p0 / F.greatest(F.lit(t0 + strength) - p0, F.lit(1.0)))
        rated = counts.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / p1 + 1 / p0)).filter((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS))
        kept = rated.orderBy(F.abs("z").desc(), "w").limit(max_words).collect()  # the model's bounded vocabulary
        model.weights = {r["w"]: r["odds"] for r in kept}
        model.rate = extreme_rate([(r["odds"] - DRIFT, r["n0"] / t0) for r in kept if not r["w"].endswith("*")])

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        forget()
        m = shared.value
        for batch in batches:
            weigh = Weigher(m.weights)
            x = [features(m, weigh, t)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "x": pa.array(x, pa.list_(pa.float64()))})

    points = sample.filter("part = 2").select("y", "text").mapInArrow(measure, "y int, x array<double>").toPandas()  # a third of the bounded sample
    y = (points["y"].to_numpy() == 1).astype(float)
    if len(y) == 0 or y.min() == y.max():
        ones = marks.filter("y = 1").count()
        share = (ones + 1) / (n + 2)
        return Model(model.weights, model.rate, (0.0, 0.0, 0.0), math.log(share / (1 - share)))
    weights, base = logistic(np.stack(points["x"].to_list()), y)
    return Model(model.weights, model.rate, weights, base)


def extreme_rate(steps: list[tuple[float, float]]) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over clean tokens; 1 where clean text never gains."""
    rest = 1 - sum(p for _, p in steps)
    value = lambda r: sum(p * math.exp(min(700.0, r * s)) for s, p in steps) + rest * math.exp(-r * DRIFT) - 1
    low, high = 1e-3, 1e-3
    while value(high) < 0 and high < 4:
        high *= 2
    if value(low) >= 0 or value(high) < 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Weights and intercept on the raw features, by Newton's method."""
    mean, width = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / width, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
    slope = w[:-1] / width
    return tuple(float(s) for s in slope), float(w[-1] - slope @ mean)


PASSAGES = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns with ``score`` (0 to 1), ``predicted`` (1 from 0.5) and ``passages``: every maximal segment, in words, with its p-value.

    Only the text is looked at; a null text scores as the empty one. Rows are independent; an empty table gives no rows.
    """
    df = packed(docs)  # the text travels once, inside the row
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches):
        forget()
        m = shared.value
        weigh = Weigher(m.weights)
        for batch in batches:
            probs, passages = [], []
            for value in batch.column("row").field(place):
                segs, x = features(m, weigh, value.as_py())
                n = math.expm1(x[2])
                probs.append(chance(m, x))
                passages.append([{"start": s, "end": e, "score": v, "p_value": -math.expm1(-n * math.exp(-m.rate * v))} for s, e, v in segs])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(probs, pa.float64()), pa.array([int(p >= 0.5) for p in probs], pa.int32()), pa.array(passages, kind)],
                names=["row", "score", "predicted", "passages"])

    out = T.StructType([df.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("passages", PASSAGES)])
    return unpacked(df.mapInArrow(run, out), docs.columns, ["score", "predicted", "passages"])
