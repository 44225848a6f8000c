"""Nearest vectors by inner product through randomly rotated one-bit codes.

Vectors are taken relative to a centre, normalised and rotated by a fixed random orthogonal matrix; the code is one sign bit per
coordinate, packed, with three correction scalars (length, code's own inner product with the vector, inner product with the
centre). Packed bits and scalars give an unbiased estimate of any inner product and a bound on its error. Queries meet all
codes in blocks; the best estimates are computed exactly, and then every vector whose upper bound reaches the k-th
exact value is reranked on the original numbers, in double precision.

Equal vectors are indexed once (a class); a class can put at most k + 1 rows into any result, its smallest ids, so nothing
grows with the number of copies.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.skew import topk_per_key

from .common import col, settle

FIT_ROWS = 10_000  # sample for the centre
CODE_ROWS = 16_384
QUERY_ROWS = 512
SIGMAS = 3.0  # width of the error bound
SEED = 20


def taking_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, alignment, inner product with the centre) of each row."""
    rest = (x - centre) @ turn.T
    length = np.sqrt((rest * rest).sum(1))
    align = np.abs(rest).sum(1) / (np.maximum(length, 1e-300) * math.sqrt(x.shape[1]))
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, align, 1.0), x @ centre


def search_block(q: np.ndarray, x: np.ndarray, packed: np.ndarray, length, align, with_centre, centre, turn, k: int, sigmas: float = SIGMAS):
    """(query row, vector row, exact inner product) of each query's ``k`` best in the block, ties kept by the caller's order."""
    dim = q.shape[1]
    sign = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (q - centre) @ turn.T
    scale = (length / (align * math.sqrt(dim))).astype(np.float32)
    guess = (turned.astype(np.float32) @ sign.T) * scale + with_centre.astype(np.float32) + (q @ centre - centre @ centre).astype(np.float32)[:, None]
    miss = length * np.sqrt(np.maximum(0, 1 - align ** 2)) / align * sigmas / math.sqrt(max(1, dim - 1))
    reach = np.sqrt((turned * turned).sum(1))
    out = []
    few = min(len(x), 2 * k)
    for i in range(len(q)):
        upper = guess[i] + reach[i] * miss
        best = np.argpartition(-guess[i], few - 1)[:few]
        exact = np.sort((x[best] * q[i]).sum(1))
        floor = exact[-k] if few >= k else -np.inf
        rows = np.flatnonzero(upper >= floor - 1e-5 * (1 + abs(floor))) if np.isfinite(floor) else np.arange(len(x))
        rows = np.union1d(rows, best)
        value = (x[rows] * q[i]).sum(1)
        if len(rows) > k:
            keep = value >= np.partition(value, -k)[-k]
            rows, value = rows[keep], value[keep]
        out.append((np.full(len(rows), i), rows, value))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` rows of largest inner product, itself left out.

    ``is_query`` is a condition on the columns of ``vectors``. Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id or of another length than most. Ties go to the smaller id; rows that repeat an id and its
    vector are one row. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(
        F.col("id").isNotNull() & taking_part(F.col("v")))
    sizes = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    valid = valid.filter(F.size("v") == dim).withColumn("cid", F.xxhash64("v"))
    rows = settle(valid.groupBy("id", "cid").agg(F.max("asks").alias("asks")), "ann-rows")
    classes = settle(valid.groupBy("cid", "v").agg(F.min("id").alias("first_id"), F.max("asks").alias("asks")), "ann-classes")
    total = classes.count()
    asking = classes.filter("asks").count()
    rate = min(1.0, FIT_ROWS / max(1, total))
    sample = classes.filter(F.pmod(F.xxhash64("cid", F.lit(SEED)), F.lit(1_000_000)) < rate * 1_000_000).select("v").toPandas()  # FIT_ROWS or so
    centre = np.stack(sample["v"].to_list()).mean(0) if len(sample) else np.zeros(dim)
    fit = spark.sparkContext.broadcast((centre, rotation(dim)))

    def encode(batches):
        middle, turn = fit.value
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy().reshape(-1, dim)
                bits, length, align, near = codes(x, middle, turn)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cid"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(length), pa.array(align), pa.array(near)],
                    names=["cid", "x", "bits", "length", "align", "near"])

    index = settle(classes.select("cid", "v").mapInArrow(encode, "cid long, x binary, bits binary, length double, align double, near double"), "ann-index")
    n_codes, n_queries = max(1, -(-total // CODE_ROWS)), max(1, -(-asking // QUERY_ROWS))
    place = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q_side = classes.filter("asks").select("cid").join(index.select("cid", "x"), "cid").select(
        F.col("cid").alias("q_cid"), F.col("x").alias("qx"), place(n_queries, 1).alias("qb")).withColumn("cb", every(n_codes))
    c_side = index.withColumn("cb", place(n_codes, 2)).withColumn("qb", every(n_queries))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q_cid": np.zeros(0, np.int64), "cid": np.zeros(0, np.int64), "score": np.zeros(0)})
        middle, turn = fit.value
        as_rows = lambda s, kind: np.frombuffer(b"".join(s), kind).reshape(len(s), -1)
        q, x = as_rows(left["qx"], np.float64), as_rows(right["x"], np.float64)
        i, j, score = search_block(q, x, as_rows(right["bits"], np.uint8), right["length"].to_numpy(), right["align"].to_numpy(), right["near"].to_numpy(), middle, turn, k + 1)
        return pd.DataFrame({"q_cid": left["q_cid"].to_numpy()[i], "cid": right["cid"].to_numpy()[j], "score": score})

    found = q_side.groupBy("qb", "cb").cogroup(c_side.groupBy("qb", "cb")).applyInPandas(search, "q_cid long, cid long, score double")
    firsts = classes.select("cid", "first_id")
    top = topk_per_key(found.join(firsts, "cid"), ["q_cid"], [F.desc("score"), F.asc("first_id"), F.asc("cid")], k + 1, ["cid"], salts=4)
    members = topk_per_key(rows.select("id", "cid"), ["cid"], [F.asc("id")], k + 1, ["id"])
    listed = settle(topk_per_key(
        top.select("q_cid", "cid", "score").join(members, "cid"), ["q_cid"], [F.desc("score"), F.asc("id")], k + 1, ["id"], salts=4).select("q_cid", "id", "score"), "ann-lists")
    answers = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("cid").alias("q_cid")).join(listed, "q_cid").filter("id <> query_id")
    ranked = topk_per_key(answers, ["query_id", "q_cid"], [F.desc("score"), F.asc("id")], k, ["id"], salts=1, rank_col="rank")
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
