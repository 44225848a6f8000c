"""Registered queries of the operators, each over its whole table, and their SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, language, licenses, line_spread, merkle, mixing, near_dedup, repair, toxicity, url_filter, windows
from .common import table
from .sql_twins import SQL

RANKS = "byte_bpe_multi_50k.tiktoken"


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_remainder(3) == 1, F.lit(False)))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeated(table(spark, sf_dir, "documents"), width=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("removed"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_spread.remove_spread_lines(docs, copied_share=None).select("doc_id", "n_lines", "n_removed", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_remainder(5) == 0, F.lit(False)))
    model = toxicity.train(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels").filter(_remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents"), words=3, threshold=0.85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    again = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), merkle.tampered(F.col("doc_id"), F.col("text"))])
    rows = merkle.manifest(docs, keep=["doc_id"], seen=again)
    folded = merkle.fold(F.col("seen"), F.col("steps"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels(base).alias("base_labels"), licenses.labels(F.col("matches")).alias("labels"), licenses.score(F.col("matches")).alias("score"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(repair.damaged(talks), everyone=talks)
    return done.keys.join(done.conversations, "k").join(repair.transcript_digests(done), "k", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


JOBS = {f.__name__: f for f in (
    op1_byte_bpe, op2_exact_dedup, op3_language, op4_nearest_vectors, op5_url_filter, op6_repeated_windows, op7_line_spread, op8_toxicity,
    op9_near_dedup, op10_mixing, op11_merkle_manifest, op12_license_scan, op13_conversation_repair)}


def queries() -> dict:
    return dict(JOBS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
