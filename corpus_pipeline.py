"""From raw documents to token ids: toxicity, line dedup, near-dedup, source mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.llm import bpe, line_spread, mixing, near_dedup, toxicity
from pagespark.llm.common import col, settle, small_batches, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def _carried(docs: DataFrame, *inputs: str) -> DataFrame:
    """The whole rows as one column beside the stage's inputs, so no other column can clash with a result."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_row"), *[col(c) for c in inputs])


def _restored(df: DataFrame, docs: DataFrame, **renewed: Column) -> DataFrame:
    return df.select(*[renewed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, trained on the labels of the documents at hand.

    Null and empty texts are scored like any other and repeated rows alike; without labels nothing is rejected; other columns are kept as they are.
    """
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _restored(toxicity.score(_carried(docs, "text"), model).filter("predicted = 0"), docs)


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sites; all documents stay. Copied texts count once, so none is exempt.

    Null and empty texts stay what they are; repeated rows lose the same lines; n_chars is the new length.
    """
    cleaned = line_spread.remove_spread_lines(_carried(docs, "doc_id", "text", "source"), copied_share=None)
    return _restored(cleaned, docs, text=F.col("text"), n_chars=F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (of smallest id) of each group of near-duplicates: five-word shingles, similarity 0.8.

    Null, empty and blank texts are like no other and stay. Rows that repeat an id share its fate.
    """
    small_batches(spark)
    kept = near_dedup.link(docs, words=5, threshold=0.8).filter("kept").select("doc_id").distinct()
    # Ids are hashed, so the texts that meet them need no sorting and are never held.
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix: documents taken more than once are repeated, and one that is taken in part ends at its last word taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, decoded again to prove the round trip. Null texts have no ids; repeated rows are encoded alike."""
    small_batches(spark)
    ranks = bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source"], same_col="round_trip").select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # the stages hold trained models, sketches and a tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
