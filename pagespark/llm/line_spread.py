"""Cross-site boilerplate: remove lines that spread over many sites.

Each line's hash gets a HyperLogLog sketch of the sites it occurs on; sketches are merged by aggregation
(partial sketches where lines are read, so a hot line costs one row per task). Lines whose estimate is clearly above
the threshold are boilerplate, clearly below are not; the lines in between are counted exactly. Only
hashes are shuffled for this; texts move once, to meet the marks of their document.

Copied documents are for the near-duplicate stage to decide: each distinct text speaks for one site, so copies of a text do not make its
lines spread, and every spread line goes from every document. That is the rule of the query and the pipeline (``copied_share=None``). With a share
sites are counted over all rows, and a document that consists mostly of spread lines is left whole, short pages with long boilerplate as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, row_key, settle

MIN_SITES = 10
SKETCH_BITS = 10
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """``lh`` of the lines on at least ``min_sites`` distinct sites, from rows (lh, site)."""
    sketched = settle(
        lines.groupBy("lh").agg(F.hll_sketch_agg("site", F.lit(sketch_bits)).alias("sketch"))
        .select("lh", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= F.lit(min_sites) / 2), "line-spread")
    margin = max(1.0, 5 * 1.04 / 2 ** (sketch_bits / 2) * min_sites)  # five standard errors, one site at least
    sure = sketched.filter(F.col("sites") > min_sites + margin).select("lh")
    near = sketched.filter(F.abs(F.col("sites") - F.lit(min_sites)) <= margin).select("lh")
    exact = lines.join(near, "lh", "left_semi").select("lh", "site").distinct().groupBy("lh").count().filter(
        F.col("count") >= min_sites).select("lh")
    return sure.unionByName(exact)


def _of_distinct_texts(keyed: DataFrame, hashes: Column) -> DataFrame:
    """(lh, site) of the lines of each distinct text, with its smallest site."""
    texts = keyed.groupBy(F.xxhash64("text").alias("th")).agg(F.min("site").alias("site"), F.first(F.array_distinct(hashes)).alias("lhs"))
    return settle(texts.select(F.explode("lhs").alias("lh"), "site"), "line-sites")


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                        min_sites: int = MIN_SITES, copied_share: float | None = 0.5, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and ``n_lines``, ``n_removed``.

    Lines end at newlines and are compared without blanks at their ends; empty lines are never removed. A null site is a site of
    its own. Spread lines go unless they hold more than ``copied_share`` of the characters in the document's
    lines; with None they always go, and sites are counted over distinct texts. A null text stays null with 0 lines; repeated rows are treated alike; an empty table gives no rows.
    """
    cleaned_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    keyed = docs.select(
        F.struct(*[col(c) for c in cleaned_columns]).alias("row"), col(text_col).alias("text"),
        F.coalesce(F.concat(F.lit("="), col(site_col).cast("string")), F.lit("")).alias("site"),
        row_key(col(id_col), col(site_col), col(text_col)).alias("rk"))
    hashes = F.transform(F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    lines = settle(keyed.select("rk", "site", F.explode(F.array_distinct(hashes)).alias("lh")), "line-hashes")
    counted = lines.select("lh", "site") if copied_share is not None else _of_distinct_texts(keyed, hashes)
    marks = lines.join(spread_lines(counted, min_sites, sketch_bits), "lh", "left_semi").groupBy("rk").agg(
        F.collect_set("lh").alias("marks"))  # the lines of one document
    joined = keyed.join(marks.withColumnRenamed("rk", "m_rk"), F.col("rk") == F.col("m_rk"), "left")
    parts = F.transform(_lines(F.col("text")), lambda x: F.struct(
        x.alias("line"), F.coalesce(F.array_contains("marks", F.xxhash64(_bare(x))), F.lit(False)).alias("out")))
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(_bare(x["line"])))
    marked = joined.select("row", "text", F.when(F.col("marks").isNotNull(), parts).alias("parts"))
    gone = marked.withColumn("gone", F.filter("parts", lambda x: x["out"]))
    few = F.col("parts").isNotNull() if copied_share is None else chars(F.col("gone")) <= chars(F.col("parts")) * F.lit(copied_share)
    decided = gone.withColumn("apply", F.coalesce(few, F.lit(False)))
    kept = F.array_join(F.transform(F.filter("parts", lambda x: ~x["out"]), lambda x: x["line"]), "\n")
    clean = F.when(F.col("apply"), kept).otherwise(F.col("text"))
    return decided.select(
        *[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in cleaned_columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.when(F.col("apply"), F.size("gone")).otherwise(F.lit(0)).cast("long").alias("n_removed"))
