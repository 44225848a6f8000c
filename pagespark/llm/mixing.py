"""Mix sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: every source's share of all words by weight, filled up to ``max_epochs`` times its size
(water filling, in closed form over the table of sources). Schedule: slot n is the golden-ratio point
frac((n + 1/2) * phi) on the line of cumulative targets, so every stretch of slots is close to the weights. Slots
are ranked per source; a source's shuffled documents are cut into blocks of (nearly) one slot's words;
rank k takes block k mod blocks, and the last slot is cut at the target. Documents meet slots in a join on
(source, block).

Nothing is ranked in one task: ranks and offsets are prefix sums over (source, chunk) totals plus a
window inside a chunk, so one source may hold any share of the rows. The table of sources (one small
row each) is the only thing that passes through a single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, settle, word_count

PHI = 0.6180339887498949
SLOTS_PER_CHUNK = 8192
BLOCK_WORDS = 1024


@dataclass(frozen=True)
class Mix:
    """``documents``: a row per input row with src, doc_id, size, ord, off, source_size, target, taken.
    ``schedule``: slot, src, rank, block, words, in the order of training."""

    documents: DataFrame
    schedule: DataFrame


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(src, source_size) -> with weight, target and the target's place lo..hi on the cumulative line.

    Sources are ordered by code point (``src``), the null source (empty ``src``) last; weights repeat.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy((F.col("src") == "").cast("int"), "src")))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1))
    cap = F.col("source_size") * max_epochs
    before = Window.orderBy(cap / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighted.withColumn("level", left / heavy)
    filled = level.withColumn("target", F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight")))
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return filled.withColumn("hi", F.sum("target").over(upto)).select(
        "src", "place", "source_size", "weight", "target", (F.col("hi") - F.col("target")).alias("lo"), "hi")


def ranked_slots(spark, sources: DataFrame, total: int, block_words: int) -> DataFrame:
    """slot, src, rank (from 0 per source)."""
    n_slots = max(1, -(-total // block_words)) if total else 0
    n_sources = sources.count()
    cells = max(1024, 4 * n_sources)
    line = sources.agg(F.max("hi")).first()[0] or 0.0
    cell_of = lambda x: F.least(F.floor(x / F.lit(line or 1.0) * F.lit(cells)), F.lit(cells - 1)).cast("long")
    grid = sources.filter("target > 0").select("src", "lo", "hi", F.explode(F.sequence(cell_of(F.col("lo")), cell_of(F.col("hi")))).alias("cell"))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), (F.pmod((F.col("id") + F.lit(0.5)) * F.lit(PHI), F.lit(1.0)) * F.lit(line)).alias("x"))
    placed = points.withColumn("cell", cell_of(F.col("x"))).join(grid, "cell").filter("x >= lo and x < hi").select("slot", "src")
    chunked = placed.withColumn("chunk", F.floor(F.col("slot") / F.lit(SLOTS_PER_CHUNK)))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy("src", "chunk").count().select("src", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    return chunked.join(starts, ["src", "chunk"]).select(
        "slot", "src", (F.col("start") + F.row_number().over(inside) - 1).alias("rank"))


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, block_words: int = BLOCK_WORDS, seed: str = "mix") -> Mix:
    """Plan the mix of all rows.

    A null or empty text has size 0 and nothing is taken of it; a null source is a source of its own, ordered last. The
    shuffle is the order of md5(seed, id), so reruns agree; rows that tie in (id, size) are
    interchangeable. No row is taken more than ``max_epochs`` times. Empty tables give empty results; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = settle(docs.select(
        col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("")).alias("src"),
        word_count(col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(id_col).cast("string"), F.lit("")))).alias("ord"),
    ), "mix-rows")
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    sources = settle(targets(sizes, weights, max_epochs), "mix-sources")
    total = rows.agg(F.sum("size")).first()[0] or 0

    slots = ranked_slots(spark, sources, total, block_words)
    per_source = settle(
        sources.join(slots.groupBy("src").agg(F.count("*").alias("slots")), "src", "left")
        .withColumn("slots", F.coalesce(F.col("slots"), F.when(F.col("target") >= 1, F.lit(1)).otherwise(F.lit(0))))
        .withColumn("blocks", F.greatest(F.lit(1), F.floor(F.col("slots") * F.col("source_size") / F.greatest(F.col("target"), F.lit(1e-9)))).cast("long"))
        .withColumn("words_due", F.floor("target")), "mix-plan")

    # A source too small for a slot of its own on the line still gets one, after the others.
    unplaced = per_source.join(slots.select("src").distinct(), "src", "left_anti").filter("slots > 0").select(
        F.lit(total // block_words + 1).alias("slot"), "src", F.lit(0).cast("long").alias("rank"))
    start = lambda j: F.expr(f"(({j}) * source_size) div blocks")
    schedule = (
        slots.unionByName(unplaced).join(per_source.select("src", "source_size", "blocks", "words_due"), "src")
        .withColumn("block", F.expr("rank % blocks"))
        .withColumn("done", F.expr("(rank div blocks) * source_size") + start("block"))
        .withColumn("words", _clamp(F.col("words_due") - F.col("done"), F.lit(0), start("block + 1") - start("block")))
        .select("slot", "src", "rank", "block", "words")
    )

    chunked = rows.withColumn("chunk", F.substring("ord", 1, 3))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunked.groupBy("src", "chunk").agg(F.sum("size").alias("part")).select(
        "src", "chunk", F.coalesce(F.sum("part").over(earlier), F.lit(0)).alias("start"))
    upto = Window.partitionBy("src", "chunk").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        chunked.join(starts, ["src", "chunk"])
        .withColumn("off", F.col("start") + F.sum("size").over(upto) - F.col("size"))
        .join(per_source.select("src", "source_size", "target", "blocks"), "src")
        .select("doc_id", "src", "size", "ord", "off", "source_size", "target", "blocks")
    )
    # Block j starts at (j * source_size) div blocks; the first and last block of a document can be one off that.
    block_of = lambda w: f"(({w}) * blocks) div greatest(source_size, 1)"
    pieces = (
        placed.filter("size > 0")
        .select("*", F.explode(F.expr(f"sequence({block_of('off')}, least(blocks - 1, {block_of('off + size - 1')} + 1))")).alias("block"))
        .withColumn("from", F.greatest(F.col("off"), start("block")) - start("block"))
        .withColumn("upto", F.least(F.col("off") + F.col("size"), start("block + 1")) - start("block"))
        .filter("upto > from")
        .select("doc_id", "src", "off", "block", "from", "upto")
    )
    used = pieces.join(schedule.select("src", "block", "words"), ["src", "block"]).groupBy("doc_id", "src", "off").agg(
        F.sum(_clamp(F.col("words") - F.col("from"), F.lit(0), F.col("upto") - F.col("from"))).alias("used"))
    used = used.select(F.col("doc_id").alias("u_id"), F.col("src").alias("u_src"), F.col("off").alias("u_off"), "used")
    same = F.col("doc_id").eqNullSafe(F.col("u_id")) & (F.col("src") == F.col("u_src")) & (F.col("off") == F.col("u_off")) & (F.col("size") > 0)
    documents = placed.join(used, same, "left").select(
        "doc_id", "src", "size", "ord", "off", "source_size", "target", F.coalesce(F.col("used"), F.lit(0)).cast("long").alias("taken"))
    return Mix(documents, schedule)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space before it as it is."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, 1, n), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars",
                    **options) -> DataFrame:
    """The words of the mix as documents: a row is repeated for every whole time that it is taken, and a rest of words follows as
    the row with its text cut behind them (and ``length_col`` renewed, where there is one). So each source gives exactly the words the
    mix takes of it, and no source of which it takes a word leaves.

    Same columns as ``docs``. Empty and null texts, of which a mix takes nothing, stay out. Rows that repeat an id, source and size are taken
    alike, each by an equal share of their words, rounded down. Empty tables give empty results.
    """
    plan = mix(docs, id_col, text_col, source_col, **options).documents
    share = plan.groupBy(F.col("doc_id").alias("m_id"), F.col("src").alias("m_src"), F.col("size").alias("m_size")).agg(
        F.expr("sum(taken) div count(*)").alias("m_words")).filter("m_words > 0")
    rows = docs.select(
        F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("p_id"),
        F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("")).alias("p_src"), word_count(col(text_col)).alias("p_size"))
    dealt = rows.join(share, F.col("p_id").eqNullSafe(F.col("m_id")) & (F.col("p_src") == F.col("m_src")) & (F.col("p_size") == F.col("m_size")))
    whole, rest = F.expr("cast(m_words div p_size as int)"), F.expr("cast(m_words % p_size as int)")
    pieces = dealt.select("row", whole.alias("whole"), rest.alias("rest")).select("row", F.explode(F.concat(
        F.array_repeat(F.lit(-1), F.col("whole")), F.when(F.col("rest") > 0, F.array("rest")).otherwise(F.array().cast("array<int>")))).alias("upto"))

    def value(name: str) -> Column:
        old = F.col("row").getField(name)
        text = first_words(F.col("row").getField(text_col).cast("string"), F.col("upto"))
        if name == text_col:
            return F.when(F.col("upto") >= 0, text).otherwise(old)
        if name == length_col:
            return F.when(F.col("upto") >= 0, F.length(text).cast(docs.schema[name].dataType)).otherwise(old)
        return old
    return pieces.select(*[value(c).alias(c) for c in docs.columns])
