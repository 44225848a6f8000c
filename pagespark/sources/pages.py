"""Page table source, HTML sink and file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .page_files import page_path, write_pages, written_pages

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def spread(scan: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Give a scan with fewer splits than cores to all cores.

    Work per row is heavy here (parsing, rules), and a small table may be one split. A table
    with enough splits, as any large one has, is left alone and not shuffled. Splits say nothing of rows, though: a row group lies in one
    of them whole, however long it is. With ``rows_per_task`` the rows are dealt evenly to as many tasks as that takes (they are counted first, from file footers).
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if rows_per_task:
        return scan.repartition(max(cores, -(-scan.count() // rows_per_task)))
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_pages_table(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``page_id, url, html`` of a parquet page table (declared schema, batch or stream)."""
    if streaming:
        return spark.readStream.schema(PAGES).parquet(path)
    return spread(spark.read.schema(PAGES).parquet(path))


def save_html(pages: DataFrame, out: str) -> DataFrame:
    """Write each page's HTML to a file of its own below ``out`` and return the manifest: page_id, path, bytes.

    Nothing can be seen before all pages are written (``page_files``). Sizes are those of the files that were written.
    """
    write_pages(pages, out)
    saved = written_pages(pages.sparkSession, out)
    empty = F.length(F.coalesce("html", F.lit(""))) == 0  # Spark does not list empty files
    return pages.select("page_id", page_path().alias("path"), F.when(empty, 0).alias("none")).join(saved, "path", "left").select(
        "page_id", F.concat(F.lit(out.rstrip("/") + "/"), F.col("path")).alias("path"), F.coalesce("bytes", "none").cast("long").alias("bytes"))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Regular files below a folder (names and sizes only; content is pruned)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"),
        F.lit(True).alias("is_file"),
        F.col("length").alias("bytes"),
    )
