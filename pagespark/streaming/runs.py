"""Running a stream over what is available and reading the result back.

A run lives in a folder, its home: checkpoint and results. Give the same home again and the run goes on where it ended; without
one, a fresh folder below the session's shared checkpoint folder is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

POLL_S = 0.5


@dataclass(frozen=True)
class Run:
    """``late``: rows that this run dropped because they came behind the watermark; ``batches``: micro-batches with input."""

    home: str
    late: int
    batches: int

    @property
    def checkpoint(self) -> str:
        return f"{self.home}/checkpoint"

    @property
    def table(self) -> str:
        return f"{self.home}/table"


def _finish(query, home: str) -> Run:
    """Wait for the end; progress is gathered on the way, since a query remembers its newest reports only."""
    late, fed = {}, set()

    def note() -> None:
        for p in query.recentProgress:
            late[p["batchId"]] = sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])
            if p["numInputRows"]:
                fed.add(p["batchId"])

    while not query.awaitTermination(POLL_S):
        note()
    note()
    return Run(home, sum(late.values()), len(fed))


def run(stream: DataFrame, name: str, home: str | None = None) -> Run:
    """Append a stream to the parquet table of its home until its input is used up."""
    home = home or shared_dir(stream.sparkSession, name)
    done = Run(home, 0, 0)
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", done.checkpoint).start(done.table)
    )
    return _finish(query, home)


def run_to_table(stream: DataFrame, name: str, home: str | None = None) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(run(stream, name, home).table)


def fold_batches(
    stream: DataFrame, name: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], home: str | None = None
) -> DataFrame:
    """Keep a state table: each micro-batch is merged into the previous version.

    Versions are written as ``v=<batch>`` folders. A replayed batch starts from the version
    before it and overwrites its own, so lost executors or a restart cannot count a batch twice; versions that no replay can
    need are deleted.
    """
    spark = stream.sparkSession
    home = home or shared_dir(spark, name)

    def version(i: int) -> str:
        return f"{home}/v={i}"

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        old = session.read.parquet(version(batch_id - 1)) if batch_id > 0 else None
        merge(old, batch).write.mode("overwrite").parquet(version(batch_id))
        if batch_id > 1:
            _path(session, version(batch_id - 2))[1].delete(_path(session, version(batch_id - 2))[0], True)

    query = (
        stream.writeStream.foreachBatch(step).trigger(availableNow=True)
        .option("checkpointLocation", f"{home}/checkpoint").start()
    )
    _finish(query, home)
    return spark.read.parquet(version(_newest(spark, home)))


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, home: str) -> int:
    """The last version whose writing was finished."""
    path, files = _path(spark, home)
    versions = [int(s.getPath().getName()[2:]) for s in files.listStatus(path) if s.getPath().getName().startswith("v=")]
    done = [v for v in versions if files.exists(_path(spark, f"{home}/v={v}/_SUCCESS")[0])]
    if not done:
        raise RuntimeError("the stream had no input")
    return max(done)
