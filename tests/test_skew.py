"""Hot keys: the salted top-k and the chunked running values equal plain windows."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagespark.functions.patterns import BadPattern
from pagespark.functions.skew import Run, chunk_for, merged_runs, running, topk_per_key
from pagespark.operators import dom, logs
from pagespark.plans import feeds
from pagespark.streaming import logs as streams
from pagespark.streaming.runs import run_to_table


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"), rng.randrange(50_000), i, rng.choice([None, i % 7]))
            for i in range(6000)]
    return spark.createDataFrame(rows, "key string, ts_ms long, seq long, v int").cache()


def test_topk(skewed):
    got = topk_per_key(skewed, ["key"], [F.col("seq").desc()], 50, ["seq"], salts=8)
    w = Window.partitionBy("key").orderBy(F.col("seq").desc())
    want = skewed.withColumn("r", F.row_number().over(w)).filter("r <= 50").drop("r")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("chunk", [1, 700, 10_000_000])
def test_running(skewed, chunk):
    v = F.col("v")
    runs = [Run("s", "sum", v), Run("m", "max", v, False), Run("lo", "min", v), Run("l", "last", v, False), Run("n", "next", v, False)]
    got = running(skewed, ["key"], ["ts_ms", "seq"], runs, "ts_ms", chunk)
    w = Window.partitionBy("key").orderBy("ts_ms", "seq")
    upto, before, after = (w.rowsBetween(a, b) for a, b in (
        (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)))
    want = skewed.select("*", F.coalesce(F.sum(v).over(upto), F.lit(0)).alias("s"), F.max(v).over(before).alias("m"),
                         F.min(v).over(upto).alias("lo"), F.last(v, True).over(before).alias("l"), F.first(v, True).over(after).alias("n"))
    assert got.exceptAll(want).count() == 0


@pytest.mark.parametrize("chunk, gap", [(1, 0), (50, 0), (50, 7), (300, 40), (10_000, 3), (7, 100)])
def test_merged_runs(spark, chunk, gap):
    """Long intervals reach over many chunks; a hot key, negative times, ties and repeated rows."""
    rng = random.Random(chunk * 1000 + gap)
    rows = []
    for key, n, span in (("hot", 900, 20_000), ("a", 60, 3000), ("b", 2, 500), (None, 30, 900)):
        for _ in range(n):
            start = rng.randrange(-span // 2, span // 2)
            rows.append((key, start, start + rng.choice([0, 0, 3, 20, 90, 700 if rng.random() < 0.1 else 5])))
    rows += rows[:25]
    want = []
    for key in {r[0] for r in rows}:
        at = None
        for s, e in sorted(r[1:] for r in rows if r[0] == key):
            if at is None or s - at[1] > gap:
                at = [s, e, 0]
                want.append((key, at))
            at[1], at[2] = max(at[1], e), at[2] + 1
    df = spark.createDataFrame(rows, "key string, s long, e long")
    got = [tuple(r) for r in merged_runs(df, ["key"], "s", "e", gap, chunk).collect()]
    assert sorted(got, key=repr) == sorted([(k, *a) for k, a in want], key=repr)


def test_chunk_length(skewed):
    assert 1 <= chunk_for(skewed, ["key"], "ts_ms", 100) < 50_000


def test_ring_then_filter(spark):
    rows = [(i, i, "p", "t", "GET", f"u{i}", "xhr", 500 if i < 20 else 200, 1, None, None) for i in range(520)]
    log = spark.createDataFrame(rows, "seq long, ts_ms long, profile string, tab_id string, method string, url string, "
                                      "resource_type string, status int, duration_ms long, from_cache boolean, failed string")
    assert logs.net_query(log, min_status=400).count() == 0
    tail = logs.net_query(log, limit=3, method="get").orderBy("seq").collect()
    assert [r["seq"] for r in tail] == [517, 518, 519] and tail[0]["total"] == 500
    with pytest.raises(BadPattern):
        logs.net_query(log, url_regex="(")


def test_settle_against_walk(spark):
    rng = random.Random(5)
    rows = []
    for load in range(300):
        rows.append((f"l{load}", 0, None, None, -1))
        for i in range(rng.randrange(9)):
            rows.append((f"l{load}", 0, rng.choice([0, 100, 400, 499, 500, 501, 900, 1400, 2600, 3000, 3300]), rng.choice([1, -1]), i))
    df = spark.createDataFrame(rows, "load_id string, t0_ms long, ts_ms long, delta int, seq long")
    got = {r["load_id"]: r["settled_ms"] for r in logs.settle_time(df).collect()}
    pdf = pd.DataFrame(rows, columns=["load_id", "t0", "ts", "delta", "seq"]).dropna()
    for load in {r[0] for r in rows}:
        mine = pdf[(pdf.load_id == load) & (pdf.ts <= 3000)]
        want = streams._settled(0, zip(mine.ts, mine.seq, mine.delta), 500, 3000)
        assert got[load] == want, load


def test_many_copies_of_one_page(spark):
    html = "<p>same</p>"
    rows = [(i, "u", html if i % 3 else f"<p>own {i}</p>") for i in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    once = dom.build_dom(pages, dedupe=True, copies_per_task=7).select("page_id", "nodes.text", "url")
    plain = dom.build_dom(pages).select("page_id", "nodes.text", "url")
    assert once.exceptAll(plain).count() == 0 and once.count() == 90


def test_stream_in_many_batches(spark, tmp_path):
    log = spark.createDataFrame([("p" if i % 3 else "q", i, i) for i in range(120)], "profile string, ts_ms long, seq long")
    for i in range(4):
        log.filter(f"seq % 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = streams.stream_ring(stream, 10).select("profile", "seq", "total")
    ring = logs.ring(log, 10).select("profile", "seq", "total")
    assert kept.exceptAll(ring).count() == 0 and kept.count() == 20


def test_stream_unmatched_ends(spark, tmp_path):
    def at(df):
        return df.withColumn("at", F.timestamp_millis("ts_ms"))

    starts = spark.createDataFrame([(1, 1000), (2, 2000)], "req_id long, ts_ms long")
    ends = spark.createDataFrame(
        [(1, 1500, -1.0, "p", "t"), (3, 2500, -1.0, "p", "t"), (9, 9_000_000, 3.6, "p", "t"), (8, 90_000_000, 1.0, "p", "t")],
        "req_id long, ts_ms long, timing_ms double, profile string, tab_id string")
    late_start = spark.createDataFrame([(7, 90_000_000)], "req_id long, ts_ms long")
    starts.unionByName(late_start).write.parquet(str(tmp_path / "s"))
    ends.write.parquet(str(tmp_path / "e"))
    pairs = streams.stream_pairs(
        at(spark.readStream.schema(starts.schema).parquet(str(tmp_path / "s"))),
        at(spark.readStream.schema(ends.schema).parquet(str(tmp_path / "e"))))
    got = {r["req_id"]: (r["ts_ms"], r["duration_ms"]) for r in run_to_table(pairs, "pairs").collect()}
    assert got[1] == (1000, 500) and got[3] == (2500, None) and got[9] == (9_000_000, 4)


def test_calls_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    events = spark.range(6_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.5).alias("value"), F.concat(F.lit('{"k":'), F.col("id") % 100, F.lit("}")).alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(feeds, "CALLS_PER_TASK", 100, raising=False)
    dealt = feeds.tool_calls(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in dealt) == 6_000 and max(r["count"] for r in dealt) <= 150
