"""Streams over several micro-batches and a restart give the rows of the batch operators."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagespark.operators import logs, state, tabs
from pagespark.streaming import logs as streams
from pagespark.streaming.keyed import entries_of
from pagespark.streaming.runs import run, run_to_table


class Feed:
    """A folder that is fed file by file and read one file a micro-batch."""

    def __init__(self, spark, df, home, order):
        self.spark, self.df, self.path, self.order = spark, df, f"{home}/in", order
        self.n = df.count()

    def add(self, first, last, files):
        """Rows [first, last) of the order, as so many files."""
        rows = self.df.orderBy(*self.order).collect()[first:last]
        step = -(-len(rows) // files)
        for i in range(0, len(rows), step):
            self.spark.createDataFrame(rows[i:i + step], self.df.schema).coalesce(1).write.mode("append").parquet(self.path)
            time.sleep(0.02)  # files are taken by their time

    @property
    def stream(self):
        return self.spark.readStream.schema(self.df.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def same(a, b):
    return sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


@pytest.fixture(scope="module")
def loads(spark):
    """Overlapping page loads; many have events long after their cap, and some have nothing else."""
    rng = random.Random(11)
    rows, seq = [], 0
    for load in range(60):
        t0 = load * 700
        for off in sorted(rng.choice([0, 10, 480, 500, 700, 1300, 2600, 2990, 3000, 3300, 5000, 9000]) for _ in range(rng.randrange(1, 9))):
            rows.append((f"l{load}", t0, t0 + off, rng.choice([1, -1, -1]), seq, rng.randrange(10)))
            seq += 1
    rows.append(("end", 10**9, 10**9, 1, seq, 0))  # moves the watermark past every load
    return spark.createDataFrame(rows, "load_id string, t0_ms long, ts_ms long, delta int, seq long, v int").withColumn("at", F.timestamp_millis("ts_ms"))


def test_settle_once_over_batches_and_a_restart(spark, loads, tmp_path):
    feed = Feed(spark, loads, tmp_path, ["ts_ms", "seq"])
    feed.add(0, feed.n // 2, 3)
    first = run(streams.stream_settle(feed.stream, delay="1 second"), "s", f"{tmp_path}/home")
    early = spark.read.parquet(first.table).count()
    feed.add(feed.n // 2, feed.n, 3)
    second = run(streams.stream_settle(feed.stream, delay="1 second"), "s", f"{tmp_path}/home")
    assert first.batches == 3 and second.batches == 3 and first.late == second.late == 0
    got = spark.read.parquet(second.table).filter("load_id <> 'end'").collect()
    want = logs.settle_time(loads.filter("load_id <> 'end'").drop("at", "v").unionByName(
        loads.filter("load_id <> 'end'").select("load_id", "t0_ms", F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("int").alias("delta"),
                                               F.lit(-1).cast("long").alias("seq")).distinct())).select("load_id", "t0_ms", "settled_ms").collect()
    assert 0 < early < len(want) and same(got, want)


def test_settle_ignores_what_follows(spark, tmp_path):
    rows = [("a", 0, 0, 1, 0), ("a", 0, 400, -1, 1), ("b", 50_000, 50_000, 1, 2), ("a", 0, 60_000, -1, 3), ("b", 50_000, 90_000, -1, 4), ("a", 0, 95_000, 1, 5), ("z", 10**8, 10**8, 1, 6)]
    df = spark.createDataFrame(rows, "load_id string, t0_ms long, ts_ms long, delta int, seq long").withColumn("at", F.timestamp_millis("ts_ms"))
    feed = Feed(spark, df, tmp_path, ["seq"])
    feed.add(0, len(rows), len(rows))
    got = run_to_table(streams.stream_settle(feed.stream, delay="1 second"), "s", f"{tmp_path}/home").filter("load_id <> 'z'").collect()
    assert same(got, [("a", 0, 900), ("b", 50_000, 53_000)])


def test_wait_over_batches_and_a_restart(spark, loads, tmp_path):
    versions = loads.select(F.col("load_id").alias("key"), "at", "t0_ms", "ts_ms", "seq", "v")
    feed = Feed(spark, versions, tmp_path, ["ts_ms", "seq"])
    wait = lambda: streams.stream_wait(feed.stream, F.expr("v > 6"), 3000, delay="1 second")
    feed.add(0, feed.n // 3, 2)
    run(wait(), "w", f"{tmp_path}/home")
    feed.add(feed.n // 3, feed.n, 4)
    got = run_to_table(wait(), "w", f"{tmp_path}/home").filter("key <> 'end'").collect()
    want = tabs.first_satisfied(versions.filter("key <> 'end'"), F.expr("v > 6"), 3000).collect()
    assert same(got, want) and {r["met"] for r in want} == {True, False}


def test_wait_takes_the_earliest_of_unordered_rows(spark, tmp_path):
    rows = [("k", 0, 900, 0, 9), ("k", 0, 300, 1, 9), ("k", 0, 200, 2, None), ("k", 0, 8000, 3, 9), ("late", 0, 20_000, 4, 9), ("z", 10**7, 10**7, 5, 0)]
    df = spark.createDataFrame(rows, "key string, t0_ms long, ts_ms long, seq long, v int").withColumn("at", F.timestamp_millis("ts_ms"))
    feed = Feed(spark, df, tmp_path, ["seq"])
    feed.add(0, len(rows), len(rows))
    got = run_to_table(streams.stream_wait(feed.stream, F.expr("v > 6"), 3000, delay="1 second"), "w", f"{tmp_path}/home").filter("key <> 'z'").collect()
    assert same(got, [("k", 300, True), ("late", None, False)])


@pytest.mark.parametrize("shuffled", [False, True])
def test_storage_state_over_batches_and_a_restart(spark, tmp_path, shuffled):
    rng = random.Random(2)
    rows = [("p" if i % 3 else "q", "o", "local", rng.choice(["set"] * 12 + ["remove"] * 3 + ["clear", "get"]), f"k{rng.randrange(30)}", rng.choice([str(i), None]), i, i, rng.random())
            for i in range(400)]
    log = spark.createDataFrame(rows, "profile string, origin string, area string, action string, key string, value string, ts_ms long, seq long, r double")
    feed = Feed(spark, log, tmp_path, ["r" if shuffled else "seq"])
    home = f"{tmp_path}/home"
    feed.add(0, 250, 3)
    first = run(streams.stream_kv(feed.stream), "kv", home)
    if not shuffled:
        assert same(entries_of(spark, first.checkpoint).select("profile", "origin", "area", "key", "value", "seq").collect(), state.kv_state(log.filter("seq < 250")).collect())
    feed.add(250, 400, 2)
    second = run(streams.stream_kv(feed.stream), "kv", home)
    got = entries_of(spark, second.checkpoint).select("profile", "origin", "area", "key", "value", "seq").collect()
    assert second.batches == 2 and same(got, state.kv_state(log).collect())
    # The change rows replay to the same state.
    last = spark.read.parquet(second.table).groupBy("profile", "origin", "area", "key").agg(F.max_by(F.struct("live", "value", "seq"), F.struct("seq", ~F.col("live"))).alias("l"))
    assert same(last.filter("l.live").select("profile", "origin", "area", "key", "l.value", "l.seq").collect(), got)


def test_one_change_writes_one_entry(spark, tmp_path):
    rows = [("p", "o", "local", "set", f"k{i}", "v", i, i) for i in range(200)] + [("p", "o", "local", "set", "k7", "w", 200, 200)]
    log = spark.createDataFrame(rows, "profile string, origin string, area string, action string, key string, value string, ts_ms long, seq long")
    feed = Feed(spark, log, tmp_path, ["seq"])
    feed.add(0, 200, 1)
    run(streams.stream_kv(feed.stream), "kv", f"{tmp_path}/home")
    before = spark.read.parquet(f"{tmp_path}/home/table").count()
    feed.add(200, 201, 1)
    done = run(streams.stream_kv(feed.stream), "kv", f"{tmp_path}/home")
    assert before == 200 and spark.read.parquet(done.table).count() == 201
    assert entries_of(spark, done.checkpoint).filter("key = 'k7'").first()["value"] == "w"


def test_cookie_jar_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    cookie = "array<struct<name:string,value:string,domain:string,path:string,url:string,expires:double,httpOnly:boolean,secure:boolean,sameSite:string>>"

    def one():
        if rng.random() < 0.5:
            return (f"c{rng.randrange(6)}", str(rng.random()), rng.choice([".x.org", "y.org"]), rng.choice(["/", "/a", None]), None, rng.choice([None, -1.0, 5.0]), None, True, "Lax")
        return (f"u{rng.randrange(4)}", str(rng.random()), None, None, rng.choice(["https://x.org/a/b?q", "http://u@Y.org:80", "nothing"]), None, False, None, None)
    rows = [(rng.choice("pq"), i, "clear" if rng.random() < 0.04 else "set", [one() for _ in range(rng.choice([1, 2, 3, 70] if i % 20 == 0 else [1, 2]))]) for i in range(300)]
    calls = spark.createDataFrame(rows, f"profile string, seq long, action string, cookies {cookie}")
    feed = Feed(spark, calls, tmp_path, ["seq"])
    feed.add(0, 120, 2)
    run(streams.stream_cookies(feed.stream), "c", f"{tmp_path}/home")
    feed.add(120, 300, 2)
    done = run(streams.stream_cookies(feed.stream), "c", f"{tmp_path}/home")
    want = state.cookie_state(calls)
    assert want.count() > 5 and same(entries_of(spark, done.checkpoint).select(*want.columns).collect(), want.collect())


def test_late_rows_are_counted(spark, tmp_path):
    hour = 3_600_000
    rows = [(1, i * hour, i) for i in range(10)] + [(2, 20 * hour, 10), (3, 20 * hour, 11), (1, 100, 12), (2, 200, 13), (2, 20 * hour - 100, 14), (3, 90 * hour, 15)]
    df = spark.createDataFrame(rows, "user_id long, ts_ms long, seq long").withColumn("at", F.timestamp_millis("ts_ms"))
    feed = Feed(spark, df, tmp_path, ["seq"])
    for first, last in ((0, 11), (11, 12), (12, 15), (15, 16)):  # the watermark of a batch judges the rows of the next but one
        feed.add(first, last, 1)
    done = run(streams.stream_sessions(feed.stream), "s", f"{tmp_path}/home")
    got = spark.read.parquet(done.table).filter("user_id < 3").collect()
    assert done.late == 2
    assert same(got, [(1, i * hour, i * hour, 1) for i in range(10)] + [(2, 20 * hour - 100, 20 * hour, 2)])


def test_ring_goes_on_from_its_home(spark, tmp_path):
    log = spark.createDataFrame([("p" if i % 3 else "q", i, i) for i in range(120)], "profile string, ts_ms long, seq long")
    feed = Feed(spark, log, tmp_path, ["seq"])
    feed.add(0, 70, 2)
    streams.stream_ring(feed.stream, 10, home=f"{tmp_path}/home")
    feed.add(70, 120, 2)
    kept = streams.stream_ring(feed.stream, 10, home=f"{tmp_path}/home").select("profile", "seq", "total").collect()
    assert same(kept, logs.ring(log, 10).select("profile", "seq", "total").collect())
    assert len(list((tmp_path / "home").glob("v=*"))) == 2
