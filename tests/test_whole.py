"""Queries work on their whole tables: rows that were once left out."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagespark.operators import state
from pagespark.plans import feeds


def test_cookies_for_urls_of_any_k(spark, sf, tmp_path):
    """No event has k >= 90, so every match comes from urls that used to be left out."""
    home = str(tmp_path)
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.filter(F.get_json_object("props", "$.k").cast("int") < 90).write.parquet(f"{home}/events.parquet")
    urls = [r["url"].removeprefix("https://").partition("/") for r in feeds.raw_requests(spark, home).select("url").distinct().collect()]
    jar = entry.queries()["cookie_jar"](spark, home).collect()
    want = [c for c in jar if any(
        ("." + host).endswith("." + c["domain"].removeprefix(".")) and f"/{rest}".startswith(c["path"]) for host, _, rest in urls)]
    got = entry.queries()["cookies_for_urls"](spark, home).collect()
    assert want and sorted(got, key=repr) == sorted(want, key=repr)


def test_cookies_for_paths_and_secure(spark):
    cookies = spark.createDataFrame(
        [("a", ".x.org", "/", False), ("b", "x.org", "/view", True), ("c", "w.x.org", "/view/12", None), ("d", "x.org", "/view/123", False),
         ("e", "X.org", "/v", True), ("f", "y.org", "/", False), ("g", "x.org", None, False), ("h", "localhost", "/", True)],
        "name string, domain string, path string, secure boolean")
    urls = spark.createDataFrame(
        [("https://w.x.org/view/12?q=/view/123",), ("http://x.org/vie",), ("http://x.org",), ("http://localhost:80/a",), ("https://notx.org/view",)], "url string")
    assert {r["name"] for r in state.cookies_for(cookies, urls).collect()} == {"a", "b", "c", "e", "h"}
    plain = urls.filter(~F.col("url").startswith("https"))
    assert {r["name"] for r in state.cookies_for(cookies, plain).collect()} == {"a", "h"}


def _batch_twin(sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("stream, batch, keep", [
    ("stream_paired_requests", "paired_requests", ["req_id", "profile", "tab_id", "ts_ms", "duration_ms"]),
    ("stream_sessions", "sessions_six_hours", ["user_id", "start_ms", "last_ms", "n_events"]),
    ("stream_settle_times", "settle_times", ["load_id", "settled_ms"]),
])
def test_streams_give_all_rows(spark, sf, stream, batch, keep):
    """A finished stream has every row of the batch operator, unmatched ends and the newest rows too."""
    cols, want = _batch_twin(sf, batch)
    at = [cols.index(c) for c in keep]
    got = entry.queries()[stream](spark, sf)
    assert sorted(got.columns) == sorted(keep)
    assert sorted((tuple(r) for r in got.select(*keep).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want), key=repr)


def test_tokenizer_function_counts_nodes_in_spark(spark, sf):
    plan = entry.queries()["tokenizer_function"](spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "PythonUDTF" not in plan
