"""Keyed state of streams: timers that fire once a key, and latest entries kept in a map per key.

The state lives in the RocksDB store, so a micro-batch writes the keys it changed and nothing else, and it can be read back from a
stopped or running query's checkpoint with ``entries_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE_CLASS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 16


def use_state_store(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, logging changes only. Running ones keep what their checkpoint names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE_CLASS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class OncePerKey(StatefulProcessor):
    """Collects a key's rows until its time has come, gives one result, and remembers that it did.

    ``take(state, row) -> (state, due_ms)`` folds a row into the state (a tuple, None at first); the key is due when the
    watermark passes ``due_ms``. ``result(key, state)`` is the row given then. Afterwards a mark stays behind, so later rows of the key
    change nothing; it is dropped when the key was silent for ``keep_ms`` of event time.
    """

    def __init__(self, state_schema: str, take: Callable, result: Callable, time_of: Callable, keep_ms: int):
        self.schema = f"due_ms long, given boolean, last_ms long, {state_schema}"
        self.nothing = (None,) * len(T.StructType.fromDDL(state_schema))
        self.take, self.result, self.time_of, self.keep_ms = take, result, time_of, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)  # mark and state in one value: each call to the store is a message of its own

    def _timer(self, old: int | None, new: int) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        due, given, last, *state = held or (None, False, None)
        state = tuple(state) if held and not given else None
        when = due
        for row in rows:
            last = max(self.time_of(row), last if last is not None else self.time_of(row))
            if not given:
                state, when = self.take(state, row)
        if given:
            when = max(due, last + self.keep_ms)
        self._timer(due, when)
        self.held.update((when, given, last, *(self.nothing if given else state)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due, given, last, *state = self.held.get()
        if given:
            self.held.clear()
            return
        yield self.result(key, tuple(state))
        forget = max(due, last) + self.keep_ms
        self.handle.registerTimer(forget)
        self.held.update((forget, True, last, *self.nothing))

    def close(self) -> None:
        pass


class LatestEntries(StatefulProcessor):
    """The latest change of every entry of a key, and the latest time that all of them were cleared.

    Rows: seq, pos (their order), clears, live, then the entry's and the value's columns. Rows may come in any order. Every
    change of an entry comes out as a row: key, entry, value columns, seq, pos, live.
    """

    def __init__(self, keys: Sequence[str], entry: Sequence[tuple[str, str]], values: Sequence[tuple[str, str]]):
        self.keys, self.entry, self.values = list(keys), [n for n, _ in entry], [n for n, _ in values]
        self.entry_schema = ", ".join(f"{n} {t}" for n, t in entry)
        self.value_schema = ", ".join(["seq long", "pos long", "live boolean", *[f"{n} {t}" for n, t in values]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", self.entry_schema, self.value_schema)
        self.cleared = handle.getValueState("cleared", "seq long")

    def _row(self, key, entry, value) -> Row:
        named = dict(zip(self.keys, key)) | dict(zip(self.entry, entry)) | dict(zip(["seq", "pos", "live", *self.values], value))
        return Row(**named)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.cleared.get()[0] if self.cleared.exists() else None
        cleared, latest = before, {}
        for r in rows:
            if r["clears"]:
                cleared = r["seq"] if cleared is None else max(cleared, r["seq"])
                continue
            entry = tuple(r[n] for n in self.entry)
            value = (r["seq"], r["pos"], r["live"], *[r[n] for n in self.values])
            if entry not in latest or latest[entry][:2] < value[:2]:
                latest[entry] = value
        if cleared != before:
            self.cleared.update((cleared,))
            gone = [(e, v) for e, v in self.entries.iterator() if v[0] < cleared]
            for entry, value in gone:
                self.entries.removeKey(entry)
                if value[2]:
                    yield self._row(key, entry, (cleared, 0, False, *value[3:]))
        for entry, value in latest.items():
            if cleared is not None and value[0] < cleared:
                continue
            if self.entries.containsKey(entry) and tuple(self.entries.getValue(entry)[:2]) >= value[:2]:
                continue
            self.entries.updateValue(entry, value)
            yield self._row(key, entry, value)

    def close(self) -> None:
        pass


def latest_entries(changes: DataFrame, keys: Sequence[str], entry: Sequence[str], values: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Stream of changes (keys, entry, values, seq, pos, clears, live) to stream of entry changes, keeping the latest of each as state.

    A key's entries are dealt over ``buckets``, each with its own map, so that one key's changes are not one task's; clearing rows
    go to all of its buckets.
    """
    use_state_store(changes.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    own = F.array(F.pmod(F.xxhash64(*entry), F.lit(buckets)).cast("int"))
    dealt = changes.withColumn("bucket", F.explode(F.when(F.col("clears"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(own)))
    key_columns = [*keys, "bucket"]
    schema = ", ".join([*[f"{n} {kinds.get(n, 'int')}" for n in key_columns], *[f"{n} {kinds[n]}" for n in entry], "seq long", "pos long", "live boolean",
                        *[f"{n} {kinds[n]}" for n in values]])
    worker = LatestEntries(key_columns, [(n, kinds[n]) for n in entry], [(n, kinds[n]) for n in values])
    return dealt.groupBy(*key_columns).transformWithState(worker, schema, "append", "none").drop("bucket")


def entries_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Live entries held by the state of a ``latest_entries`` stream: keys, entry, seq, pos, values."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entries").load()
    return held.select("key.*", "user_map_key.*", "user_map_value.*").filter("live").drop("live", "bucket")


def timed(value: Column) -> Column:
    return F.timestamp_millis(value)
