"""Structure repair of conversations: least-cost edits that make role initials match ``(s?(ua)+)?``.

The edit problem itself is in ``block_tables``. Here rows are sorted once over range partitions and cut into chunks of ``CHUNK_ROWS``
neighbours, so a conversation of any length is spread over many tasks and a chunk never holds two conversations:

* repeated rows: the first place of every (conversation, role, text digest) inside a chunk, then the first of those;
* chunks of conversations that span several become 4 x 4 matrices of costs; a scan from the right (one small row a chunk) gives every
  chunk the vector at its right edge, all chunks are then traced from each of the four places, and a scan from the left says which applies;
* texts are joined inside chunks and hashed in one pass over the chunks of a conversation.

The two scans and the hash run along a conversation, as their results do; they hold one chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import block_tables as bt
from .common import col, settle
from .ranges import placed

CHUNK_BITS = 6
CHUNK_ROWS = 1 << CHUNK_BITS
BLANKS = r" \t\n\u000B\u000C\r"


@dataclass(frozen=True)
class Repair:
    """``rows``: k, chunk, at, alone, role, text, codes (of the row's edits, see ``block_tables.CODES``), in order of ``at``.
    ``conversations``: k, gaps, blank, duplicate, truncated, illegal, cost, audit. ``keys``: k, conv_id, for every conversation, also those without rows."""

    rows: DataFrame
    conversations: DataFrame
    keys: DataFrame


def conversation_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text after seeded damage: crc32(`conv_id:turn`) % 20 is 0: dropped; 1: text emptied; 2: ``.!?`` removed;
    3: repeated; 4: role set to user. Nulls are read as one space, in the seed as in role and text; turn and conv_id stay null."""
    conv, turn = col(conv_col), col(turn_col)
    space = F.lit(" ")
    seed = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    hit = F.pmod(F.crc32(seed.cast("binary")), F.lit(20))
    role, text = F.coalesce(col(role_col).cast("string"), space), F.coalesce(col(text_col).cast("string"), space)
    return rows.select(
        conv.alias("conv_id"), turn.alias("turn"), hit.alias("hit"),
        F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    ).filter("hit <> 0").withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", "role", "text")


def _along(df: DataFrame, descending: bool, run, schema: str) -> DataFrame:
    """Pass over the chunks of each conversation in order; ``run`` gets an iterator of row dicts and yields row dicts."""
    order = F.col("chunk").desc() if descending else F.col("chunk")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (r for b in batches for r in b.to_pylist())
        out = []
        for r in run(seen):
            out.append(r)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)
    return df.repartition("k").sortWithinPartitions("k", order).mapInArrow(_typed(call, schema), schema)


def _typed(call, schema: str):
    """Batches with exactly the types of ``schema`` (k string, then longs, arrays of longs or strings)."""
    def kind(name: str):
        if name.startswith("array<"):
            return pa.list_(kind(name[6:-1]))
        return {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[name]
    fields = pa.schema([(f.split()[0], kind(f.split()[1])) for f in schema.split(", ")])

    def run(batches):
        for b in call(batches):
            yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in fields], schema=fields)
    return run


def _each(run, schema: str):
    """A function of one row dict to one row dict, over batches."""
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pylist([run(r) for r in b.to_pylist()])
    return _typed(call, schema)


def _matrix(r: dict) -> dict:
    return {"k": r["k"], "chunk": r["chunk"], "matrix": bt.tables().matrix(bt.symbols(r["roles"], r["faults"]))}


def _rights(rows: Iterator[dict]) -> Iterator[dict]:
    key, vector = None, None
    for r in rows:
        if r["k"] != key:
            key, vector = r["k"], list(bt.END)
        yield {"k": key, "chunk": r["chunk"], "right": vector}
        m = r["matrix"]
        vector = [min(bt.FAR, *(m[4 * q + to] + vector[to] for to in range(4))) for q in range(4)]


def _exits(r: dict) -> dict:
    syms = bt.symbols(r["roles"], r["faults"])
    return {"k": r["k"], "chunk": r["chunk"], "exits": [
        bt.tables().trace(syms, tuple(r["right"]), q)[1] if before < bt.FAR // 2 else -1
        for q, before in enumerate(bt.tables().back(syms, tuple(r["right"]))[2])]}


def _entries(rows: Iterator[dict]) -> Iterator[dict]:
    key, place = None, bt.START
    for r in rows:
        if r["k"] != key:
            key, place = r["k"], bt.START
        yield {"k": key, "chunk": r["chunk"], "entry": place}
        place = r["exits"][place]


def _traced(r: dict) -> dict:
    codes, place, cost = bt.tables().trace(bt.symbols(r["roles"], r["faults"]), tuple(r["right"]), r["entry"])
    if r["last"]:
        codes[-1] += bt.trailing(place)
        cost += bt.END[place]
    return {"k": r["k"], "chunk": r["chunk"], "codes": codes, "cost": cost, "audit": "".join(codes).translate(bt.LETTERS)}


def _chunks(rows: DataFrame) -> DataFrame:
    """k, chunk, ats, roles, faults, alone, last, and the counts of faults and illegal neighbours."""
    firsts = rows.filter("body <> ''").groupBy("k", "role", "digest", "chunk").agg(F.min("at").alias("at")).withColumn(
        "first", F.min("at").over(Window.partitionBy("k", "role", "digest"))).filter("at = first").groupBy("k", "chunk").agg(
        F.collect_list("at").alias("firsts"))
    initial = F.substring("role", 1, 1)
    lists = rows.groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct(
        "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"), (F.col("body") == "").alias("blank"),
        (~F.right("body", F.lit(1)).isin(".", "!", "?")).alias("cut")))).alias("rows")).join(firsts, ["k", "chunk"], "left")
    fault = lambda r: F.when(r["blank"], "b").when(~F.array_contains(F.col("firsts"), r["at"]), "d").when(r["cut"], "t").otherwise(".")
    along = Window.partitionBy("k").orderBy("chunk")
    return (
        lists.withColumn("firsts", F.coalesce("firsts", F.array().cast("array<bigint>")))
        .select("k", "chunk", F.transform("rows", lambda r: r["at"]).alias("ats"), F.array_join(F.transform("rows", lambda r: r["role"]), "").alias("roles"),
                F.array_join(F.transform("rows", fault), "").alias("faults"))
        .withColumn("pairs", F.concat(F.coalesce(F.lag(F.right("roles", F.lit(1))).over(along), F.lit("")), "roles"))
        .withColumn("last", F.lead("chunk").over(along).isNull())
        .withColumn("alone", F.col("last") & F.lag("chunk").over(along).isNull())
        .withColumn("illegal", F.length("pairs") - 1 - F.regexp_count("pairs", F.lit("(?=su|ua|au)")))
        .select("k", "chunk", "ats", "roles", "faults", "last", "alone", F.col("illegal").cast("long").alias("illegal"),
                *[F.regexp_count("faults", F.lit(c)).cast("long").alias(n) for c, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    )


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           everyone: DataFrame | None = None) -> Repair:
    """Cheapest edits of every conversation; see ``Repair``.

    Rows are taken by turn, nulls first, then role and text. A row's first fault counts: blank text, role and text seen earlier in its
    conversation, last character that is no blank not one of ``.!?``. Keep costs 0, re-role to user or assistant 3, delete 4 (a must for blank
    and repeated rows), insert an empty user or assistant row 3; a truncated row that stays adds 3; of the cheapest edits those whose initials come first in
    ASCII are taken. Null roles and texts count as one space, a null conversation is one of its own, other columns take no part.
    ``everyone``: a table whose conversations get a result even without rows: zeros and an empty audit. Empty tables give empty results.
    """
    space = F.lit(" ")
    body = F.expr(f"trim(BOTH '{BLANKS}' FROM text)")
    base = rows.select(conversation_key(col(conv_col)).alias("k"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), space).alias("role"),
                       F.coalesce(col(text_col).cast("string"), space).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    sorted_rows = placed(base, [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "repair-rows").withColumn(
        "chunk", F.shiftright("at", CHUNK_BITS))
    chunks = settle(_chunks(sorted_rows.withColumn("body", F.right(body, F.lit(1))).drop("text")), "repair-chunks")

    symbols = chunks.filter("not alone").select("k", "chunk", "roles", "faults")
    matrices = symbols.mapInArrow(_each(_matrix, "k string, chunk long, matrix array<long>"), "k string, chunk long, matrix array<long>")
    rights = settle(_along(matrices, True, _rights, "k string, chunk long, right array<long>"), "repair-rights")
    exits = symbols.join(rights, ["k", "chunk"]).mapInArrow(_each(_exits, "k string, chunk long, exits array<long>"), "k string, chunk long, exits array<long>")
    entries = _along(exits, False, _entries, "k string, chunk long, entry long")
    placed_chunks = chunks.select("k", "chunk", "roles", "faults", "last").join(rights, ["k", "chunk"], "left").join(entries, ["k", "chunk"], "left").select(
        "k", "chunk", "roles", "faults", "last", F.coalesce("entry", F.lit(bt.START).cast("long")).alias("entry"),
        F.coalesce("right", F.array(*[F.lit(x).cast("long") for x in bt.END])).alias("right"))
    schema = "k string, chunk long, codes array<string>, cost long, audit string"
    traced = settle(placed_chunks.mapInArrow(_each(_traced, schema), schema).join(chunks.drop("roles", "faults", "last"), ["k", "chunk"]), "repair-traced")

    edited = sorted_rows.select("k", "chunk", "at", "role", "text").join(traced.select("k", "chunk", "alone", "ats", "codes"), ["k", "chunk"]).select(
        "k", "chunk", "at", "alone", "role", "text", F.element_at("codes", F.array_position("ats", F.col("at")).cast("int")).alias("codes"))
    found = traced.groupBy("k").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda c: c["audit"]), "").alias("audit"))
    gaps = sorted_rows.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    keys = (rows if everyone is None else everyone).select(conversation_key(col(conv_col)).alias("k"), col(conv_col).alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    conversations = keys.select("k").join(gaps, "k", "left").join(found, "k", "left").select(
        "k", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))
    return Repair(edited, conversations, keys)


def _pieces(codes: Column, role: Column, text: Column) -> Column:
    """Repaired rows (struct role, text) that come of one row."""
    def piece(c):
        return F.struct(
            F.when(c == "k", role).when(c.isin("U", "u"), "user").otherwise("assistant").alias("role"),
            F.when(c.isin("k", "u", "a"), text).otherwise("").alias("text"))
    return F.transform(F.filter(F.split(codes, ""), lambda c: ~c.isin("d", "")), piece)


def messages(done: Repair) -> DataFrame:
    """k, at, part, role, text: the repaired conversations, in order of (at, part) inside k."""
    return done.rows.select("k", "at", F.posexplode(_pieces(F.col("codes"), F.col("role"), F.col("text"))).alias("part", "p")).select("k", "at", "part", "p.role", "p.text")


def _hashed(rows: Iterator[dict]) -> Iterator[dict]:
    key, state, begun = None, None, False
    for r in rows:
        if r["k"] != key:
            if key is not None:
                yield {"k": key, "digest": state.hexdigest()}
            key, state, begun = r["k"], hashlib.sha256(), False
        if r["joined"] is not None:
            state.update((("\n" if begun else "") + r["joined"]).encode())
            begun = True
    if key is not None:
        yield {"k": key, "digest": state.hexdigest()}


def transcript_digests(done: Repair) -> DataFrame:
    """k, digest: SHA-256 of the repaired ``role:text`` rows, newline-joined. Conversations without rows are left out."""
    pieces = F.transform(_pieces(F.col("codes"), F.col("role"), F.col("text")), lambda p: F.concat(p["role"], F.lit(":"), p["text"]))
    joined = done.rows.select("k", "chunk", "at", "alone", pieces.alias("pieces")).groupBy("k", "chunk", "alone").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pieces"))), lambda r: r["pieces"])).alias("pieces")).select(
        "k", "chunk", "alone", F.when(F.size("pieces") > 0, F.array_join("pieces", "\n")).alias("joined"))
    chunks = settle(joined.select(
        "k", "chunk", "alone", F.when(F.col("alone"), F.sha2(F.coalesce("joined", F.lit("")), 256)).alias("digest"), F.when(~F.col("alone"), F.col("joined")).alias("joined")),
        "repair-texts")
    spanning = _along(chunks.filter("not alone").select("k", "chunk", "joined"), False, _hashed, "k string, digest string")
    return chunks.filter("alone").select("k", "digest").unionByName(spanning)
