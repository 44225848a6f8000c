"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

The merges define a nondeterministic transducer: after token t it may emit token u when encode(t + u) is
(t, u). Of every prefix of the input exactly one token sequence obeys all such pairs, so a
hypothesis is (last token, trie node of the bytes since). A deterministic state is the set of live
hypotheses; it and its arcs, which name the token that ends at a byte, are built when first needed. A hypothesis
lives for the longest token at most, which bounds the lookahead: tokens on which all live hypotheses agree
are emitted in blocks, the rest at the end of the match. Matches of the split pattern are encoded separately and remembered; both
memories are emptied when full, which changes time, never results.

Decoding walks a UTF-8 state machine over tokens: its state is the incomplete sequence so far (three bytes
at most); text leaves as soon as it is complete, malformed bytes become U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, col, packed, unpacked

MAX_ARCS = 690_000  # each memory stays below the size at which its dict doubles
MAX_PIECES = 170_000
NEVER = 1 << 60
TOKEN_BITS = 24  # more tokens than any vocabulary has
TOKEN_MASK = (1 << TOKEN_BITS) - 1
LOOKBACK = 1 << 14  # bytes between emissions inside one match; far above the longest token
ROWS_OUT_BYTES = 8 << 20
BLANK_BESIDE_SPACE = re.compile(r" (?:\s|\Z|(?<=\A )|(?<=\s ))")  # begins with the space, so a search leaps from space to space


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks file (base64 token and rank a line), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes to token ids, an arc at a time."""

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = MAX_ARCS):
        self.ranks = ranks
        self.max_arcs = max_arcs
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.inner = {key >> 8 for key in self.child}  # nodes from which some token goes on
        self.longest = max(map(len, ranks), default=1)
        self._edges: dict[int, tuple | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = bytes(8)
        self.states = [start]  # hypotheses, each a 64-bit node << TOKEN_BITS | last token + 1
        self.number = {start: 0}
        self.arcs: dict[int, int] = {}  # state << 8 | byte -> state << TOKEN_BITS | token that ends here

    def merged(self, text: bytes) -> list[int]:
        """The merges themselves, for the few bytes of one or two tokens: lowest rank first, leftmost of equals."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int) -> tuple | None:
        """Left and right edge of a token while its own merges run: [(piece, rank of the merge that takes it), ...].

        None where the merges do not lead to the token. Third: do ranks rise on the way?
        """
        if token in self._edges:
            return self._edges[token]
        text = self.bytes_of[token]
        parts = [text[i:i + 1] for i in range(len(text))]
        left, right, rising, last = [], [], True, -1
        while len(parts) > 1:
            ranked = [(self.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.ranks]
            if not ranked:
                break
            rank, at = min(ranked)
            rising, last = rising and rank >= last, rank
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        end = [(text, NEVER)]
        edge = self._edges[token] = (left + end, right + end, rising) if parts == [text] else None
        return edge

    def follows(self, last: int, token: int) -> bool:
        """Is encode(last + token) just these two tokens?"""
        edge = self._edge(token)
        if edge is None or last < 0:
            return edge is not None
        pair = self._pairs.get(last << 32 | token)
        if pair is None:
            if len(self._pairs) > self.max_arcs // 4:
                self._pairs.clear()
            pair = self._pairs[last << 32 | token] = self._apart(self._edge(last), edge, last, token)
        return pair

    def _apart(self, before: tuple, after: tuple, last: int, token: int) -> bool:
        if not (before[2] and after[2]):
            return self.merged(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        i = j = 0
        while True:  # ranks rise, so they are the time at which pieces appear and vanish
            (left, left_until), (right, right_until) = before[1][i], after[0][j]
            across = self.ranks.get(left + right, NEVER)
            if across < left_until and across <= right_until and across < NEVER:
                return False
            if left_until == NEVER and right_until == NEVER:
                return True
            if left_until <= right_until:
                i += 1
            else:
                j += 1

    def _arc(self, state: int, byte: int) -> int:
        live = []
        fresh = -1
        child, inner, token_at, pairs = self.child, self.inner, self.token_at, self._pairs
        for held in memoryview(self.states[state]).cast("q"):
            to = child.get(held >> TOKEN_BITS << 8 | byte)
            if to is None:
                continue
            last = (held & TOKEN_MASK) - 1
            if to in inner:
                live.append(to << TOKEN_BITS | last + 1)
            if fresh < 0:
                token = token_at[to]
                if token >= 0:
                    fits = pairs.get(last << 32 | token)
                    if self.follows(last, token) if fits is None else fits:
                        fresh = token
        if fresh < 0:
            raise ValueError("the vocabulary lacks a byte")
        live.append(fresh + 1)
        after = struct.pack(f"{len(live)}q", *live)
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        self.arcs[state << 8 | byte] = arc = to << TOKEN_BITS | fresh
        return arc

    def _back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of the hypothesis that starts at ``at``; ``ends[i]`` is the token that ends before byte i + 1."""
        out = []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, text: bytes) -> list[int]:
        """Ids of one match. A match that is a token is that token, as in the library whose ids these are."""
        known = self.ranks.get(text)
        if known is not None:
            return [known]
        if len(self.arcs) > self.max_arcs:
            self._reset()
        arcs, state, ends, out = self.arcs, 0, [], []
        for byte in text:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                arc = self._arc(state, byte)
                arcs = self.arcs
            state = arc >> TOKEN_BITS
            ends.append(arc & TOKEN_MASK)
            if len(ends) >= LOOKBACK:
                out += self._emit(ends)
                if len(arcs) > 2 * self.max_arcs:  # one endless match: keep the state, forget the rest
                    held = self.states[state]
                    self._reset()
                    state = self.number.setdefault(held, len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                    arcs = self.arcs
        return out + self._back(ends, len(ends))

    def _emit(self, ends: list[int]) -> list[int]:
        """Tokens that no later byte can change, taken off ``ends``: all hypotheses reach back one longest token at most."""
        agreed, paths = 0, []
        for at in range(len(ends) - self.longest, len(ends) + 1):
            paths.append(self._back(ends, at))
        while all(agreed < len(p) for p in paths) and all(p[agreed] == paths[0][agreed] for p in paths):
            agreed += 1
        out = paths[0][:agreed]
        del ends[:sum(len(self.bytes_of[t]) for t in out)]
        return out


class Encoder:
    """Texts to packed little-endian int32 ids, match by match.

    No match of this family of patterns runs over a space between two non-blank characters, so text is first cut
    at such spaces and whole cuts are remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}  # cut without its space -> ids
        self.pieces: dict[str, bytes] = {}  # match -> ids

    def _packed(self, piece: str) -> bytes:
        got = self.transducer.encode(piece.encode("utf-8"))
        return struct.pack(f"<{len(got)}i", *got)

    def _piece(self, piece: str) -> bytes:
        ids = self._packed(piece)
        if len(piece) <= 64:
            if len(self.pieces) >= self.max_pieces // 2:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _matches(self, text: str) -> bytes:
        pieces, piece = self.pieces, self._piece
        if len(text) < 1 << 20:
            return b"".join([pieces.get(p) or piece(p) for p in self.pattern.findall(text)])
        out, part = bytearray(), []
        for m in self.pattern.finditer(text):
            part.append(pieces.get(m[0]) or piece(m[0]))
            if len(part) >= 1 << 16:
                out += b"".join(part)
                part = []
        return bytes(out) + b"".join(part)

    def _cut(self, cut: str) -> bytes:
        found = self.pattern.findall(" " + cut)
        if len(found) == 1:  # the match is the cut, which is remembered below
            ids = self.pieces.get(found[0]) or self._packed(found[0])
        else:
            ids = b"".join([self.pieces.get(p) or self._piece(p) for p in found])
        if len(cut) <= 64:
            if len(self.known) >= self.max_pieces:
                self.known.clear()
            self.known[cut] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) > 1 << 22 or not text or BLANK_BESIDE_SPACE.search(text):
            return self._matches(text)
        known, cut = self.known, self._cut
        first, *cuts = text.split(" ")
        return b"".join([self._matches(first), *[known.get(c) or cut(c) for c in cuts]])


class Utf8Machine:
    """Streaming decoder. Feed bytes or tokens in pieces of any size; ``close`` ends the stream."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def held_back(text: bytes) -> int:
        """Length of the incomplete sequence at the end."""
        for back in range(1, min(3, len(text)) + 1):
            byte = text[-back]
            if byte >= 0xC0:
                return back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1) else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, text: bytes) -> str:
        text = self.pending + text
        back = self.held_back(text)
        self.pending = text[len(text) - back:] if back else b""
        return text[:len(text) - back].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.alone: list[str | None] = []  # a token's text where the machine starts and ends empty
        for token in self.bytes_of:
            try:
                self.alone.append(token.decode("utf-8"))
            except UnicodeDecodeError:
                self.alone.append(None)
        self.tokens = pa.array(self.bytes_of, pa.binary())

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for i in ids:
            text = self.alone[i]
            yield text if text is not None and not machine.pending else machine.feed(self.bytes_of[i])
        yield machine.close()

    def decode(self, ids: list[int]) -> str:
        parts = [self.alone[i] for i in ids]
        return "".join(parts if None not in parts else self.stream(ids))

    def decode_all(self, ids: pa.ListArray) -> pa.StringArray:
        """The text of each list. Tokens are laid end to end at once; lists are taken one by one only where some bytes are not UTF-8."""
        values, ends = ids.flatten(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        laid = self.tokens.take(values)
        _, bounds, data = laid.buffers()
        at = np.frombuffer(bounds, np.int32, len(laid) + 1)[ends] if len(laid) else np.zeros(len(ends), np.int32)
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at), data or pa.py_buffer(b"")])
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:
            values = values.to_numpy()
            return pa.array([self.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())


def _once(kind, shared, *rest):
    """One encoder and one decoder per Python worker. Runs with the same vocabulary share them; those of another vocabulary go before new ones come."""
    key = (shared.id, *rest)
    if KEPT.get(kind.__name__, (None,))[0] != key:
        for name in [name for name, (known, _) in KEPT.items() if name == kind.__name__ or known[0] != shared.id]:
            del KEPT[name]
        KEPT[kind.__name__] = key, kind(shared.value, *rest)
    return KEPT[kind.__name__][1]


class Shared:
    """A broadcast of a vocabulary with an id of its content, so that workers can keep what they made of it from run to run."""

    def __init__(self, spark: SparkSession, value: dict[bytes, int]):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = hashlib.sha256(repr(sorted(value.items())).encode()).hexdigest()

    @property
    def value(self):
        return self.broadcast.value


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose column ``name`` holds about ROWS_OUT_BYTES."""
    step = max(1, int(batch.num_rows * ROWS_OUT_BYTES / max(1, batch.column(name).nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def _packed_ids(coded: list[bytes]) -> pa.ListArray:
    """array<int> column of each text's packed ids."""
    offsets = [0]
    for ids in coded:
        offsets.append(offsets[-1] + len(ids) // 4)
    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(coded))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or those to ``keep``) and ``ids_col``: array<int> of each whole text (null and empty: no ids).

    No special tokens. Rows are independent: repeated rows and ties need no rule, an empty table gives no rows, and a
    column named like ``ids_col`` is replaced.
    """
    shared = Shared(docs.sparkSession, ranks)
    df = packed(docs, keep, text=F.coalesce(col(text_col), F.lit("")))

    def run(batches):
        encoder = _once(Encoder, shared, pattern)
        for whole in batches:
            for batch in _slices(whole, "text"):
                ids = _packed_ids([encoder.encode(t.as_py()) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("row"), ids], names=["row", "ids"])

    out = T.StructType([df.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return unpacked(df.mapInArrow(run, out).withColumnRenamed("ids", ids_col), docs.columns if keep is None else keep, [ids_col])


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded",
               keep: list[str] | None = None, same_col: str | None = None) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one Python worker a task instead of two, each with a vocabulary of its own.

    Columns are those of ``encode`` and ``decoded_col``; the rules are those of the two. With ``same_col`` the decoded text stays in the
    worker, a slice at a time, and that column says whether it is the text (null as empty).
    """
    shared = Shared(docs.sparkSession, ranks)
    df = packed(docs, keep, text=F.coalesce(col(text_col), F.lit("")))

    def run(batches):
        encoder, decoder = _once(Encoder, shared, pattern), _once(Decoder, shared)
        for whole in batches:
            for batch in _slices(whole, "text"):
                ids = _packed_ids([encoder.encode(t.as_py()) for t in batch.column("text")])
                texts = decoder.decode_all(ids)
                result = pc.equal(texts, batch.column("text")) if same_col else texts
                yield pa.RecordBatch.from_arrays([batch.column("row"), ids, result], names=["row", "ids", "decoded"])

    out = T.StructType([df.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BooleanType() if same_col else T.StringType())])
    named = df.mapInArrow(run, out).withColumnsRenamed({"ids": ids_col, "decoded": same_col or decoded_col})
    return unpacked(named, docs.columns if keep is None else keep, [ids_col, same_col or decoded_col])


def decode(coded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and ``text_col``: the text of ``ids_col``, with U+FFFD for bytes that are not UTF-8; null ids give the empty text."""
    shared = Shared(coded.sparkSession, ranks)
    df = packed(coded, ids=F.coalesce(col(ids_col), F.array().cast("array<int>")))

    def run(batches):
        decoder = _once(Decoder, shared)
        for whole in batches:
            for batch in _slices(whole, "ids"):
                yield pa.RecordBatch.from_arrays([batch.column("row"), decoder.decode_all(batch.column("ids"))], names=["row", "text"])

    out = T.StructType([df.schema["row"], T.StructField("text", T.StringType())])
    return unpacked(df.mapInArrow(run, out).withColumnRenamed("text", text_col), coded.columns, [text_col])
