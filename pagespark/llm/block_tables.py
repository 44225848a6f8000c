"""Cheapest repair of a role sequence by Four-Russians block tables (no Spark here).

A conversation is legal when its role initials match ``(s?(ua)+)?``. The places of that grammar are START, SYSTEM, USER, ASSISTANT; the cost
of finishing from each of them is a vector of four numbers. Reading rows from the right, a row's symbol turns the vector behind it into the one
before it. Vectors less their minimum take few values, so the transitions of every vector under every block of ``BLOCK`` symbols are computed
once; a sequence is then processed by one lookup a block. To trace, a block is expanded backward from the vector at its right
edge, and edits are chosen from the left: of those that keep the cost, the one of least initial, so ties give the least audit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # CUT: added by a truncated row that stays
FAR = 1 << 40
BLOCK = 3
SYMBOLS = 9  # (s, u, a, other) x (whole, truncated), and one that must be deleted
MUST_DELETE = 8
INSERTED = (USER, USER, ASSISTANT, USER)  # the place after inserting (or re-roling) from each place
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "o": (None,) * 4}
END = (0, 2 * INSERT, INSERT, 0)  # finishing without rows left
CODES = {USER: ("U", "u"), ASSISTANT: ("A", "a")}  # what a row's edits are called: inserted, re-roled to; k keeps, d deletes
LETTERS = str.maketrans("UAuakd", "IIRRKD")


def symbols(roles: str, faults: str) -> list[int]:
    """One symbol a row. ``roles``: s, u, a or o; ``faults``: b (blank), d (duplicate), t (truncated) or ``.``"""
    return [MUST_DELETE if f in "bd" else "suao".index(r) * 2 + (f == "t") for r, f in zip(roles, faults, strict=True)]


def edits(symbol: int, place: int) -> list[tuple[str, int, int]]:
    """(code, cost, next place) of the edits that take a row, least initial first."""
    out = [("d", DELETE, place)]
    if symbol != MUST_DELETE:
        cut = CUT * (symbol % 2)
        kept = KEPT["suao"[symbol // 2]][place]
        if kept is not None:
            out.append(("k", KEEP + cut, kept))
        out.append((CODES[INSERTED[place]][1], REROLE + cut, INSERTED[place]))
    return out


def before_row(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row from the one behind it, insertions before the row included."""
    out = [min(FAR, *(cost + after[to] for _, cost, to in edits(symbol, q))) for q in range(4)]
    for _ in range(2):
        out = [min(FAR, out[q], INSERT + out[INSERTED[q]]) for q in range(4)]
    return tuple(out)


def normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(vector)
    return tuple(FAR if x >= FAR // 2 else x - low for x in vector), low


def unit(place: int) -> tuple[int, ...]:
    return tuple(0 if q == place else FAR for q in range(4))


class Tables:
    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        steps: list[list[tuple[int, int]]] = []
        for v in (END, *map(unit, range(4))):
            self._id(normal(v)[0])
        for v in self.vectors:  # grows while it is read: the closure under all symbols
            row = []
            for s in range(SYMBOLS):
                to, shift = normal(before_row(s, v))
                row.append((self._id(to), shift))
            steps.append(row)
        step = np.array([[to for to, _ in row] for row in steps], np.int64)
        shift = np.array([[by for _, by in row] for row in steps], np.int64)
        self.step, self.shift = step, shift
        to, by = step, shift
        for _ in range(BLOCK - 1):  # one more symbol on the left of every block
            by = (by[:, None, :] + shift[to].transpose(0, 2, 1)).reshape(len(steps), -1)
            to = step[to].transpose(0, 2, 1).reshape(len(steps), -1)
        self.block_to, self.block_by = to, by
        self.traces: dict[tuple, tuple[list[str], int]] = {}

    def _id(self, vector: tuple[int, ...]) -> int:
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector]

    def _cut(self, syms: list[int]) -> tuple[list[int], list[int]]:
        """Block numbers from the left, and the symbols left over on the right."""
        whole = len(syms) - len(syms) % BLOCK
        s = np.array(syms[:whole], np.int64).reshape(-1, BLOCK)
        code = np.zeros(len(s), np.int64)
        for j in range(BLOCK):
            code = code * SYMBOLS + s[:, j]
        return code.tolist(), syms[whole:]

    def back(self, syms: list[int], right: tuple[int, ...]) -> tuple[list[int], list[int], tuple[int, ...]]:
        """(vector ids right of every block, those right of every symbol left over, the vector before everything)."""
        blocks, rest = self._cut(syms)
        vector, total = normal(right)
        at = self.ids[vector]
        rest_ids, ids = [0] * len(rest), [0] * len(blocks)
        for j in range(len(rest) - 1, -1, -1):
            rest_ids[j] = at
            at, total = int(self.step[at, rest[j]]), total + int(self.shift[at, rest[j]])
        for j in range(len(blocks) - 1, -1, -1):
            ids[j] = at
            at, total = int(self.block_to[at, blocks[j]]), total + int(self.block_by[at, blocks[j]])
        return ids, rest_ids, tuple(min(FAR, x + total) for x in self.vectors[at])

    def matrix(self, syms: list[int]) -> list[int]:
        """Least cost from each place before the rows to each place behind them (16 numbers, by place before)."""
        columns = [self.back(syms, unit(q))[2] for q in range(4)]
        return [columns[to][at] for at in range(4) for to in range(4)]

    def _trace_block(self, syms: tuple[int, ...], right: int, place: int) -> tuple[list[str], int]:
        key = (syms, right, place)
        if key not in self.traces:
            if len(self.traces) >= 200_000:
                self.traces.clear()
            vectors = [self.vectors[right]]
            for s in reversed(syms):
                vectors.append(before_row(s, vectors[-1]))
            vectors.reverse()
            codes = []
            for s, here, after in zip(syms, vectors, vectors[1:]):
                code = ""
                while True:
                    choices = edits(s, place)
                    choices.insert(1, (CODES[INSERTED[place]][0], INSERT, None))
                    for name, cost, to in choices:
                        left = here[INSERTED[place]] if to is None else after[to]
                        if cost + left == here[place]:
                            break
                    code += name
                    place = INSERTED[place] if to is None else to
                    if to is not None:
                        break
                codes.append(code)
            self.traces[key] = (codes, place)
        return self.traces[key]

    def trace(self, syms: list[int], right: tuple[int, ...], place: int) -> tuple[list[str], int, int]:
        """(codes of every row, the place behind them, cost of the way to there); see ``CODES``."""
        ids, rest_ids, left = self.back(syms, right)
        codes, began = [], place
        for j, at in enumerate(ids):
            more, place = self._trace_block(tuple(syms[j * BLOCK:(j + 1) * BLOCK]), at, place)
            codes += more
        for s, at in zip(syms[len(ids) * BLOCK:], rest_ids):
            more, place = self._trace_block((s,), at, place)
            codes += more
        return codes, place, left[began] - right[place]


def trailing(place: int) -> str:
    """Insertions after the last row."""
    return {SYSTEM: "UA", USER: "A"}.get(place, "")


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()
