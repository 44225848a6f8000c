"""Running values along an array, and what covers a position, in near-linear time.

Array functions have no scan, and folding into a growing array copies it for each element. Here an array is cut into blocks: an element takes
what its block holds up to it and what all earlier blocks hold together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import let

SHIFT = 6
BLOCK = 1 << SHIFT
NONE = -1


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _running(values: Column, total: Callable[[Column], Column], merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    def whole(v: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda j: total(F.slice(v, j * BLOCK + 1, F.lit(BLOCK))))
        before = let(sums, lambda s: F.transform(s, lambda _, j: F.when(j > 0, total(F.slice(s, 1, j))).otherwise(zero)))
        return let(before, lambda b: F.transform(v, lambda _, i: merge(
            F.get(b, F.shiftright(i, SHIFT)), total(F.slice(v, F.shiftleft(F.shiftright(i, SHIFT), SHIFT) + 1, i % BLOCK + 1)))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))


def running_max(values: Column) -> Column:
    """Largest value up to each position of an array<int> of values above -1 or -1."""
    return _running(values, F.array_max, lambda a, b: F.greatest(a, b), F.lit(NONE))


def running_sum(values: Column) -> Column:
    """Sum up to each position of an array<bigint> without nulls."""
    return _running(values, _total, lambda a, b: a + b, F.lit(0).cast("long"))


def covers(nodes: Column, hit: Callable[[Column], Column]) -> Column:
    """array<boolean>: whether a node or something it lies in satisfies ``hit``. Nodes are in preorder with ord and last; gaps are fine.

    Sub-trees nest, so a node lies in one of the hits exactly when the farthest end of the hits so far reaches it.
    """
    ends = F.transform(nodes, lambda n: F.when(F.coalesce(hit(n), F.lit(False)), n["last"]).otherwise(NONE))
    return let(running_max(ends), lambda far: F.zip_with(nodes, far, lambda n, e: e >= n["ord"]))


def lies_in(nodes: Column, flags: Column) -> Column:
    """array<boolean>: whether a node lies below one whose flag (array<boolean> by position) is set."""
    ends = F.zip_with(nodes, flags, lambda n, f: F.when(f, n["last"]).otherwise(NONE))
    shifted = F.concat(F.array(F.lit(NONE)), ends)
    return let(running_max(shifted), lambda far: F.transform(nodes, lambda n, i: F.get(far, i) >= n["ord"]))
