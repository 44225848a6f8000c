"""Name a column once, use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Array lambdas evaluate everything they mention for each element, and the optimizer may
    copy an expression wherever its column is used; binding it first avoids both.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
