"""Time columns as epoch milliseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp (floored)."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    in_day = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1000
    second_ms = F.floor(F.expr("0") + F.date_part(F.lit("SECOND"), ts) * 1000)
    return days * DAY_MS + in_day + second_ms.cast("long")


def clock_text(ms: Column) -> Column:
    """``HH:MM:SS.mmm`` in UTC."""
    in_day = F.pmod(ms, F.lit(DAY_MS))

    def pad(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    return F.concat(
        pad(F.floor(in_day / 3_600_000), 2), F.lit(":"),
        pad(F.floor(F.pmod(in_day, F.lit(3_600_000)) / 60_000), 2), F.lit(":"),
        pad(F.floor(F.pmod(in_day, F.lit(60_000)) / 1000), 2), F.lit("."),
        pad(F.pmod(in_day, F.lit(1000)), 3),
    )


def iso_text(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))
    return F.concat(day.cast("string"), F.lit("T"), clock_text(ms), F.lit("Z"))
