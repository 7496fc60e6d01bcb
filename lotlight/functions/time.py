"""Calendar and slot expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_slot(minutes: int) -> int:
    if minutes <= 0 or 1440 % minutes:
        raise ValueError("a slot's minutes must divide a day's 1440")
    return minutes


def slot_of(ts: Column, minutes: int) -> Column:
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / check_slot(minutes)).cast("int")


def day_type(day: Column, mode: str = "weekday/weekend") -> Column:
    """The name of the day in mode "dow"; weekday or weekend in any other."""
    return F.date_format(day, "EEEE") if mode == "dow" else F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")


def window_cells(start: Column, end: Column, minutes: int) -> Column:
    """Array of (day_offset, slot) that [start, end) touches; empty for an empty window."""
    day = F.date_trunc("day", start).cast("timestamp_ntz")
    first = day + F.make_dt_interval(mins=slot_of(start, minutes) * minutes)
    steps = F.when(first < end, F.sequence(first, end - F.expr("INTERVAL '0.000001' SECOND"), F.expr(f"INTERVAL {minutes} MINUTE")))
    cell = lambda t: F.struct(F.datediff(t, day).alias("day_offset"), slot_of(t, minutes).alias("slot"))
    return F.coalesce(F.transform(steps, cell), F.array().cast("array<struct<day_offset:int,slot:int>>"))
