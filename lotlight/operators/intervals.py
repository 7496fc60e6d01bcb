"""As-of and range joins on time, without a limit on how far back they look.

The last observation before a time, whether a booking overlaps and whether a
declaration contains are one operation: the greatest value among the events of a
key up to a time (`latest`). It runs over buckets of time, so that a key's history
is cut into tasks; what lies before a bucket comes from one row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlight.operators.grouping import plain_unions

HOURS = 6


def micros(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def latest(asks: DataFrame, at: Column, events: DataFrame, when: Column, value: Column, key: str | None = None, name: str = "latest", strict: bool = False, hours: int = HOURS) -> DataFrame:
    """`asks` with `name`: the greatest `value` (never null) of the events of its key whose `when` is at most `at`, or, if strict, less.

    `at` and `when` are whole numbers in microseconds. Null without such an event.
    """
    plain_unions(asks.sparkSession)
    width = hours * 3_600_000_000
    own = [F.col(key).alias("_k")] if key else [F.lit(0).alias("_k")]
    cell = lambda c: F.floor(c / width)
    row = F.struct(*[F.col(f"`{c}`") for c in asks.columns])
    a = asks.select(*own, at.alias("_at"), row.alias("_row"))
    e = events.select(*own, when.alias("_at"), value.alias("_v"))
    kind = e.schema["_v"].dataType
    both = a.select("_k", "_at", "_row", F.lit(None).cast(kind).alias("_v")).unionByName(e.select("_k", "_at", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_v"))
    both = both.withColumn("_b", cell(F.col("_at")))
    events_first = F.col("_row").isNotNull() if not strict else F.col("_row").isNull()
    inside = Window.partitionBy("_k", "_b").orderBy("_at", events_first).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.max("_v").over(inside)).where(F.col("_row").isNotNull())
    cells = both.groupBy("_k", "_b").agg(F.max("_v").alias("_v"))  # one row for each key and bucket
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_k", "_b", F.max("_v").over(before).alias("_before"))
    return seen.join(carried, ["_k", "_b"], "left").select("_row.*", F.greatest("_in", "_before").alias(name))


def asof(requests: DataFrame, frames: DataFrame, direction: str = "nearest") -> DataFrame:
    """request, frame_ts: the frame nearest in time to `start` (the earlier of two as near), or the last not after it; null without one."""
    at, ts = micros("start"), micros("ts")
    found = latest(requests.select("request", "start"), at, frames.select("ts"), ts, F.struct(ts.alias("t"), F.col("ts").alias("frame")), name="prev")
    if direction == "backward":
        return found.select("request", F.col("prev.frame").alias("frame_ts"))
    found = latest(found, -at, frames.select("ts"), -ts, F.struct((-ts).alias("t"), F.col("ts").alias("frame")), name="next")
    nearer = F.col("prev").isNull() | (-F.col("next.t") - at < at - F.col("prev.t"))
    return found.select("request", F.when(nearer, F.col("next.frame")).otherwise(F.col("prev.frame")).alias("frame_ts"))


def live_status(requests: DataFrame, log: DataFrame) -> DataFrame:
    """request, spot_id, occupied: the last observation of each spot at or before the request's start, occupied if two of one
    time differ; never seen: 0. A row for every request and spot, like the candidates it goes into."""
    seen = log.where(F.col("spot_id").isNotNull() & F.col("occupied").isNotNull()).select("spot_id", "ts", "occupied")
    asks = requests.select("request", "start").crossJoin(seen.select("spot_id").distinct())
    found = latest(asks, micros("start"), seen, micros("ts"), F.struct(micros("ts").alias("t"), F.col("occupied").alias("now")), "spot_id")
    return found.select("request", "spot_id", F.coalesce("latest.now", F.lit(0)).alias("occupied"))


def stayed_free(bookings: DataFrame, truth: DataFrame, hours: int = HOURS) -> DataFrame:
    """`bookings` with stayed_free: whether all labelled frames of [start, end) on the spot are free; null without one. Needs `booking`.

    A booking meets the frames of its spot in the buckets of time that it touches.
    """
    width = hours * 3_600_000_000
    t = truth.where("truth >= 0").select("spot_id", micros("ts").alias("_t"), "truth", F.floor(micros("ts") / width).alias("_b"))
    cells = F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))
    asked = bookings.select("booking", "spot_id", micros("start").alias("_from"), micros("end").alias("_to")).where("_from < _to").withColumn("_b", F.explode(cells))
    met = asked.join(t, ["spot_id", "_b"]).where((F.col("_from") <= F.col("_t")) & (F.col("_t") < F.col("_to")))
    met = met.groupBy("booking").agg(F.bool_and(F.col("truth") == 0).alias("stayed_free"))
    return bookings.join(met, "booking", "left")
