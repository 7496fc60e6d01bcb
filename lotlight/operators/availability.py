"""Occupancy history, the chance that a bay stays free, and candidates for a request.

The grid stays long (spot_id, date, slot, occ): an unobserved cell is a missing row.
All windows are answered set-wise: a request explodes into its cells, which meet the
grid in one equi-join on spot, day and slot.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlight.functions.time import check_slot, day_type, slot_of, window_cells
from lotlight.operators.intervals import latest, micros

MAX_UNSEEN = 0.25


def project_log(log: DataFrame, minutes: int) -> DataFrame:
    return log.select("ts", "spot_id", "occupied", F.to_date("ts").alias("date"), slot_of(F.col("ts"), minutes).alias("slot"))


def slot_grid(log: DataFrame, minutes: int) -> DataFrame:
    """spot_id, date, slot, occ: a slot is occupied if it was at any observation."""
    return project_log(log, minutes).groupBy("spot_id", "date", "slot").agg(F.max("occupied").alias("occ"))


def profile(grid: DataFrame, minutes: int, mode: str = "weekday/weekend") -> DataFrame:
    """spot_id, day_type, slot, p_free, n_days: a row for every slot of each pair of spot and day type that has a date."""
    typed = grid.withColumn("day_type", day_type(F.col("date"), mode))
    slots = typed.select("spot_id", "day_type").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(1440 // check_slot(minutes) - 1))))
    seen = typed.groupBy("spot_id", "day_type", "slot").agg((1 - F.avg("occ")).alias("p_free"), F.count("occ").alias("n_days"))
    return slots.join(seen, ["spot_id", "day_type", "slot"], "left").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))


def shapes(windows: DataFrame, minutes: int, mode: str = "weekday/weekend") -> DataFrame:
    """`windows` (request, start, end) with kind, cells and shape: what alone decides the answer, shared by many requests."""
    df = windows.withColumns({"kind": day_type(F.to_date("start"), mode), "cells": window_cells(F.col("start"), F.col("end"), minutes)})
    return df.withColumn("shape", F.to_json(F.struct("kind", "cells")))


def cells_of_days(grid: DataFrame, shaped: DataFrame, mode: str = "weekday/weekend") -> DataFrame:
    """shape, spot_id, date, day_offset, slot, occ: what the grid has for each shape on each day of its kind.

    A null offset stands for an empty window.
    """
    days = grid.select("spot_id", "date").distinct().withColumn("kind", day_type(F.col("date"), mode))
    asked = shaped.select("shape", "kind", "cells").dropDuplicates(["shape"]).select("shape", "kind", F.explode_outer("cells").alias("cell"))
    asked = asked.select("shape", "kind", "cell.day_offset", "cell.slot")
    wanted = days.join(asked, "kind").withColumn("on", F.date_add("date", F.coalesce("day_offset", F.lit(0))))
    found = grid.select("spot_id", F.col("date").alias("on"), "slot", "occ")
    return wanted.join(found, ["spot_id", "on", "slot"], "left").select("shape", "spot_id", "date", "day_offset", "slot", "occ")


def window_free_prob(grid: DataFrame, windows: DataFrame, minutes: int, mode: str = "weekday/weekend") -> DataFrame:
    """request, spot_id, p_free, n_days, free_days for every window and every spot of the grid.

    A day counts unless more than a quarter of the window's cells are unseen; it
    is free if no seen cell is occupied. Days are those of the start's type. Windows
    that touch the same cells on the same type of day are worked out once.
    """
    shaped = shapes(windows, minutes, mode)
    days = cells_of_days(grid, shaped, mode).groupBy("shape", "spot_id", "date").agg(
        F.count("slot").alias("cells"), F.count("occ").alias("seen"), F.coalesce(F.max("occ"), F.lit(0)).alias("worst")
    )
    kept = days.where(F.col("cells") - F.col("seen") <= MAX_UNSEEN * F.col("cells"))
    counted = kept.groupBy("shape", "spot_id").agg(F.count("*").alias("n"), F.count_if(F.col("worst") == 0).alias("ok"))
    # The result has a row for every pair of request and spot; so has this product.
    every = shaped.select("request", "shape").crossJoin(grid.select("spot_id").distinct())
    n, ok = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("ok", F.lit(0).cast("long"))
    out = every.join(counted, ["shape", "spot_id"], "left")
    return out.select("request", "spot_id", F.when(n > 0, (ok + 0.5) / (n + 1)).alias("p_free"), n.alias("n_days"), ok.alias("free_days"))


def _overlapped(asks: DataFrame, bookings: DataFrame, name: str) -> DataFrame:
    """`asks` (spot_id, start, end) with whether a booking of the spot overlaps, half-open: of those that start before the end, the last to end ends after the start."""
    found = latest(asks, micros("end"), bookings, micros("start"), micros("end"), "spot_id", "_until", strict=True)
    return found.withColumn(name, F.coalesce(F.col("_until") > micros("start"), F.lit(False))).drop("_until")


def _contained(asks: DataFrame, declarations: DataFrame, name: str) -> DataFrame:
    """`asks` with whether a declaration of the spot contains them, ends included."""
    found = latest(asks, micros("start"), declarations, micros("start"), micros("end"), "spot_id", "_until")
    return found.withColumn(name, F.coalesce(F.col("_until") >= micros("end"), F.lit(False))).drop("_until")


def booked(requests: DataFrame, bookings: DataFrame) -> DataFrame:
    """Requests (spot_id, start, end) that a booking overlaps, half-open, on the same spot."""
    return _overlapped(requests, bookings, "_hit").where("_hit").drop("_hit")


def declared(requests: DataFrame, declarations: DataFrame) -> DataFrame:
    """Requests that a declaration of the same spot contains, ends included."""
    return _contained(requests, declarations, "_hit").where("_hit").drop("_hit")


def confidence(min_days: int) -> Column:
    return F.when(F.col("declared_away"), F.lit(1.0)).when(F.col("n_days") < min_days, F.lit(0.0)).otherwise(F.col("p_free"))


def candidates(
    grid: DataFrame, requests: DataFrame, minutes: int, bookings: DataFrame, declarations: DataFrame, live: DataFrame | None = None,
    min_confidence: float = 0.8, buffer_minutes: int = 30, min_days: int = 3, mode: str = "weekday/weekend",
) -> DataFrame:
    """Every spot for every request (request, start, end), with its probability, flags, confidence, and rank by request.

    The buffer lengthens the window of the probability alone. `live` has request,
    spot_id, occupied. Rank: eligible first, then confidence, days, and spot_id.
    """
    longer = requests.select("request", "start", (F.col("end") + F.make_dt_interval(mins=F.lit(buffer_minutes))).alias("end"))
    df = window_free_prob(grid, longer, minutes, mode).join(requests.select("request", "start", "end"), "request")
    df = _overlapped(_contained(df, declarations, "declared_away"), bookings, "booked")
    if live is None:
        df = df.withColumn("occupied_now", F.lit(False))
    else:
        df = df.join(live.select("request", "spot_id", (F.col("occupied") != 0).alias("occupied_now")), ["request", "spot_id"], "left")
    df = df.withColumn("occupied_now", F.coalesce("occupied_now", F.lit(False)))
    df = df.withColumn("confidence", confidence(min_days))
    df = df.withColumn("eligible", ~F.col("booked") & ~F.col("occupied_now") & F.coalesce(F.col("confidence") >= min_confidence, F.lit(False)))
    order = Window.partitionBy("request").orderBy(F.desc("eligible"), F.desc_nulls_last("confidence"), F.desc("n_days"), "spot_id")
    return df.withColumn("rank", F.row_number().over(order))


def top_candidate(ranked: DataFrame) -> DataFrame:
    return ranked.where((F.col("rank") == 1) & F.col("eligible"))


def allocate(ranked: DataFrame, by: str = "day") -> DataFrame:
    """Bookings made in order of `start` and request: each takes its best eligible spot that no earlier one of its group overlaps.

    Probabilities depend on the request alone and are set-wise already; only the
    conflicts are folded, one group (a site's day) at a time.
    """
    def fold(pdf):
        taken: dict[str, list] = {}
        rows = []
        for request, own in pdf.sort_values(["start", "request", "rank"]).groupby("request", sort=False):
            for r in own.itertuples():
                spans = taken.setdefault(r.spot_id, [])
                if r.eligible and not any(a < r.end and r.start < b for a, b in spans):
                    spans.append((r.start, r.end))
                    rows.append((getattr(r, by), request, r.spot_id, r.start, r.end, r.confidence))
                    break
        import pandas as pd

        return pd.DataFrame(rows, columns=[by, "request", "spot_id", "start", "end", "confidence"])

    kind = dict(ranked.dtypes)
    schema = f"`{by}` {kind[by]}, request {kind['request']}, spot_id string, start timestamp_ntz, end timestamp_ntz, confidence double"
    return ranked.where("eligible").select(by, "request", "spot_id", "start", "end", "confidence", "eligible", "rank").groupBy(by).applyInPandas(fold, schema)


def one_window(spark, start: datetime, end: datetime, request: int = 0) -> DataFrame:
    return spark.createDataFrame([(request, start, end)], "request int, start timestamp_ntz, end timestamp_ntz")
