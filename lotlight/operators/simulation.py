"""Replay of guests' requests over days held out: the model at several confidences, and whoever takes what is free now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlight.operators import availability as av
from lotlight.operators import intervals
from lotlight.operators.learning import draw


def naive(requests: DataFrame, live: DataFrame, seed: int = 0) -> DataFrame:
    """request, day, spot_id: each request of a day, in order, takes a spot free now that no earlier one of the day has taken, by lot.

    `requests` has request, day, start, end; `live` request, spot_id, occupied. A fold over one day's requests and free spots.
    """
    free = live.where(F.col("occupied") == 0).select("request", "spot_id").withColumn("lot", draw("request", "spot_id", seed=seed))
    joined = requests.select("request", "day", "start", "end").join(free, "request")

    def fold(pdf):
        import pandas as pd

        taken, rows = set(), []
        for request, own in pdf.sort_values(["start", "request", "lot", "spot_id"]).groupby("request", sort=False):
            spot = next((s for s in own.spot_id if s not in taken), None)
            if spot is not None:
                taken.add(spot)
                rows.append((request, own.day.iloc[0], spot, own.start.iloc[0], own.end.iloc[0]))
        return pd.DataFrame(rows, columns=["request", "day", "spot_id", "start", "end"])

    kind = dict(requests.dtypes)
    return joined.groupBy("day").applyInPandas(fold, f"request {kind['request']}, day {kind['day']}, spot_id string, start timestamp_ntz, end timestamp_ntz")


def sweep(ranked: DataFrame, live: DataFrame, truth: DataFrame, thresholds: list[float], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Bookings (arm, request, spot_id, start, end, stayed_free) at each confidence and by the naive arm; and arm, n_booked, n_free, n_known, rate.

    `ranked` is what `candidates` gives, with day. Each arm allots its day's requests one after another.
    """
    arms = ranked.withColumn("arm", F.explode(F.array(*map(F.lit, thresholds))))
    arms = arms.withColumn("eligible", ~F.col("booked") & ~F.col("occupied_now") & F.coalesce(F.col("confidence") >= F.col("arm"), F.lit(False)))
    arms = arms.withColumn("arm", F.col("arm").cast("string")).withColumn("group", F.concat_ws("|", "arm", "day"))
    model = av.allocate(arms, "group").select(F.substring_index("group", "|", 1).alias("arm"), "request", "spot_id", "start", "end")
    asked = ranked.select("request", "day", "start", "end").distinct()
    plain = naive(asked, live, seed).select(F.lit("free now").alias("arm"), "request", "spot_id", "start", "end")
    every = model.unionByName(plain).withColumn("booking", F.concat_ws("|", "arm", "request"))
    out = intervals.stayed_free(every, truth).drop("booking")
    known = F.count("stayed_free")
    total = out.groupBy("arm").agg(F.count("*").alias("n_booked"), F.count_if("stayed_free").alias("n_free"), known.alias("n_known"), F.avg(F.col("stayed_free").cast("int")).alias("rate"))
    return out, total


def replay(log: DataFrame, test_days: int, hours: int, minutes: int, thresholds: list[float], first: int = 7, last: int = 15, close: int = 18) -> tuple[DataFrame, DataFrame]:
    """The demo: history from the days before the last `test_days`; a request at each hour of these from `first` to `last` that ends by `close`.

    `log` has ts, spot_id, occupied (as seen) and truth (-1 where unknown). What is seen now is the frame nearest to the start.
    """
    days = log.select(F.to_date("ts").alias("day")).distinct()
    numbered = days.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("day"))))  # a row for each day
    held = numbered.where(F.col("k") <= test_days).select("day")
    history = log.join(F.broadcast(numbered.where(F.col("k") > test_days).select("day")), F.to_date("ts") == F.col("day")).drop("day")  # days
    hour = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("h")
    asked = held.select("day", hour).where(F.col("h") + hours <= close)
    begin = F.to_timestamp_ntz(F.col("day").cast("string")) + F.make_dt_interval(hours=F.col("h"))
    asked = asked.select((F.unix_date("day") * 100 + F.col("h")).alias("request"), "day", begin.alias("start")).withColumn("end", F.col("start") + F.make_dt_interval(hours=F.lit(hours)))
    near = intervals.asof(asked, log.select("ts").distinct())
    live = near.join(log.select(F.col("ts").alias("frame_ts"), "spot_id", "occupied"), "frame_ts").select("request", "spot_id", "occupied")
    none = log.sparkSession.createDataFrame([], "spot_id string, start timestamp_ntz, end timestamp_ntz")
    ranked = av.candidates(av.slot_grid(history, minutes), asked, minutes, none, none, live, min(thresholds), buffer_minutes=0).join(asked.select("request", "day"), "request")
    return sweep(ranked, live, log.select("spot_id", "ts", "truth"), thresholds)
