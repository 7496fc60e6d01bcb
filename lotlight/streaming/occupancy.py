"""The live path: the batch definitions over streams, and the two keyed states (smoothing, bookings)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slot_stream(log: DataFrame, minutes: int, delay: str = "1 hour") -> DataFrame:
    """spot_id, start, occ of each closed slot of a stream with ts, spot_id, occupied."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("spot_id", F.window("ts", f"{minutes} minutes")).agg(F.max("occupied").alias("occ")).select("spot_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "occ")


def smooth_stream(log: DataFrame, window: int) -> DataFrame:
    """event_id, spot_id, smoothed: the majority of each spot's last `window` values, which are its state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        every = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for v in every.occupied:
            last = [*last, int(v)][-window:]
            out.append(int(2 * sum(last) > len(last)))
        state.update((last,))
        yield pd.DataFrame({"event_id": every.event_id, "spot_id": key[0], "smoothed": out})

    return log.groupBy("spot_id").applyInPandasWithState(run, "event_id long, spot_id string, smoothed int", "last array<int>", "append", "NoTimeout")


def booking_stream(asked: DataFrame, keep: str = "30 days") -> DataFrame:
    """request, spot_id, booked: requests (start, end) in order; a spot's bookings are its state, sorted, so that one lookup tells.

    Bookings that ended `keep` before the latest start seen on the spot are forgotten; none that begins earlier is expected.
    """
    span = pd.Timedelta(keep).value

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, ends = map(list, state.get) if state.exists else ([], [])
        every = pd.concat(list(parts)).sort_values(["start", "request"])
        out = []
        for r in every.itertuples():
            a, b = r.start.value, r.end.value
            k = bisect_left(starts, b)  # bookings don't overlap: of those that start before the end, the last ends last
            ok = not (k and ends[k - 1] > a)
            if ok:
                starts.insert(k, a)
                ends.insert(k, b)
            out.append(ok)
        gone = bisect_left(ends, max(every.start).value - span)
        state.update((starts[gone:], ends[gone:]))
        yield pd.DataFrame({"request": every.request, "spot_id": key[0], "booked": out})

    return asked.groupBy("spot_id").applyInPandasWithState(run, "request long, spot_id string, booked boolean", "starts array<long>, ends array<long>", "append", "NoTimeout")


def image_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path, ts (in the name, or when the file was changed), pixels, height, width of images as they come."""
    from lotlight.sources import annotations

    kind = spark.read.format("image").load(folder).schema
    return annotations.with_times(annotations.decoded(spark.readStream.format("image").schema(kind).load(folder)))


def run_once(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """All that is there, to Parquet under `where` with its checkpoint beside it; a second call goes on from there."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).format("parquet").start(f"{where}/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
