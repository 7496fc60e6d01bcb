"""The reference concepts over the driver's tables, for Spark and as SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.operators.shared import shared_folder  # noqa: F401

SLOT = 120


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("spot_id", F.concat(F.lit("U"), F.col("user_id") % 8))


def log(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "ts", "spot_id", (F.col("value") > 120).cast("int").alias("occupied"), F.col("value").alias("score"))


def spans(spark: SparkSession, d: str, kind: str) -> DataFrame:
    end = F.col("ts") + F.make_dt_interval(hours=(1 + F.col("event_id") % 4).cast("int"))
    return events(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias("request"), "spot_id", F.col("ts").alias("start"), end.alias("end"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d, "signup")


def bookings(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d, "purchase").withColumnRenamed("request", "booking")


def declarations(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d, "view").drop("request")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """frame, n (a total order in the frame), box, score."""
    x1, y1 = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    b = F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 5 + F.col("l_quantity")).cast("double").alias("x2"), (y1 + 5 + 5 * F.col("l_linenumber")).cast("double").alias("y2"))
    from pyspark.sql import Window

    every = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), *every)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.row_number().over(order).alias("n"), b.alias("box"), F.col("l_extendedprice").alias("score"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"))


WIDTH, HEIGHT, CAMERAS = 112, 92, 100


def camera_frames(spark: SparkSession, d: str) -> DataFrame:
    """camera, t, ts, n, x1 to y2: every order is a frame of one of a hundred cameras, a quarter of an hour after the camera's one before."""
    b = boxes(spark, d)
    t = (F.col("frame") / CAMERAS).cast("int")
    return b.select((F.col("frame") % CAMERAS).cast("int").alias("camera"), t.alias("t"), F.timestamp_seconds(t * 900).cast("timestamp_ntz").alias("ts"), "n", "box.*")


COLORS = np.array([*[(100 + k,) * 3 for k in range(12)], (200, 60, 60), (30, 30, 30)], np.uint8)


def picture(key: list, boxes, seed: int = 0) -> np.ndarray:
    """What `drawn` draws: an RGB array."""
    rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
    img = rng.integers(0, 12, (HEIGHT // 4, WIDTH // 4), np.uint8).repeat(4, 0).repeat(4, 1)
    for one in boxes:
        x1, y1, x2, y2 = (int(v) for v in one)
        img[y1:y2, x1:x2] = 12
        img[y1 + 3 : y2 - 3, x1 + 3 : x2 - 3] = 13
    return COLORS.take(img, 0)


def drawn(frames: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """`keys`, pixels, height, width: boxes (x1 to y2, in order of n) as ringed red rectangles on a gray ground that differs a little from frame to frame."""
    own = frames.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", F.array("x1", "y1", "x2", "y2").alias("b")))).alias("boxes"))  # one frame's boxes
    kinds = dict(own.dtypes)

    def run(batches):
        import pandas as pd

        for pdf in (whole[at : at + 256] for whole in batches for at in range(0, len(whole), 256)):
            made = [picture([r[k] for k in keys], [one["b"] for one in r["boxes"]], seed).tobytes() for r in pdf.to_dict("records")]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "pixels": made, "height": HEIGHT, "width": WIDTH})

    return own.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pixels binary, height int, width int")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), (F.col("n_chars") > 500).cast("int").alias("pred"), F.col("n_chars").cast("double").alias("score"), F.col("source").alias("grp"), "lang")


EVENTS = "ev AS (SELECT *, 'U' || CAST(user_id % 8 AS VARCHAR) AS spot_id FROM events)"
LOG = EVENTS + ", obs AS (SELECT event_id, ts, spot_id, CAST(value > 120 AS INTEGER) AS occupied, value AS score FROM ev)"
GRID = LOG + f", grid AS (SELECT spot_id, CAST(ts AS DATE) AS date, CAST((hour(ts) * 60 + minute(ts)) // {SLOT} AS INTEGER) AS slot, max(occupied) AS occ FROM obs GROUP BY ALL)"
SPANS = ", ".join(
    f"{name} AS (SELECT event_id AS id, spot_id, ts AS s, ts + to_hours(CAST(1 + event_id % 4 AS INTEGER)) AS e FROM ev WHERE event_type = '{kind}')"
    for name, kind in (("req", "signup"), ("book", "purchase"), ("decl", "view"))
)
BOXES = """bx AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n, CAST(l_partkey % 50 AS DOUBLE) AS x1, CAST(l_suppkey % 50 AS DOUBLE) AS y1,
  l_partkey % 50 + 5 + l_quantity AS x2, CAST(l_suppkey % 50 + 5 + 5 * l_linenumber AS DOUBLE) AS y2, l_extendedprice AS score, l_suppkey AS supp, l_returnflag AS flag FROM lineitem)"""


def iou_sql(a: str, b: str) -> str:
    inter = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)"
    return f"({inter} / greatest({size(a)} + {size(b)} - {inter}, 1e-9))"


PRED = "pr AS (SELECT l.doc_id, quality AS truth, CAST(n_chars > 500 AS INTEGER) AS pred, CAST(n_chars AS DOUBLE) AS score, source AS grp, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
