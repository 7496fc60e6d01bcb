"""Frames to an occupancy log: each frame's spots are scaled, cut out upright, described and classified, in batch or as a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlight.functions import boxes as bx
from lotlight.operators import images
from lotlight.operators.detector import with_features


def with_spots(frames: DataFrame, spots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`frames` with spots: id and corners (eight numbers, in the frame's pixels) of those of its camera, or of all.

    A frame's pixels stay in one row. Spots are id, polygon, width and height (of the frame they were drawn on; null, or without
    these columns, as now).
    """
    by = by or []
    for side in ("width", "height"):
        if side not in spots.columns:
            spots = spots.withColumn(side, F.lit(None).cast("int"))
    own = spots.groupBy(*by).agg(F.collect_list(F.struct("id", "polygon", "width", "height")).alias("spots"))  # a camera's spots
    df = frames.join(own, by) if by else frames.crossJoin(own)  # one row
    scale = lambda side, s: F.col(side) / s[side]
    points = lambda s: bx.scaled(s["polygon"], scale("width", s), scale("height", s))
    corners = lambda s: F.flatten(F.transform(points(s), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    return df.withColumn("spots", F.transform("spots", lambda s: F.struct(s["id"].alias("id"), corners(s).alias("corners"))))


def spot_patches(frames: DataFrame, spots: DataFrame, keep: dict[str, Column], by: list[str] | None = None, size: tuple[int, int] = (64, 64)) -> DataFrame:
    """The columns of `keep`, spot_id, pixels, height, width: an upright patch of every frame and spot."""
    df = with_spots(frames, spots, by).select(*[c.alias(name) for name, c in keep.items()], "pixels", "height", "width", "spots")
    kinds, names = dict(df.dtypes), list(keep)

    def make(frame: np.ndarray, row: dict) -> list[tuple]:
        cut = lambda s: images.warp(frame, np.reshape(s["corners"], (4, 2)), *size).tobytes()
        return [(*[row[k] for k in names], s["id"], cut(s), size[1], size[0]) for s in row["spots"]]

    return images.frame_rows(df, make, ", ".join(f"`{k}` {kinds[k]}" for k in names) + ", spot_id string, pixels binary, height int, width int")


def classify(frames: DataFrame, spots: DataFrame, scorer, by: list[str] | None = None, threshold: float = 0.5, config: images.FeatureConfig = images.FeatureConfig()) -> DataFrame:
    """ts, spot_id, occupied, score of every frame (ts, pixels, height, width) and spot. `scorer` adds score to rows with features."""
    patches = spot_patches(frames, spots, {"ts": F.col("ts")}, by, config.patch_size)
    scored = scorer(with_features(images.feature_frame(patches, config).drop("pixels"), config))
    return scored.select("ts", "spot_id", (F.col("score") >= threshold).cast("int").alias("occupied"), "score")


def status_lines(log: DataFrame) -> DataFrame:
    """ts, line: how many spots are free, and each one's mark, X or a dot."""
    marks = F.array_sort(F.collect_list(F.struct("spot_id", "occupied")))
    seen = log.groupBy("ts").agg(F.count_if(F.col("occupied") == 0).alias("free"), F.count("*").alias("n"), marks.alias("m"))  # a frame's spots
    each = F.transform("m", lambda x: F.concat(x["spot_id"], F.lit(":"), F.when(x["occupied"] == 0, ".").otherwise("X")))
    return seen.select("ts", F.concat(F.col("ts").cast("string"), F.lit("  free="), F.col("free"), F.lit("/"), F.col("n"), F.lit("  "), F.array_join(each, " ")).alias("line"))
