"""Expressions over boxes (structs or columns x1, y1, x2, y2) and quadrilaterals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs, with a floor of 1e-9 under the union."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-9))


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])


def order_quad(points: Column) -> Column:
    """Corners of a quadrilateral as top left, top right, bottom right, bottom left; the first of equals."""
    def corner(key, sign: int) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct((key(p) * sign).alias("k"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(corner(total, 1), corner(slope, 1), corner(total, -1), corner(slope, -1))


def padded(b: Column, share: float, width: Column, height: Column) -> Column:
    """The box grown by a share of its sides, within the frame."""
    px, py = (b["x2"] - b["x1"]) * share, (b["y2"] - b["y1"]) * share
    return F.struct(
        F.greatest(F.lit(0.0), b["x1"] - px).alias("x1"), F.greatest(F.lit(0.0), b["y1"] - py).alias("y1"),
        F.least(width, b["x2"] + px).alias("x2"), F.least(height, b["y2"] + py).alias("y2"),
    )


def bounds(points: Column) -> Column:
    axis = lambda c: F.transform(points, lambda p: p[c])
    return F.struct(F.array_min(axis("x")).alias("x1"), F.array_min(axis("y")).alias("y1"), F.array_max(axis("x")).alias("x2"), F.array_max(axis("y")).alias("y2"))


def scaled(points: Column, sx: Column, sy: Column) -> Column:
    """Points scaled; unchanged where a factor is unknown."""
    return F.transform(points, lambda p: F.struct((p["x"] * F.coalesce(sx, F.lit(1.0))).alias("x"), (p["y"] * F.coalesce(sy, F.lit(1.0))).alias("y")))
