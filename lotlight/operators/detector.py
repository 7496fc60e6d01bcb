"""Two-stage window detector as steps over DataFrames of frames.

A linear model on HOG blocks scores every window of a frame; the best go on with
their features to a classifier of Spark ML; what it accepts is suppressed and voted.
Frames are path, pixels, height, width; scenes are frames with arrays of boxes
(cars, negatives, ignore, each box an array of four numbers) and random_negatives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlight.functions import boxes as bx
from lotlight.operators import box_algorithms as ba
from lotlight.operators import images, linear, metrics
from lotlight.operators.learning import Fitted

BOX = ", ".join(f"{c} double" for c in ba.COLUMNS)
PATCH = "path string, n int, label int, pixels binary, height int, width int"


@dataclass(frozen=True)
class DetectorConfig:
    windows: tuple[tuple[int, int], ...] = ((64, 64),)
    step: int = 1
    recall: float = 0.99
    max_windows: int | None = 400  # of a frame; None: all
    threshold: float = 0.5
    nms_iou: float = 0.3


@dataclass(frozen=True)
class HogScorer:
    """Weights by block, for values as they are, offset and threshold."""

    config: images.FeatureConfig
    weights: np.ndarray
    offset: float
    threshold: float

    def score(self, frame: np.ndarray, window: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Boxes and scores of all windows of one size; none if the frame is smaller than a window."""
        patch, c = np.array(self.config.patch_size), self.config
        scale = patch / np.array(window)
        width, height = np.rint(scale * frame.shape[1::-1]).astype(int).tolist()
        if width < patch[0] or height < patch[1]:
            return np.empty((0, 4)), np.empty(0)
        blocks = images.hog_blocks(images.gray(images.resize(frame, width, height)), c)
        view = np.lib.stride_tricks.sliding_window_view(blocks, self.weights.shape[:2], axis=(0, 1))
        scores = np.einsum("yxkij,ijk->yx", view, self.weights, optimize=True) + self.offset
        corners = np.argwhere(np.ones(scores.shape, bool))[:, ::-1] * c.cell / scale
        return np.hstack([corners, corners + np.array(window)]), scores.ravel()

    def best(self, frame: np.ndarray, d: DetectorConfig) -> tuple[np.ndarray, np.ndarray]:
        """The `max_windows` best windows above the threshold, or all of them, of every `step`-th of each size."""
        found = [self.score(frame, w) for w in d.windows]
        boxes, scores = np.vstack([b[:: d.step] for b, _ in found]), np.concatenate([s[:: d.step] for _, s in found])
        order = np.argsort(-scores, kind="stable")
        order = order[scores[order] >= self.threshold][: d.max_windows]
        return boxes[order], scores[order]


def fit_scorer(patches: DataFrame, recall: float = 0.99, ridge: float = 10.0, config: images.FeatureConfig = images.FeatureConfig()) -> HogScorer:
    """From patches (label, pixels, height, width; or label, hog): logistic regression on standardised HOG values with balanced classes; the
    threshold keeps `recall` of the cars. Of patches with pixels only the cells are kept, a third of the values; each pass makes their blocks anew."""
    made = "hog" in patches.columns
    rows = patches.select("label", "hog") if made else cells_of(patches.select("label", "pixels", "height", "width"), config).persist()
    down, across = (s // config.cell for s in reversed(config.patch_size))

    def make(columns: list) -> np.ndarray:
        x = linear.matrix(columns)
        return x if made else images.normed_blocks(x.reshape(len(x), down, across, -1), config).reshape(len(x), -1)

    line = linear.fit(rows, ridge, True, make)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"s": line.margins(make(b.columns[1:]).astype(float)) if b.num_rows else np.empty(0)})

    threshold = rows.where("label = 1").mapInArrow(run, "s double").agg(F.percentile("s", 1 - recall)).first()[0]
    if not made:
        rows.unpersist()
    return HogScorer(config, line.weights.reshape(down - config.block + 1, across - config.block + 1, -1), line.offset, float(threshold))


def cells_of(patches: DataFrame, config: images.FeatureConfig) -> DataFrame:
    """label, cells (the HOG cells' values) of patches (label, pixels, height, width)."""
    images.small_batches(patches.sparkSession)
    w, h = config.patch_size

    def run(batches):
        for whole in batches:
            for b in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                cut = [images.resize(np.frombuffer(p.as_buffer(), np.uint8).reshape(y.as_py(), x.as_py(), 3), w, h) for p, y, x in zip(*b.columns[1:])]
                made = images.hog_cells(images.gray(np.stack(cut)), config).astype(np.float32).reshape(len(cut), -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * np.int32(made.shape[1]), made.ravel())], ["label", "cells"])

    return patches.mapInArrow(run, f"label {dict(patches.dtypes)['label']}, cells array<float>")


def with_features(df: DataFrame, config: images.FeatureConfig) -> DataFrame:
    """The blocks' arrays as one vector, `features`."""
    return df.withColumn("features", array_to_vector(F.concat(*[F.col(b).cast("array<double>") for b in config.blocks]))).drop(*config.blocks)


def proposals(frames: DataFrame, scorer: HogScorer, d: DetectorConfig, config: images.FeatureConfig = images.FeatureConfig(), line: linear.Line | None = None) -> DataFrame:
    """path, n, x1 to y2, first (the first stage's score), features of each frame's best windows; with a `line`, its chance of a car as
    score in place of the features, which then leave no task."""
    blocks = "score double" if line else ", ".join(f"{b} array<float>" for b in config.blocks)

    def make(frame: np.ndarray, row: dict) -> list[tuple]:
        boxes, scores = scorer.best(frame, d)
        parts = images.cut(frame, np.trunc(boxes), 1)
        kept = [k for k, p in enumerate(parts) if p is not None]
        made = images.extract_all([parts[k] for k in kept], config)
        if line:
            margins = line.margins(np.hstack([made[b] for b in config.blocks]).astype(float)) if kept else []
            last = [(float(1 / (1 + np.exp(-np.clip(m, -700, 700)))),) for m in margins]
        else:
            last = [tuple(made[b][i] for b in config.blocks) for i in range(len(kept))]
        return [(row["path"], k, *map(float, boxes[k]), float(scores[k]), *last[i]) for i, k in enumerate(kept)]

    found = images.frame_rows(frames.select("path", "pixels", "height", "width"), make, f"path string, n int, {BOX}, first double, {blocks}")
    return found if line else with_features(found, config)


def scored(frames: DataFrame, scorer: HogScorer, classifier: Fitted, d: DetectorConfig, config: images.FeatureConfig = images.FeatureConfig()) -> DataFrame:
    """path, n, x1 to y2, score of the second stage for all proposals. A linear classifier scores them where their features are made."""
    line = classifier.line(sum(config.widths().values()))
    windows = proposals(frames, scorer, d, config, line)
    return (windows if line else classifier.score(windows)).select("path", "n", *ba.COLUMNS, "score")


def detect(windows: DataFrame, d: DetectorConfig) -> DataFrame:
    """frame, x1 to y2, score: `scored` windows at or above the threshold, suppressed and voted."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "n"))
    return ba.nms_vote(windows.where(F.col("score") >= d.threshold).select(F.col("path").alias("frame"), place.alias("n"), *ba.COLUMNS, "score"), d.nms_iou)


def _as_box(b: Column) -> Column:
    return F.struct(*[b[k].alias(c) for k, c in enumerate(ba.COLUMNS)])


def overlaps(boxes: Column, least: float, strict: bool = False) -> Column:
    """Whether the row's own box (x1 to y2) overlaps one of an array by `least`, or by more."""
    over = lambda b: bx.iou(bx.box(), _as_box(b))
    return F.exists(boxes, lambda b: over(b) > least if strict else over(b) >= least)


def hard_negatives(windows: DataFrame, scenes: DataFrame, threshold: float = 0.5, most: int = 20) -> DataFrame:
    """`scored` windows that look like cars where none is: the `most` best of a frame, away from its cars and ignored boxes,
    anywhere if its random_negatives says so, else on its negatives."""
    known = scenes.select("path", F.concat("cars", "ignore").alias("known"), "negatives", "random_negatives")
    free = ~overlaps(F.col("known"), 0.3) & (F.col("random_negatives") | overlaps(F.col("negatives"), 0.5, True))
    found = windows.where(F.col("score") >= 0.6 * threshold).join(known, "path").where(free).select(windows.columns)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("score"), "n"))).where(F.col("place") <= most).drop("place")


def cut_windows(frames: DataFrame | Callable[[DataFrame], DataFrame], windows: DataFrame, label: int = 0) -> DataFrame:
    """path, n, label, pixels, height, width of windows (path, x1 to y2), cut out of their frames. A frame's pixels are moved once, and
    never to the driver, as the windows are the side of the join that is held; where `frames` is a function that puts pixels, height and
    width beside rows of path and boxes, they are not moved at all."""
    own = windows.groupBy("path").agg(F.collect_list(F.array(*ba.COLUMNS)).alias("boxes"))  # one frame's windows
    whole = frames(own) if callable(frames) else frames.select("path", "pixels", "height", "width").join(own.hint("shuffle_hash"), "path")

    def make(frame: np.ndarray, row: dict) -> list[tuple]:
        parts = images.cut(frame, np.trunc(row["boxes"]), 1)
        return [(row["path"], k, label, p.tobytes(), *p.shape[:2]) for k, p in enumerate(parts) if p is not None]

    return images.frame_rows(whole.select("path", "pixels", "height", "width", "boxes"), make, PATCH)


def judged(rows: DataFrame, scorer: HogScorer, line: linear.Line, blocks: tuple[str, ...]) -> DataFrame:
    """`rows` (with arrays of the blocks, hog among them) with over (the first stage's score less its threshold) and score (the chance of
    a car by a linear second stage) in place of the blocks."""
    names = [c for c in rows.columns if c not in blocks]
    kinds, weights = dict(rows.dtypes), scorer.weights.ravel()

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = {k: linear.matrix([b.column(len(names) + j)]).astype(float) for j, k in enumerate(blocks)}
                score = 1 / (1 + np.exp(-np.clip(line.margins(np.hstack([made[k] for k in blocks])), -700, 700)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(made["hog"] @ weights + scorer.offset - scorer.threshold), pa.array(score)], [*names, "over", "score"])

    return rows.select(*names, *blocks).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", over double, score double")


def random_windows(size: tuple[int, int], windows: np.ndarray, cars: np.ndarray, ignore: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Up to n boxes within the frame, off the ignored ones: of 50 n drawn, the first that lie off the cars, or half of the time partly on one."""
    sides = windows[rng.integers(len(windows), size=50 * n)] * rng.uniform(0.8, 1.25, (50 * n, 1))
    room = np.array(size) - sides
    corners = rng.uniform(size=sides.shape) * np.maximum(room, 0)
    boxes = np.hstack([corners, corners + sides])
    on = ba.iou_matrix(boxes, cars).max(1, initial=0)
    fits = (room > 0).all(1) & (ba.iou_matrix(boxes, ignore).max(1, initial=0) < 0.1)
    partly = (on > 0.1) & (on < 0.3) & (rng.random(len(boxes)) < 0.5)
    return boxes[fits & ((on < 0.1) | partly)][:n]


def sample_patches(scenes: DataFrame, windows: list[tuple[int, int]], n_random: int = 30, n_shifted: int = 2, shift: float = 0.06, seed: int = 0) -> DataFrame:
    """path, n, label, pixels, height, width: cars, mirrored and `n_shifted` times moved and scaled by up to `shift`; known empty boxes;
    random windows where the scene allows them. A frame's draws come from the seed and its path, whatever task it is in."""
    from zlib import crc32

    sizes = np.reshape(np.array(windows, float), (-1, 2))

    def make(frame: np.ndarray, row: dict) -> list[tuple]:
        rng = np.random.default_rng([seed, crc32(row["path"].encode())])
        cars, empty, ignore = (np.reshape(np.array(row[c] or [], float), (-1, 4)) for c in ("cars", "negatives", "ignore"))
        middle, side = (cars[:, :2] + cars[:, 2:]) / 2, cars[:, 2:] - cars[:, :2]
        draw = rng.uniform(-shift, shift, (n_shifted, len(cars), 3))
        at, half = middle + draw[..., :2] * side, side * (1 + draw[..., 2:]) / 2
        moved = np.concatenate([at - half, at + half], -1).reshape(-1, 4)
        n = n_random if row["random_negatives"] and len(sizes) else 0
        off = random_windows(frame.shape[1::-1], sizes, cars, ignore, n, rng) if n else np.empty((0, 4))
        parts = [(p, 1) for p in images.cut(frame, np.vstack([cars, moved]))] + [(p, 0) for p in images.cut(frame, np.vstack([empty, off]))]
        parts += [(p[:, ::-1], 1) for p, _ in parts[: len(cars)] if p is not None]
        return [(row["path"], k, label, p.tobytes(), *p.shape[:2]) for k, (p, label) in enumerate(parts) if p is not None]

    return images.frame_rows(scenes.select("path", "pixels", "height", "width", "cars", "negatives", "ignore", "random_negatives"), make, PATCH)


def average_precision(found: DataFrame, scenes: DataFrame, least: float = 0.5) -> DataFrame:
    """ap, precision, recall, n_gt of `detect`'s boxes over all scenes, in one row. Where only spaces are labelled (random_negatives
    false), boxes off these don't count."""
    known = scenes.select(F.col("path").alias("frame"), F.concat("cars", "negatives").alias("known"), "random_negatives")
    inside = found.join(known, "frame").where(F.col("random_negatives") | overlaps(F.col("known"), 0.3, True)).select("frame", *ba.COLUMNS, "score")
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("score"), *ba.COLUMNS))
    det = inside.withColumn("n", place)
    boxes_of = lambda c, kind: scenes.select(F.col("path").alias("frame"), F.posexplode(c).alias("n", "b")).select("frame", "n", *[F.col("b")[k].alias(x) for k, x in enumerate(ba.COLUMNS)], F.lit(kind).alias("kind"))
    every = det.select("frame", "n", *ba.COLUMNS, F.lit("det").alias("kind")).unionByName(boxes_of("cars", "truth")).unionByName(boxes_of("ignore", "ignore"))
    hits = ba.greedy_matches(every, least).join(det.select("frame", "n", "score"), ["frame", "n"]).select("score", "hit")
    return metrics.average_precision(hits, scenes.agg(F.sum(F.size("cars")).alias("n_gt")))
