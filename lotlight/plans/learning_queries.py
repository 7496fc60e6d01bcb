"""Learning over `embeddings`: label is `label % 2`, five cameras; and image features on drawn patches."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lotlight.operators import detector as det
from lotlight.operators import frames as fr
from lotlight.operators import images
from lotlight.operators import learning as ml
from lotlight.operators.grouping import spread
from lotlight.plans.bindings import boxes, table
from lotlight.plans.registry import query

BASE = "b AS (SELECT vec_id AS key, label % 2 AS label, vec_id % 5 AS grp FROM embeddings)"


def rows(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("key"), (F.col("label") % 2).cast("double").alias("label"), (F.col("vec_id") % 5).alias("grp"), array_to_vector("embedding").alias("features"))


def candidates(models=("logreg",), sets=None):
    sets = sets or {"head": list(range(16)), "all": list(range(64))}
    return [ml.Candidate(f"{s} | {m}", c, m) for s, c in sets.items() for m in models]


@query("ml_subsample", f"WITH {BASE}, r AS (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY md5(key || '|0'), key) AS k FROM b) SELECT key, CAST(label AS DOUBLE) AS label FROM r WHERE k <= 50")
def ml_subsample(spark, d):
    return ml.subsample(rows(spark, d), "key", "label", 50).select("key", "label")


@query("ml_holdout", f"WITH {BASE}, g AS (SELECT grp, row_number() OVER (ORDER BY md5(grp || '|0'), grp) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM b)) SELECT key, CASE WHEN k <= greatest(1, ceil(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM b JOIN g ON g.grp = b.grp")
def ml_holdout(spark, d):
    return ml.holdout(rows(spark, d), "grp", "label", "key").select("key", "part")


@query("ml_cv_folds", f"WITH {BASE}, g AS (SELECT grp, row_number() OVER (ORDER BY avg(label) DESC, count(*) DESC, grp) - 1 AS p FROM b GROUP BY grp) SELECT key, CAST(CASE WHEN p % 6 < 3 THEN p % 6 ELSE 5 - p % 6 END AS INTEGER) AS fold FROM b JOIN g ON g.grp = b.grp")
def ml_cv_folds(spark, d):
    return ml.folds(rows(spark, d), "grp", "label", "key", 3).select("key", "fold")


@query("ml_scene_holdout", f"WITH {BASE}, g AS (SELECT grp, row_number() OVER (ORDER BY md5(grp || '|1'), grp) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM b)) SELECT key, CASE WHEN k <= greatest(1, ceil(n * 0.25)) THEN 'test' ELSE 'train' END AS part FROM b JOIN g ON g.grp = b.grp")
def ml_scene_holdout(spark, d):
    return ml.holdout(rows(spark, d), "grp", "label", "key", 0.25, seed=1).select("key", "part")


@query("ml_group_fallback", f"WITH {BASE} SELECT key, grp || '/' || (key % 20) AS cv_group FROM b")
def ml_group_fallback(spark, d):
    return ml.group_or_frame(rows(spark, d).withColumn("frame", F.col("key") % 20), "grp", "frame", 4).select("key", "cv_group")


def _model(name):
    def run(spark, d):
        """Held-out metrics of one model."""
        parts = ml.holdout(rows(spark, d), "grp", "label", "key")
        fitted = candidates((name,), {"all": list(range(64))})[0].fit(parts.where("part = 'train'"))
        scored = fitted.score(parts.where("part = 'test'"))
        return scored.select("key", F.round("score", 4).alias("score"), (F.col("score") >= 0.5).cast("int").alias("pred"))

    run.__name__ = f"ml_{name}"
    return run


for _name in ml.MODELS:
    query(f"ml_{_name}")(_model(_name))


@query("ml_softvote")
def ml_softvote(spark, d):
    parts = ml.holdout(rows(spark, d), "grp", "label", "key")
    members = [c.fit(parts.where("part = 'train'")) for c in candidates(("logreg", "rf"), {"all": list(range(64))})]
    return ml.soft_vote(members, parts.where("part = 'test'")).select("key", F.round("score", 4).alias("score"))


@query("ml_cross_validate")
def ml_cross_validate(spark, d):
    return ml.cross_validate(ml.folds(rows(spark, d), "grp", "label", "key", 3), candidates(("logreg",)), 3).drop("fit_s")


@query("ml_grid_search")
def ml_grid_search(spark, d):
    """The regression's whole grid, scaling included."""
    c = candidates(("logreg",), {"all": list(range(64))})[0]
    best, f1 = ml.tune(ml.folds(rows(spark, d), "grp", "label", "key", 3), c, 3)
    return spark.createDataFrame([(c.name, float(best["C"]), round(f1, 4))], "candidate string, C double, cv_f1 double")


@query("ml_run_selection")
def ml_run_selection(spark, d):
    """The whole protocol with the best candidate tuned."""
    s = ml.run_selection(rows(spark, d), candidates(("logreg", "svm"), {"all": list(range(64))}), k=3, ensemble_top=2, tune_top=1, grids={"logreg": ml.GRIDS["logreg"], "svm": {"C": [1, 10]}})
    return s.board.select("candidate", "model", "n_features", "rank", F.round("cv_f1", 4).alias("cv_f1"), F.col("latency_ms").isNotNull().alias("timed"), (F.col("candidate") == s.winner).alias("chosen"))


@query("ml_report_top5")
def ml_report_top5(spark, d):
    """Scores on the part held out of the five best."""
    s = ml.run_selection(rows(spark, d), candidates(("logreg", "svm"), {"head": list(range(16)), "tail": list(range(32, 64)), "all": list(range(64))}), k=3, ensemble_top=0)
    return s.top.select("candidate", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@query("agg_median_latency")
def agg_median_latency(spark, d):
    """Measured: whether each candidate's median time a row is a positive number. The times themselves are in the board."""
    df = rows(spark, d)
    out = [(c.name, ml.latency_ms(c.fit(df).score, df)) for c in candidates()]
    return spark.createDataFrame([(n, ms > 0) for n, ms in out], "candidate string, timed boolean")


@query("ml_window_sizes")
def ml_window_sizes(spark, d):
    b = boxes(spark, d).select((F.col("box.x2") - F.col("box.x1")).alias("w"), (F.col("box.y2") - F.col("box.y1")).alias("h"))
    return spark.createDataFrame(ml.window_sizes(b, 5), "w int, h int")


def patches(spark, d):
    """A 64 x 64 patch drawn from each vector."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            drawn = [np.clip(np.outer(v, np.arange(192) % 64) * 40 + 128, 0, 255).astype(np.uint8).tobytes() for v in pdf.embedding.to_numpy()]
            yield pd.DataFrame({"vec_id": pdf.vec_id, "pixels": drawn, "height": 64, "width": 64})

    return e.mapInPandas(run, "vec_id long, pixels binary, height int, width int")


@query("feat_extract")
def feat_extract(spark, d):
    f = images.feature_frame(patches(spark, d))
    return f.select("vec_id", *[F.size(b).alias(f"n_{b}") for b in images.BLOCKS], *[F.round(F.aggregate(b, F.lit(0.0), lambda a, x: a + x), 3).alias(f"sum_{b}") for b in images.BLOCKS])


def _block(name):
    def run(spark, d):
        """One block of features: its width, sum and largest value."""
        f = images.feature_frame(patches(spark, d), images.FeatureConfig(blocks=(name,)))
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return f.select("vec_id", F.size(name).alias("width"), F.round(total, 3).alias("total"), F.round(F.array_max(name), 4).alias("most"))

    run.__name__ = f"feat_{name}"
    return run


for _name in images.BLOCKS:
    query(f"feat_{_name}")(_block(_name))


@query("prj_block_slices", "SELECT * FROM (VALUES ('hog', 0, 1764), ('lbp', 1764, 1792), ('glcm', 1792, 1828), ('rgb', 1828, 1876), ('hsv', 1876, 1926)) t(block, first, after)")
def prj_block_slices(spark, d):
    return spark.createDataFrame([(b, s.start, s.stop) for b, s in images.FeatureConfig().slices().items()], "block string, first int, after int")


# The detector on drawn scenes: one for each supplier, with cars where its key puts them.

FAST = images.FeatureConfig(blocks=("hog", "rgb"))
DET = det.DetectorConfig(windows=((64, 64),), max_windows=None)
SCENE = 170, 240  # height and width


def scenes(spark, d, pixels=True):
    """path, pixels, height, width (not without `pixels`), cars, negatives, ignore, random_negatives: two cars or one in a frame, and an empty place."""
    k = F.col("s_suppkey").cast("int")
    at = lambda x, y: F.array(x.cast("double"), y.cast("double"), (x + 64).cast("double"), (y + 64).cast("double"))
    one, two, gap = at(k % 30 + 4, k % 17 + 6), at(k % 23 + 130, k % 31 + 12), at(k % 11 + 72, k % 40 + 60)
    s = table(spark, d, "supplier").select(F.concat(F.lit("f"), k).alias("path"), F.when(k % 3 == 0, F.array(one)).otherwise(F.array(one, two)).alias("cars"), F.array(gap).alias("negatives"), (k % 4 != 0).alias("random_negatives"))
    s = s.withColumn("ignore", F.array().cast("array<array<double>>"))
    return draw(spread(s, "path")) if pixels else s


def draw(s):
    """`scenes`, and what columns they have besides, with pixels, height, width."""

    def run(batches):
        import zlib

        for pdf in (whole[at : at + 64] for whole in batches for at in range(0, len(whole), 64)):
            made = []
            for path, cars in zip(pdf.path, pdf.cars):
                img = np.random.default_rng(zlib.crc32(path.encode())).integers(90, 110, (*SCENE, 3)).astype(np.uint8)
                for x1, y1, x2, y2 in (np.asarray(c, int) for c in cars):
                    img[y1:y2, x1:x2] = (200, 60, 60)
                    img[y1 + 8 : y2 - 8, x1 + 8 : x2 - 8] = (30, 30, 30)
                made.append(img.tobytes())
            yield pdf.assign(pixels=made, height=SCENE[0], width=SCENE[1])

    return s.mapInPandas(run, ", ".join(f"{name} {kind}" for name, kind in s.dtypes) + ", pixels binary, height int, width int")


def _patches(spark, d):
    return det.sample_patches(scenes(spark, d), [(64, 64)], n_random=6, n_shifted=1)


def _features(spark, d):
    """Label and blocks of every patch."""
    return images.feature_frame(_patches(spark, d), FAST).select("label", *FAST.blocks)


def _patch_rows(f):
    return det.with_features(f, FAST).withColumn("label", F.col("label").cast("double"))


def _classifier(f):
    return ml.Candidate("all | logreg", list(range(sum(FAST.widths().values()))), "logreg").fit_blocks(f, FAST.blocks)


def _stages(f):
    return det.fit_scorer(f), _classifier(f)


def _detector(spark, d):
    f = _features(spark, d).persist()
    stages = _stages(f)
    f.unpersist()
    return stages


@query("ml_sample_patches")
def ml_sample_patches(spark, d):
    return _patches(spark, d).select("path", "n", "label", "height", "width", F.xxhash64("pixels").alias("pixels_hash"))


@query("det_stage1")
def det_stage1(spark, d):
    s = det.fit_scorer(_patches(spark, d))
    return spark.createDataFrame([(s.weights.size, round(float(np.linalg.norm(s.weights)), 3), round(s.offset, 3), round(s.threshold, 3))], "n_weights int, norm double, offset double, threshold double")


@query("det_detect")
def det_detect(spark, d):
    found = det.detect(det.scored(scenes(spark, d), *_detector(spark, d), DET, FAST), DET)
    return found.select("frame", *[F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("score", 3).alias("score"))


@query("det_hard_negatives")
def det_hard_negatives(spark, d):
    """By frame: how many patches were mined, and the greatest chance of a car among them before and after both stages are fitted again with
    all of them (score_before, score), and by how much the new first stage lets the best of them pass (over). Then a row of how many scenes there are."""
    f, boxes = _features(spark, d).persist(), scenes(spark, d, False)
    stages = _stages(f)
    hard = det.hard_negatives(det.scored(scenes(spark, d), *stages, DET, FAST), boxes, 0.05)
    cut = det.cut_windows(lambda own: draw(spread(boxes.join(own, "path"), "path")), hard)
    mined = images.feature_frame(cut, FAST).select("path", "label", "height", *FAST.blocks).persist()
    line = lambda classifier: classifier.line(sum(FAST.widths().values()))
    before = det.judged(mined, stages[0], line(stages[1]), FAST.blocks)
    if before.count():  # without any, the stages stay
        stages = _stages(f.unionByName(mined.select(f.columns)))
    f.unpersist()
    after = det.judged(mined, stages[0], line(stages[1]), FAST.blocks)
    best = lambda c: F.round(F.max(c), 3)
    found = after.groupBy("path").agg(F.count("*").alias("n_patches"), F.min("height").alias("least_height"), best("over").alias("over"), best("score").alias("score"))
    found = found.join(before.groupBy("path").agg(best("score").alias("score_before")), "path")
    every = boxes.agg(F.lit("all").alias("path"), F.count("*").alias("n_patches"), F.lit(SCENE[0]).alias("least_height"))
    return found.unionByName(every, True)


@query("det_ap_top")
def det_ap_top(spark, d):
    """Average precision of the detector with each of two second stages, over all scenes; det_sec_per_frame tells that its time was taken."""
    import time

    s, f = scenes(spark, d), _features(spark, d).persist()
    data, windows, out = _patch_rows(f), det.proposals(s, det.fit_scorer(f), DET, FAST), []
    stages = {name: ml.Candidate(f"{name} | logreg", FAST.columns(name), "logreg").fit(data) for name in FAST.blocks}
    f.unpersist()
    boxes = scenes(spark, d, False)
    for name, fitted in stages.items():
        windows = fitted.score(windows, name)
    windows = windows.drop("features", "first").persist()  # each frame is drawn and described once for both
    for name in stages:
        began = time.perf_counter()
        row = det.average_precision(det.detect(windows.withColumn("score", F.col(name)), DET), boxes).first()
        out.append((f"{name} | logreg", round(row["ap"], 4), round(row["precision"], 4), round(row["recall"], 4), row["n_gt"], time.perf_counter() > began))
    return spark.createDataFrame(out, "candidate string, ap double, precision double, recall double, n_gt long, det_sec_per_frame boolean")


@query("cls_frame")
def cls_frame(spark, d):
    """The occupancy log of all drawn scenes as frames: three spots, drawn on a frame of half the size, and a classifier trained on patches."""
    s = scenes(spark, d)
    square = lambda x, y: [{"x": x, "y": y}, {"x": x + 32.0, "y": y}, {"x": x + 32.0, "y": y + 32.0}, {"x": x, "y": y + 32.0}]
    spots = spark.createDataFrame([("S1", square(9.0, 7.0), 120, 85), ("S2", square(70.0, 13.0), 120, 85), ("S3", square(38.0, 38.0), 120, 85)], "id string, polygon array<struct<x:double,y:double>>, width int, height int")
    begin = F.timestamp_seconds(F.substring("path", 2, 12).cast("long") * 60).cast("timestamp_ntz")
    f = _features(spark, d).persist()
    fitted = _classifier(f)
    f.unpersist()
    log = fr.classify(s.withColumn("ts", begin), spots, fitted.score, config=FAST)
    return log.select("ts", "spot_id", "occupied", F.round("score", 3).alias("score"))


@query("snk_console")
def snk_console(spark, d):
    """The lines that a log prints, one a frame."""
    return fr.status_lines(cls_frame(spark, d))
