"""Writers: the occupancy log, reports, crops, models and feature caches."""

from __future__ import annotations

import hashlib
import importlib
import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.operators import frames, images
from lotlight.operators.forest import Forest
from lotlight.operators.learning import Candidate, Fitted


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").option("header", "true").csv(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A small report as one file."""
    out = df.coalesce(1).write.mode("overwrite")
    out.option("header", "true").csv(path) if form == "csv" else out.json(path)


def write_crops(shots: DataFrame, spots: DataFrame, path: str, size: int = 64, by: list[str] | None = None) -> None:
    """An upright RGB patch of each frame (path, pixels, height, width, labels: map of spot to 0 or 1) and spot, by label folder.

    Patches are raw pixels with their size in Parquet, partitioned by label.
    """
    made = frames.spot_patches(shots, spots, {"path": F.col("path"), "labels": F.col("labels")}, by, (size, size))
    state = F.try_element_at("labels", F.col("spot_id"))
    label = F.when(state == 1, "occupied").when(state == 0, "empty").otherwise("unlabeled")
    made.select("path", F.col("spot_id").alias("id"), label.alias("label"), F.col("pixels").alias("patch")).write.mode("overwrite").partitionBy("label").parquet(path)


def print_status(log: DataFrame, limit: int = 1000) -> None:
    """The last `limit` frames of a log on the console, one line each."""
    for r in reversed(frames.status_lines(log).orderBy(F.desc("ts")).limit(limit).collect()):
        print(r["line"])


def save_model(fitted: Fitted, path: str, sidecar: dict | None = None) -> None:
    """A fitted candidate: what stands before the model, the model, and all else, with `sidecar`, as JSON beside them."""
    fitted.before.write().overwrite().save(f"{path}/before")
    if isinstance(fitted.model, Forest):
        fitted.model.save(SparkSession.active(), f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    own = {"candidate": asdict(fitted.candidate), "class": f"{type(fitted.model).__module__}.{type(fitted.model).__name__}", "width": fitted.width, "gamma": fitted.gamma}
    SparkSession.active().createDataFrame([(json.dumps({**own, "sidecar": sidecar or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[Fitted, dict]:
    """The fitted candidate and its sidecar."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    module, name = about["class"].rsplit(".", 1)
    if about["class"] == f"{Forest.__module__}.{Forest.__name__}":
        model = Forest.load(spark, f"{path}/model")
    elif module.startswith("pyspark.ml."):
        model = getattr(importlib.import_module(module), name).load(f"{path}/model")
    else:
        raise ValueError(f"{path} holds no model of Spark")
    return Fitted(Candidate(**about["candidate"]), PipelineModel.load(f"{path}/before"), model, about["width"], about["gamma"]), about["sidecar"]


def cached_features(patches: DataFrame, path: str, config: images.FeatureConfig = images.FeatureConfig()) -> DataFrame:
    """Features of `patches` (key, pixels, height, width) kept under a digest of the settings and of all keys and pixels: never stale."""
    spark = patches.sparkSession
    what = patches.agg(F.count("*"), F.bit_xor(F.xxhash64("key", "pixels"))).first()
    name = hashlib.sha1(json.dumps([config.to_dict(), *what], default=str).encode()).hexdigest()
    where = f"{path}/{name}"
    try:
        return spark.read.parquet(where)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    images.feature_frame(patches, config).drop("pixels").write.parquet(where)
    return spark.read.parquet(where)
