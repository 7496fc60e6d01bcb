"""Jobs on the command line: python -m lotlight.jobs JOB --option value ..."""

from __future__ import annotations

import argparse
import json
import time
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.operators import availability as av
from lotlight.operators import detector, discovery, frames, images, learning, sequences, simulation
from lotlight.sources import annotations, sinks
from lotlight.streaming import occupancy


def _selected(f, o: argparse.Namespace, config: images.FeatureConfig) -> learning.Selection:
    """The selection over rows of features (key, grp, label and blocks), with its reports written."""
    rows = detector.with_features(f.select("key", "grp", F.col("label").cast("double").alias("label"), *config.blocks), config).persist()
    tried = [learning.Candidate(f"{s} | {m}", config.columns(s), m) for s in o.features for m in o.models]
    chosen = learning.run_selection(rows, tried, o.cv, o.ensemble, tune_top=o.tune_top)
    sinks.write_report(chosen.board, f"{o.out}/leaderboard")
    sinks.write_report(chosen.top, f"{o.out}/test_top")
    return chosen


def train(spark: SparkSession, o: argparse.Namespace) -> None:
    """Rank occupancy models on a folder of labelled patches; write the leaderboard, the test scores of the winner and of the five best, and the winner."""
    labels = annotations.read_patch_folder(spark, o.patches, o.group_level)
    labels = learning.subsample(labels, "path", "label", o.max_per_class)
    pixels = annotations.read_images(spark, o.patches)
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    df = pixels.withColumn("path", bare("path")).join(labels.withColumn("path", bare("path")), "path").withColumnRenamed("path", "key")
    chosen = _selected(sinks.cached_features(df, f"{o.out}/features"), o, images.FeatureConfig())
    sinks.write_report(chosen.test.withColumnRenamed("candidate", "winner"), f"{o.out}/summary", "json")
    for name, m in chosen.models.items():
        sinks.save_model(m, f"{o.out}/models/{name.replace(' | ', '-')}", {"winner": chosen.winner})


def train_detector(spark: SparkSession, o: argparse.Namespace) -> None:
    """Train the two-stage detector on annotated scenes or VOC photos: patches, selection, both stages, hard negatives, both stages anew; evaluate on what was held out."""
    if o.voc:
        root = annotations.voc_root(spark, o.voc)
        photos = annotations.read_images(spark, f"{root}/JPEGImages")
        part = lambda split, seed: annotations.scenes_of(annotations.read_voc(spark, root, split, n_background=o.background, seed=seed).withColumn("image", F.concat("id", F.lit(".jpg"))), photos)
        learn, test = part("trainval", 0).persist(), part("test", 1).persist()
    else:
        every = [annotations.scenes_of(annotations.read_scenes(spark, f"{x}/annotations.json"), annotations.read_images(spark, x)) for x in o.scenes]
        marked = learning.holdout(reduce(DataFrame.unionByName, every).withColumn("label", (F.size("cars") > 0).cast("int")), "grp", "label", "path", 0.25)
        learn, test = marked.where("part = 'train'").drop("part").persist(), marked.where("part = 'test'").drop("part").persist()
    cars = learn.select(F.explode("cars").alias("b")).select((F.col("b")[2] - F.col("b")[0]).alias("w"), (F.col("b")[3] - F.col("b")[1]).alias("h"))
    config, d = images.FeatureConfig(), detector.DetectorConfig(tuple(learning.window_sizes(cars, o.n_windows)), max_windows=o.max_windows, threshold=o.threshold)
    patches = detector.sample_patches(learn, list(d.windows), o.negatives, o.shifted).persist()
    groups = learning.group_or_frame(learn.select("path", "grp"), "grp", "path", o.cv).select("path", F.col("cv_group").alias("grp"))
    feature_rows = lambda p: images.feature_frame(p, config).drop("pixels").withColumn("key", F.concat_ws("#", "path", "n"))
    chosen = _selected(feature_rows(patches).join(groups, "path"), o, config)
    winner = [m.candidate for m in chosen.models.values()]

    def stages(p: DataFrame):
        rows = detector.with_features(feature_rows(p).select(F.col("label").cast("double").alias("label"), *config.blocks), config).persist()
        fitted = [c.fit(rows) for c in winner]
        return detector.fit_scorer(p, d.recall, config=config), fitted, rows

    vote = lambda fitted: (lambda df: learning.soft_vote(fitted, df))
    scorer, fitted, rows = stages(patches)
    if o.hard_frames:
        pool = learn.orderBy(F.xxhash64("path"), "path").limit(o.hard_frames)  # bounded by the option
        windows = vote(fitted)(detector.proposals(pool, scorer, d, config))
        hard = detector.cut_windows(pool, detector.hard_negatives(windows, pool, d.threshold))
        scorer, fitted, rows = stages(patches.unionByName(hard.withColumn("n", F.col("n") + 1_000_000)).persist())
    began, n = time.perf_counter(), max(test.count(), 1)
    found = detector.detect(vote(fitted)(detector.proposals(test, scorer, d, config)), d).persist()
    found.count()
    spent = (time.perf_counter() - began) / n
    result = detector.average_precision(found, test).withColumns({"winner": F.lit(chosen.winner), "seconds_per_frame": F.lit(spent), "windows": F.lit(json.dumps(d.windows))})
    sinks.write_report(result, f"{o.out}/summary", "json")
    named = {c.name: c for c in (learning.Candidate(f"{s} | {m}", config.columns(s), m) for s in o.features for m in o.models)}
    top = [r["candidate"] for r in chosen.board.where(F.col("candidate").isin(list(named))).orderBy("rank").limit(o.ap_top).collect()]
    reports = [detector.average_precision(detector.detect(named[c].fit(rows).score(detector.proposals(test, scorer, d, config)), d), test).withColumn("candidate", F.lit(c)) for c in top]
    if reports:
        sinks.write_report(reduce(DataFrame.unionByName, reports), f"{o.out}/top_ap")
    for m in fitted:
        sinks.save_model(m, f"{o.out}/models/{m.candidate.name.replace(' | ', '-')}")
    about = {"weights": scorer.weights.ravel().tolist(), "shape": scorer.weights.shape, "offset": scorer.offset, "threshold": scorer.threshold, "config": config.to_dict(), "windows": d.windows}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out}/first_stage")


def discover(spark: SparkSession, o: argparse.Namespace) -> None:
    """Find spots in a table of detections (camera, t, ts, x1 to y2); with a table of frames (camera, ts, pixels, height, width) transitions are verified by appearance."""
    seen = spark.read.parquet(o.detections)
    c = discovery.DiscoveryConfig(min_stay_minutes=o.min_stay, min_absence_minutes=o.min_absence, min_change=o.min_change)
    sites = discovery.find_sites(seen, c).persist()
    times = seen.select("camera", "t", "ts").distinct()
    shots = times.join(spark.read.parquet(o.frames), ["camera", "ts"]) if o.frames else times
    presence, summary = discovery.analyse(sites, shots, seen, c)
    spots = discovery.named_spots(sites, summary, o.width, o.height, not o.confirmed_only, c).persist()
    spots.write.mode("overwrite").parquet(f"{o.out}/spots")
    sinks.write_report(summary, f"{o.out}/sites")
    discovery.occupancy_log(presence, spots).write.mode("overwrite").parquet(f"{o.out}/log")
    if o.bays:
        metrics, table = discovery.evaluate(spots, spark.read.parquet(o.bays))
        sinks.write_report(metrics, f"{o.out}/evaluation")
        sinks.write_report(table, f"{o.out}/bays")


def detect(spark: SparkSession, o: argparse.Namespace) -> None:
    """Classify every spot of every frame in a folder into a log, smoothed by spot, and print each frame's state; or watch the folder as a stream."""
    spots = annotations.read_spots(spark, o.spots)
    fitted = [sinks.load_model(spark, m)[0] for m in o.model]
    score = lambda df: learning.soft_vote(fitted, df)
    if o.watch:
        log = frames.classify(occupancy.image_stream(spark, o.frames), spots, score, threshold=o.threshold).withColumn("event_id", F.unix_micros(F.col("ts").cast("timestamp")))
        smooth = occupancy.smooth_stream(log, o.window).withColumn("ts", F.timestamp_micros("event_id").cast("timestamp_ntz")).select("ts", "spot_id", F.col("smoothed").alias("occupied"))

        def put(df: DataFrame, k: int) -> None:
            df.persist()
            df.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{o.out}/log/part={k}")  # the same batch again replaces itself
            sinks.print_status(df)
            df.unpersist()

        q = smooth.writeStream.foreachBatch(put).option("checkpointLocation", f"{o.out}/state")
        (q if o.stay else q.trigger(availableNow=True)).start().awaitTermination()
        return
    log = frames.classify(annotations.read_frames(spark, o.frames), spots, score, threshold=o.threshold)
    log = sequences.majority(log, o.window).select("ts", "spot_id", F.col("smoothed").alias("occupied"), "score").persist()
    sinks.append_log(log, f"{o.out}/log")
    sinks.print_status(log)


def follow(spark: SparkSession, o: argparse.Namespace) -> None:
    """Smooth a stream of observations (event_id, ts, spot_id, occupied) into an appended log; stops when it has caught up, unless told to stay."""
    schema = "event_id long, ts timestamp, spot_id string, occupied int"
    smooth = occupancy.smooth_stream(spark.readStream.schema(schema).parquet(o.observations), o.window)
    q = smooth.writeStream.outputMode("append").option("checkpointLocation", f"{o.out}/state").format("parquet")
    (q if o.stay else q.trigger(availableNow=True)).start(f"{o.out}/log").awaitTermination()


def allot(spark: SparkSession, o: argparse.Namespace) -> None:
    """Rank spots for one request over a log (ts, spot_id, occupied), bookings and declarations (spot_id, start, end)."""
    grid = av.slot_grid(spark.read.parquet(o.log), o.slot_minutes)
    start = datetime.fromisoformat(o.start)
    asked = av.one_window(spark, start, start).withColumn("end", F.col("start") + F.make_dt_interval(mins=F.lit(round(o.hours * 60))))
    none = spark.createDataFrame([], "spot_id string, start timestamp_ntz, end timestamp_ntz")
    spans = lambda path: spark.read.parquet(path) if path else none
    ranked = av.candidates(grid, asked, o.slot_minutes, spans(o.bookings), spans(o.declarations), None, o.min_confidence, mode=o.mode)
    for r in ranked.orderBy("rank").limit(20).collect():
        print(json.dumps(r.asDict(), default=str))


def replay(spark: SparkSession, o: argparse.Namespace) -> None:
    """Replay the last days of a log (ts, spot_id, occupied, truth): requests each hour, allotted by the model at several confidences or by what is free now; how many stayed free."""
    log = spark.read.parquet(o.log)
    booked, naive = simulation.replay(log, o.test_days, o.hours, o.slot_minutes, o.thresholds)
    sinks.write_report(booked, f"{o.out}/bookings")
    sinks.write_report(naive, f"{o.out}/sweep")


def crop(spark: SparkSession, o: argparse.Namespace) -> None:
    """Cut every spot out of every frame."""
    shots = annotations.read_images(spark, o.frames).withColumn("labels", F.create_map().cast("map<string,int>"))
    sinks.write_crops(shots, annotations.read_spots(spark, o.spots), o.out, o.size)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lotlight.jobs", description=__doc__)
    jobs = p.add_subparsers(required=True)

    def job(f, **options):
        sub = jobs.add_parser(f.__name__, help=f.__doc__)
        sub.set_defaults(run=f)
        for name, default in options.items():
            flag = f"--{name.replace('_', '-')}"
            if default is False:
                sub.add_argument(flag, action="store_true")
            elif isinstance(default, list):
                sub.add_argument(flag, nargs="+", default=default, type=type(default[0]) if default else str)
            elif default is str or default is int:
                sub.add_argument(flag, type=default, required=default is str)
            else:
                sub.add_argument(flag, type=type(default), default=default)

    select = {"features": list(images.FEATURE_SETS), "models": list(learning.MODELS), "ensemble": 3, "tune_top": 0}
    job(train, patches=str, out=str, group_level=0, max_per_class=3000, cv=5, **select)
    job(train_detector, out=str, voc="", scenes=[], background=300, n_windows=8, max_windows=400, negatives=6, shifted=1, hard_frames=60, ap_top=0, threshold=0.5, cv=3, **select)
    job(discover, detections=str, out=str, frames="", bays="", width=1000.0, height=750.0, confirmed_only=False, min_stay=45.0, min_absence=30.0, min_change=0.6)
    job(detect, frames=str, spots=str, model=[], out=str, threshold=0.5, window=1, watch=False, stay=False)
    job(replay, log=str, out=str, test_days=7, hours=2, slot_minutes=30, thresholds=[0.5, 0.7, 0.9])
    job(follow, observations=str, out=str, window=5, stay=False)
    job(allot, log=str, start=str, hours=2.0, slot_minutes=30, min_confidence=0.8, mode="weekday/weekend", bookings="", declarations="")
    job(crop, frames=str, spots=str, out=str, size=64)
    o = p.parse_args(args)
    o.run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), o)


if __name__ == "__main__":
    main()
