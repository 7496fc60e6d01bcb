import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotlight.operators import images
from lotlight.sources import annotations as src
from lotlight.sources import sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data) if isinstance(data, bytes) else path.write_text(data)


def test_patch_folder(spark, tmp_path):
    for p in ("cam0/empty/a.PNG", "cam0/Occupied/b.jpg", "cam1/busy/empty/c.bmp", "cam1/other/d.png", "free/e.jpeg", "cam1/full/x.txt"):
        put(tmp_path / p, b"x")
    rows = {r.path.rsplit("/", 1)[1]: (r.label, r.grp) for r in src.read_patch_folder(spark, str(tmp_path), 0).collect()}
    assert rows == {"a.PNG": (0, "cam0"), "b.jpg": (1, "cam0"), "c.bmp": (0, "cam1"), "e.jpeg": (0, "free")}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        src.read_patch_folder(spark, str(tmp_path / "none"))


def test_label_list(spark, tmp_path):
    put(tmp_path / "l.txt", "cam1/my file.jpg 1\n\n  cam2/b.jpg\t0  \n")
    rows = [tuple(r) for r in src.read_label_list(spark, str(tmp_path / "l.txt"), "/root/x", 0).collect()]
    assert rows == [("/root/x/cam1/my file.jpg", 1, "cam1"), ("/root/x/cam2/b.jpg", 0, "cam2")]


def test_spots(spark, tmp_path):
    doc = {"image_size": None, "spots": [{"id": "S1", "polygon": [[0.25, 1], [2, 1], [2, 3], [0, 3]], "owner": "Ann", "meta": {"k": "v"}}, {"id": "S2", "polygon": [[0, 0], [1, 0], [1, 1], [0, 1]]}]}
    put(tmp_path / "s.json", json.dumps(doc))
    spots = src.read_spots(spark, str(tmp_path / "s.json"))
    assert [(r.id, r.owner, r.width) for r in spots.orderBy("id").collect()] == [("S1", "Ann", None), ("S2", None, None)]
    src.write_spots(spots, str(tmp_path / "out"))
    again = src.read_spots(spark, str(tmp_path / "out")).orderBy("id").collect()
    assert again[0].polygon[0].x == 0.2 and again[0].meta == {"k": "v"} and again[1].meta is None


def test_scenes(spark, tmp_path):
    put(tmp_path / "site" / "annotations.json", json.dumps({"frames": [{"image": "a.png", "timestamp": "2024-01-02T08:00:00", "cars": [[1, 2, 3, 4]], "negatives": [[5, 6, 7, 8]], "random_negatives": False}, {"image": "b.png", "cars": [], "group": "g"}, {"image": "c.png", "cars": []}]}))
    rows = src.read_scenes(spark, str(tmp_path / "site" / "annotations.json")).collect()
    assert [(r.image, r.grp, r.ts) for r in rows] == [("a.png", "site:2024-01-02", datetime(2024, 1, 2, 8)), ("b.png", "g", None), ("c.png", "site", None)]
    assert [(r.negatives, r.random_negatives) for r in rows] == [([[5.0, 6.0, 7.0, 8.0]], False), ([], True), ([], True)]
    pixels = spark.createDataFrame([(f"file:/x/{n}.png", bytearray(b"abc"), 1, 1) for n in "ab"], "path string, pixels binary, height int, width int")
    both = {r.path[-5]: r for r in src.scenes_of(src.read_scenes(spark, str(tmp_path / "site" / "annotations.json")), pixels).collect()}
    assert both["a"].cars == [[1, 2, 3, 4]] and both["a"].ignore == [] and both["b"].grp == "g" and len(both) == 2


def test_voc(spark, tmp_path):
    box = "<bndbox><xmin>11</xmin><ymin>21</ymin><xmax>30</xmax><ymax>40</ymax></bndbox>"
    obj = lambda n, d: f"<object><name>{n}</name><difficult>{d}</difficult>{box}</object>"
    put(tmp_path / "Annotations/1.xml", f"<annotation>{obj('car', 0)}{obj('car', 1)}{obj('dog', 0)}</annotation>")
    put(tmp_path / "Annotations/2.xml", f"<annotation>{obj('person', 0)}</annotation>")
    put(tmp_path / "ImageSets/Main/trainval.txt", "2\n1\n")
    rows = src.read_voc(spark, str(tmp_path)).collect()
    assert [r.id for r in rows] == ["1", "2"] and rows[0].cars == [[10, 20, 30, 40]] and rows[0].ignore == [[10, 20, 30, 40]] and rows[1].cars == []
    assert [r.id for r in src.read_voc(spark, str(tmp_path), n_background=0).collect()] == ["1"]
    assert [r.id for r in src.read_voc(spark, str(tmp_path.parent), n_background=0).collect()] == ["1"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        src.voc_root(spark, str(tmp_path / "none"))


def test_cnr(spark, tmp_path):
    put(tmp_path / "CNRPark+EXT.csv", "camera,datetime,weather,slot_id,occupancy\nA,2015-11-12_07.09,S,1,1\n1,2015-11-12_07.09,S,1,1\n1,2015-11-12_07.09,S,2,0\n1,2015-11-12_07.09,S,9,0\n1,2015-11-13_07.09,R,1,1\n2,2015-11-12_07.09,O,1,1\n")
    for c in (1, 2):
        put(tmp_path / f"camera{c}.csv", "SlotId,X,Y,W,H\n1,0,0,2592,1944\n2,1296,972,259.2,194.4\n")
    put(tmp_path / "FULL_IMAGE_1000x750/SUNNY/2015-11-12/camera1/2015-11-12_0709.jpg", b"x")
    rows = src.read_cnr(spark, str(tmp_path)).collect()
    assert [(r.camera, r.weather, r.grp) for r in rows] == [(1, "SUNNY", "camera1:2015-11-12")]
    assert rows[0].cars == [[0, 0, 1000, 750]] and rows[0].negatives[0] == pytest.approx([500, 375, 600, 450]) and rows[0].slots == {1: 1, 2: 0}


def test_frames_and_images(spark, tmp_path):
    for n in ("20240102_0300.jpg", "20240101_0300.png", "other.jpg"):
        put(tmp_path / "f" / n, b"not an image")
    rows = src.frame_times(spark, str(tmp_path / "f")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["20240101_0300.png", "20240102_0300.jpg", "other.jpg"] and rows[0].ts == datetime(2024, 1, 1, 3)
    with pytest.raises(Exception, match="can't decode"):
        src.read_images(spark, str(tmp_path / "f")).collect()
    assert src.sampled(spark.range(100).withColumnRenamed("id", "i"), 0, 0.4).count() == 10


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([(datetime(2024, 1, 1), "S1", 1)], "ts timestamp_ntz, spot_id string, occupied int")
    sinks.append_log(log, f"{tmp_path}/log")
    sinks.append_log(log, f"{tmp_path}/log")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/log").count() == 2
    pixels = bytes(range(192)) * 64
    frames = spark.createDataFrame([("f", bytearray(pixels), 64, 64, {"S1": 1})], "path string, pixels binary, height int, width int, labels map<string,int>")
    square = [(0.0, 0.0), (63.0, 0.0), (63.0, 63.0), (0.0, 63.0)]
    spots = spark.createDataFrame([("S1", square), ("S2", square)], "id string, polygon array<struct<x:double,y:double>>")
    sinks.write_crops(frames, spots, f"{tmp_path}/crops")
    assert {r.label for r in spark.read.parquet(f"{tmp_path}/crops").select("label").collect()} == {"occupied", "unlabeled"}
    patches = frames.select(F.col("path").alias("key"), "pixels", "height", "width")
    small = images.FeatureConfig(blocks=("rgb",))
    one = sinks.cached_features(patches, f"{tmp_path}/cache", small)
    assert one.columns == ["key", "height", "width", "rgb"] and sinks.cached_features(patches, f"{tmp_path}/cache", small).count() == 1
    assert len(list((tmp_path / "cache").iterdir())) == 1


def png(rgb):
    """A PNG of an array, uncompressed filters."""
    import struct
    import zlib

    h, w, _ = rgb.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_images_are_rgb_and_train(spark, tmp_path, capsys):
    import numpy as np

    from lotlight import jobs

    one = np.zeros((2, 3, 3), np.uint8) + np.array([10, 20, 30], np.uint8)
    put(tmp_path / "one" / "a.png", png(one))
    r = src.read_images(spark, str(tmp_path / "one")).first()
    assert (r.height, r.width) == (2, 3) and bytes(r.pixels) == one.tobytes()
    rng = np.random.default_rng(0)
    for k in range(48):
        car = k % 2
        img = rng.integers(0, 60, (32, 32, 3)) + np.array([140, 20, 20] if car else [90, 90, 90])
        put(tmp_path / "patches" / f"cam{k % 4}" / ("busy" if car else "free") / f"{k}.png", png(img.astype(np.uint8)))
    jobs.main(["train", "--patches", str(tmp_path / "patches"), "--out", str(tmp_path / "out"), "--features", "rgb", "--models", "logreg", "--cv", "2", "--ensemble", "1"])
    s = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert s.winner == "rgb | logreg" and s.f1 == 1.0
    board = spark.read.option("header", "true").csv(str(tmp_path / "out" / "leaderboard"))
    assert board.count() == 1 and float(board.first().latency_ms) > 0
    model = str(tmp_path / "out" / "models" / "rgb-logreg")
    fitted, sidecar = sinks.load_model(spark, model)
    assert fitted.candidate.name == "rgb | logreg" and sidecar == {"winner": "rgb | logreg"}
    # Two frames of two spots through the saved model: as a batch, and as a stream that smooths nothing.
    for n, left in (("20240101_0800", True), ("20240101_0900", False)):
        img = np.zeros((32, 64, 3)) + np.array([90, 90, 90])
        img[:, (slice(0, 32) if left else slice(32, 64))] = [140, 20, 20]
        put(tmp_path / "frames" / f"{n}.png", png((img + rng.integers(0, 60, img.shape)).astype(np.uint8)))
    square = lambda x: [[x, 0], [x + 31, 0], [x + 31, 31], [x, 31]]
    put(tmp_path / "spots.json", json.dumps({"image_size": [64, 32], "spots": [{"id": "L", "polygon": square(0)}, {"id": "R", "polygon": square(32)}]}))
    common = ["detect", "--frames", str(tmp_path / "frames"), "--spots", str(tmp_path / "spots.json"), "--model", model]
    jobs.main([*common, "--out", str(tmp_path / "batch")])
    log = spark.read.option("header", "true").csv(str(tmp_path / "batch" / "log")).collect()
    assert sorted((r.ts[11:13], r.spot_id, r.occupied) for r in log) == [("08", "L", "1"), ("08", "R", "0"), ("09", "L", "0"), ("09", "R", "1")]
    assert "free=1/2  L:X R:." in capsys.readouterr().out
    jobs.main([*common, "--out", str(tmp_path / "stream"), "--watch"])
    log = spark.read.parquet(str(tmp_path / "stream" / "log")).collect()
    assert sorted((r.ts.hour, r.spot_id, r.occupied) for r in log) == [(8, "L", 1), (8, "R", 0), (9, "L", 0), (9, "R", 1)]


def test_train_detector_job(spark, tmp_path):
    import numpy as np

    from lotlight import jobs

    for site in range(4):
        frames = []
        for k in range(2):
            r = np.random.default_rng(10 * site + k)
            img, (x, y) = r.integers(90, 110, (120, 170, 3)).astype(np.uint8), r.integers(4, 50, 2)
            img[y : y + 64, x : x + 64] = (200, 60, 60)
            img[y + 8 : y + 56, x + 8 : x + 56] = (30, 30, 30)
            put(tmp_path / f"s{site}" / f"i{site}{k}.png", png(img))
            frames.append({"image": f"i{site}{k}.png", "cars": [[int(x), int(y), int(x) + 64, int(y) + 64]], "group": f"s{site}"})
        put(tmp_path / f"s{site}" / "annotations.json", json.dumps({"frames": frames}))
    out = str(tmp_path / "out")
    jobs.main(["train_detector", "--scenes", *[str(tmp_path / f"s{k}") for k in range(4)], "--out", out, "--n-windows", "1", "--max-windows", "20", "--features", "rgb", "--models", "logreg", "--cv", "2", "--ensemble", "1", "--hard-frames", "4", "--ap-top", "1"])
    s = spark.read.json(f"{out}/summary").first()
    assert s.winner == "rgb | logreg" and s.n_gt == 2 and s.recall == 1.0 and s.seconds_per_frame > 0 and s.windows == "[[64, 64]]"
    assert spark.read.option("header", "true").csv(f"{out}/top_ap").count() == 1 and spark.read.text(f"{out}/first_stage").count() == 1
