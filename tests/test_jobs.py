import json
from datetime import datetime, timedelta

import numpy as np

from lotlight import jobs


def test_allot(spark, tmp_path, capsys):
    rows = [(datetime(2026, 9, 1) + timedelta(days=d, hours=h), s, int(s == "B")) for d in range(14) for h in range(24) for s in "AB"]
    spark.createDataFrame(rows, "ts timestamp_ntz, spot_id string, occupied int").write.parquet(f"{tmp_path}/log")
    jobs.main(["allot", "--log", f"{tmp_path}/log", "--start", "2026-09-23T10:00", "--slot-minutes", "60"])
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(f["spot_id"], f["eligible"]) for f in found] == [("A", True), ("B", False)]


def test_follow_goes_on(spark, tmp_path):
    def put(first, n):
        rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=k), "S1", int(k % 4 != 2)) for k in range(first, first + n)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, spot_id string, occupied int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/seen")
        jobs.main(["follow", "--observations", f"{tmp_path}/seen", "--out", f"{tmp_path}/out", "--window", "3"])

    put(0, 10)
    put(10, 10)
    log = spark.read.parquet(f"{tmp_path}/out/log").orderBy("event_id").collect()
    assert [r.event_id for r in log] == list(range(20)) and all(r.smoothed == 1 for r in log)


def test_discover(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    seen = [(0, t, t0 + timedelta(minutes=15 * t), 10.0, 10.0, 50.0, 40.0) for t in range(40) if t < 20] + [(0, t, t0 + timedelta(minutes=15 * t), 90.0, 10.0, 130.0, 40.0) for t in range(40)]
    spark.createDataFrame(seen, "camera int, t int, ts timestamp_ntz, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{tmp_path}/d")
    jobs.main(["discover", "--detections", f"{tmp_path}/d", "--out", f"{tmp_path}/o"])
    assert {(r.id, r.status) for r in spark.read.parquet(f"{tmp_path}/o/spots").collect()} == {("S1", "candidate"), ("S2", "candidate")}
    pixels = []
    for t in range(40):
        img = np.random.default_rng(t).integers(90, 110, (120, 160, 3)).astype(np.uint8)
        for _, tt, _, x1, y1, x2, y2 in seen:
            if tt == t:
                img[int(y1) : int(y2), int(x1) : int(x2)] = 220
                img[int(y1) + 8 : int(y2) - 8, int(x1) + 8 : int(x2) - 8] = 20
        pixels.append((0, t0 + timedelta(minutes=15 * t), bytearray(img.tobytes()), 120, 160))
    spark.createDataFrame(pixels, "camera int, ts timestamp_ntz, pixels binary, height int, width int").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(0, "b", "office", 10.0, 10.0, 50.0, 40.0)], "camera int, bay string, kind string, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{tmp_path}/b")
    jobs.main(["discover", "--detections", f"{tmp_path}/d", "--frames", f"{tmp_path}/f", "--bays", f"{tmp_path}/b", "--out", f"{tmp_path}/o"])
    assert {(r.id, r.status) for r in spark.read.parquet(f"{tmp_path}/o/spots").collect()} == {("S1", "confirmed"), ("S2", "candidate")}
    assert spark.read.option("header", "true").csv(f"{tmp_path}/o/evaluation").first().recall == "1.0"


def test_replay(spark, tmp_path):
    rows = [(datetime(2026, 9, 1) + timedelta(days=d, hours=h), s, int(s == "B"), int(s == "B")) for d in range(14) for h in range(24) for s in "AB"]
    spark.createDataFrame(rows, "ts timestamp_ntz, spot_id string, occupied int, truth int").write.parquet(f"{tmp_path}/log")
    jobs.main(["replay", "--log", f"{tmp_path}/log", "--out", f"{tmp_path}/out", "--test-days", "2", "--slot-minutes", "60", "--thresholds", "0.5"])
    arms = {r.arm: r for r in spark.read.option("header", "true").csv(f"{tmp_path}/out/sweep").collect()}
    assert arms["0.5"].rate == "1.0" and arms["free now"].rate == "1.0" and int(arms["free now"].n_booked) == 2
