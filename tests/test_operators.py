import itertools
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotlight.functions.boxes import iou, order_quad
from lotlight.functions.time import window_cells
from lotlight.operators import availability as av
from lotlight.operators import box_algorithms as ba
from lotlight.operators import detector as det
from lotlight.operators import discovery, images, intervals, learning, metrics, sequences, simulation
from lotlight.operators import frames as fr


def day_log(days=21, spots=6, seed=2):
    """Residents away at work on weekdays, at home at night and at weekends; a few never move."""
    r, start, rows = np.random.default_rng(seed), datetime(2026, 9, 1), []
    for s in range(spots):
        for d in range(days):
            day = start + timedelta(days=d)
            leaves, back = 7 + r.uniform(0, 2), 16 + r.uniform(0, 2)
            home = day.weekday() >= 5 or s == 5
            for k in range(96):
                h = k / 4
                rows.append((day + timedelta(hours=h), f"S{s + 1}", int(home or not leaves < h < back)))
    return pd.DataFrame(rows, columns=["ts", "spot_id", "occupied"])


@pytest.fixture(scope="module")
def grid(spark):
    log = spark.createDataFrame(day_log(), "ts timestamp_ntz, spot_id string, occupied int")
    return av.slot_grid(log, 30).persist()


def candidates(spark, grid, start, hours, bookings=(), declared=(), live=None, **kw):
    asked = spark.createDataFrame([(1, start, start + timedelta(hours=hours))], "request int, start timestamp_ntz, end timestamp_ntz")
    spans = "spot_id string, start timestamp_ntz, end timestamp_ntz"
    live = live and spark.createDataFrame([(1, s, v) for s, v in live.items()], "request int, spot_id string, occupied int")
    return av.candidates(grid, asked, 30, spark.createDataFrame(list(bookings), spans), spark.createDataFrame(list(declared), spans), live, **kw)


def test_profile(grid):
    p = av.profile(grid, 30).toPandas()
    week = p[(p.day_type == "weekday")]
    assert len(p) == 6 * 2 * 48
    assert week[week.slot.between(20, 27)].p_free.max() > 0.7 and week[week.slot.between(2, 9)].p_free.max() < 0.2


def test_scheduler_properties(spark, grid):
    noon, night = datetime(2026, 9, 23, 10), datetime(2026, 9, 23, 23)
    taken = []
    for _ in range(6):
        top = av.top_candidate(candidates(spark, grid, noon, 3, taken)).collect()
        if not top:
            break
        assert top[0].spot_id not in {b[0] for b in taken}
        taken.append((top[0].spot_id, noon, noon + timedelta(hours=3)))
    assert len(taken) == 5
    assert not av.top_candidate(candidates(spark, grid, night, 2)).collect()
    declared = [("S1", night - timedelta(hours=1), night + timedelta(hours=2))]
    assert [r.spot_id for r in av.top_candidate(candidates(spark, grid, night, 2, declared=declared)).collect()] == ["S1"]
    assert not av.top_candidate(candidates(spark, grid, night, 2, declared=declared, live={"S1": 1})).collect()


def reference_free(log, start, end, minutes):
    """The window rule in plain Python."""
    log = log.assign(day=log.ts.dt.date, slot=(log.ts.dt.hour * 60 + log.ts.dt.minute) // minutes)
    cell = log.groupby(["spot_id", "day", "slot"]).occupied.max().to_dict()
    t, steps = pd.Timestamp(start).floor(f"{minutes}min"), []
    while t < end:
        steps.append(((t.date() - start.date()).days, (t.hour * 60 + t.minute) // minutes))
        t += pd.Timedelta(minutes=minutes)
    out = {}
    for spot, own in log.groupby("spot_id"):
        n = ok = 0
        for day in sorted(own.day.unique()):
            if (day.weekday() >= 5) != (start.weekday() >= 5):
                continue
            seen = [cell.get((spot, day + timedelta(days=o), s)) for o, s in steps]
            if steps and sum(v is None for v in seen) / len(seen) > 0.25:
                continue
            n, ok = n + 1, ok + (not any(seen))
        out[spot] = ((ok + 0.5) / (n + 1) if n else None, n, ok)
    return out


@pytest.mark.parametrize("start,hours", [(datetime(2026, 9, 23, 10, 10), 2), (datetime(2026, 9, 23, 22), 6), (datetime(2026, 9, 26, 9), 3), (datetime(2026, 9, 23, 10), 0)])
def test_window_rule(spark, start, hours):
    log = day_log(10, 3).sample(frac=0.5, random_state=1)
    grid = av.slot_grid(spark.createDataFrame(log, "ts timestamp_ntz, spot_id string, occupied int"), 30)
    end = start + timedelta(hours=hours)
    got = {r.spot_id: (r.p_free, r.n_days, r.free_days) for r in av.window_free_prob(grid, av.one_window(spark, start, end), 30).collect()}
    assert got == reference_free(log, start, end, 30)


def test_allocation_never_overlaps(spark):
    t = datetime(2026, 9, 23, 8)
    rows = [("d", k, s, t + timedelta(minutes=20 * k), t + timedelta(minutes=20 * k + 60), 0.9 - r / 10, True, r) for k in range(12) for r, s in enumerate("ABC", 1)]
    ranked = spark.createDataFrame(rows, "day string, request int, spot_id string, start timestamp_ntz, end timestamp_ntz, confidence double, eligible boolean, rank int")
    out = av.allocate(ranked).collect()
    assert len(out) == 12
    for a, b in itertools.combinations(out, 2):
        assert a.spot_id != b.spot_id or a.end <= b.start or b.end <= a.start


def test_slots_cross_midnight(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23, 10), datetime(2024, 1, 2, 0, 40))], "a timestamp_ntz, b timestamp_ntz")
    cells = df.select(window_cells(F.col("a"), F.col("b"), 30).alias("c"), window_cells(F.col("a"), F.col("a"), 30).alias("one")).first()
    assert [tuple(x) for x in cells.c] == [(0, 46), (0, 47), (1, 0), (1, 1)] and len(cells.one) == 1
    with pytest.raises(ValueError):
        window_cells(F.col("a"), F.col("b"), 50)


def test_asof_prefers_the_earlier(spark):
    t = datetime(2024, 1, 1, 12)
    asked = spark.createDataFrame([(1, t)], "request int, start timestamp_ntz")
    frames = spark.createDataFrame([(t - timedelta(minutes=5),), (t + timedelta(minutes=5),)], "ts timestamp_ntz")
    assert intervals.asof(asked, frames).first().frame_ts == t - timedelta(minutes=5)


def test_latest_like_a_loop(spark):
    """Last status, overlaps and containments far apart in time, with ties, against loops over all pairs."""
    r, t0 = np.random.default_rng(3), datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(minutes=int(r.integers(0, 40)) * 720)
    log = [(s, when(), int(r.integers(0, 2))) for s in "AB" for _ in range(12)] + [("C", t0 + timedelta(days=1), 1)]
    asks = [(k, when()) for k in range(40)]
    spans = [(str(r.choice(list("AB"))), a, a + timedelta(minutes=int(r.integers(0, 3000)))) for a in (when() for _ in range(15))]
    wanted = [(k, "AB"[k % 2], a, a + timedelta(minutes=int(r.integers(0, 1500)))) for k, a in asks]
    q = spark.createDataFrame(asks, "request int, start timestamp_ntz")
    seen = spark.createDataFrame(log, "spot_id string, ts timestamp_ntz, occupied int")
    got = {(x.request, x.spot_id): x.occupied for x in intervals.live_status(q, seen).collect()}
    assert got == {(k, s): max(((t, o) for x, t, o in log if x == s and t <= a), default=(None, 0))[1] for k, a in asks for s in "ABC"}
    frames = spark.createDataFrame([(t,) for _, t, _ in log[:5]], "ts timestamp_ntz")
    times = [t for _, t, _ in log[:5]]
    got = {x.request: x.frame_ts for x in intervals.asof(q, frames).collect()}
    assert got == {k: min(times, key=lambda t: (abs(t - a), t)) for k, a in asks}
    got = {x.request: x.frame_ts for x in intervals.asof(q, frames, "backward").collect()}
    assert got == {k: max((t for t in times if t <= a), default=None) for k, a in asks}
    rows = "spot_id string, start timestamp_ntz, end timestamp_ntz"
    w, b = spark.createDataFrame(wanted, "request int, " + rows), spark.createDataFrame(spans, rows)
    assert sorted(x.request for x in av.booked(w, b).collect()) == [k for k, s, x, y in wanted if any(s == z and a < y and x < e for z, a, e in spans)]
    assert sorted(x.request for x in av.declared(w, b).collect()) == [k for k, s, x, y in wanted if any(s == z and a <= x and y <= e for z, a, e in spans)]
    truth = spark.createDataFrame([(s, t, o - (k % 5 == 0)) for k, (s, t, o) in enumerate(log)], "spot_id string, ts timestamp_ntz, truth int")
    facts = [(s, t, o - (k % 5 == 0)) for k, (s, t, o) in enumerate(log)]
    got = {x.booking: x.stayed_free for x in intervals.stayed_free(w.withColumnRenamed("request", "booking"), truth).collect()}
    want = {k: [v == 0 for z, t, v in facts if z == s and v >= 0 and x <= t < y] for k, s, x, y in wanted}
    assert got == {k: all(v) if v else None for k, v in want.items()}


def test_smoother_and_runs(spark):
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", t + timedelta(minutes=k), v) for k, v in enumerate([1, 1, 0, 1, 1])], "spot_id string, ts timestamp_ntz, occupied int")
    assert [r.smoothed for r in sequences.majority(log, 3).orderBy("ts").collect()] == [1] * 5
    p = sequences.presence(spark.createDataFrame([("a", t + timedelta(minutes=k), v) for k, v in enumerate([1, 1, 0, 1])], "spot_id string, ts timestamp_ntz, present int"))
    assert [(r.present, r.first, r.last) for r in sequences.runs(p).orderBy("run").collect()] == [(1, 0, 1), (0, 2, 2), (1, 3, 3)]


def loop_stays(x, step, min_absence, min_stay, density):
    """Bridging, stays and transitions by a loop."""
    def runs(v):
        at = [0, *[k for k in range(1, len(v)) if v[k] != v[k - 1]], len(v)]
        return [(v[a], a, b - 1) for a, b in zip(at, at[1:])]

    raw, x = x, list(x)
    for v, a, b in runs(raw):
        if not v and a and b < len(x) - 1 and (b - a + 1) * step < min_absence:
            x[a : b + 1] = [1] * (b - a + 1)
    r, out = runs(x), []
    long = lambda k: 0 <= k < len(r) and (r[k][2] - r[k][1] + 1) * step >= min_absence
    for k, (v, a, b) in enumerate(r):
        if v and (b - a + 1) * step >= min_stay and np.mean(raw[a : b + 1]) >= density:
            out.append((a, b, long(k + 1), long(k - 1)))
    return out


def test_stays_like_a_loop(spark):
    r, t, rows, want = np.random.default_rng(0), datetime(2024, 1, 1), [], {}
    for s in range(25):
        x = [int(v) for v in np.repeat(r.integers(0, 2, 20), r.integers(1, 6, 20))[:50]]
        rows += [(f"s{s}", t + timedelta(minutes=15 * k), v) for k, v in enumerate(x)]
        want[f"s{s}"] = loop_stays(x, 15, 30, 45, 0.75)
    p = sequences.bridged(sequences.presence(spark.createDataFrame(rows, "spot_id string, ts timestamp_ntz, present int")), 30)
    got = {s: [] for s in want}
    for q in sequences.stays(p, 45, 0.75, 30).where("stay").orderBy("spot_id", "first").collect():
        got[q.spot_id].append((q.first, q.last, q.departure, q.arrival))
    assert got == want


def test_boxes(spark):
    assert ba.iou_matrix([[0, 0, 10, 10]], [[5, 5, 15, 15]])[0, 0] == pytest.approx(25 / 175)
    b = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30.0]])
    assert set(ba.suppress(b, np.array([0.9, 0.8, 0.7]), 0.3)) == {0, 2}
    mean, _ = ba.vote(b, np.array([0.6, 0.4, 0.7]), 0.3)
    assert any(np.allclose(m, [0.4, 0.4, 10.4, 10.4]) for m in mean)
    one = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0))], "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert one.select(iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(25 / 175)
    quad = spark.createDataFrame([([(9.0, 8.0), (1.0, 9.0), (0.0, 1.0), (10.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [tuple(x) for x in quad.select(order_quad(F.col("p"))).first()[0]] == [(0, 1), (10, 0), (9, 8), (1, 9)]
    truth, ignore = np.array([[0, 0, 10, 10.0]]), np.array([[20, 20, 30, 30.0]])
    assert ba.match_greedy(b, np.array([0.9, 0.8, 0.7]), truth, 0.5, ignore) == [(0, 0, True), (1, -1, False)]


def test_assignment_is_best():
    r = np.random.default_rng(1)
    for _ in range(200):
        g = r.random((r.integers(1, 5), r.integers(1, 6)))
        t = g if g.shape[0] <= g.shape[1] else g.T
        best = max(sum(t[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
        assert sum(g[i, j] for i, j in ba.assign(g)) == pytest.approx(best)


def test_features():
    c = images.FeatureConfig()
    r = np.random.default_rng(0)
    f = images.extract(r.integers(0, 256, (80, 100, 3), np.uint8))
    assert {k: len(v) for k, v in f.items()} == c.widths() == {"hog": 1764, "lbp": 28, "glcm": 36, "rgb": 48, "hsv": 50}
    assert sum(map(len, f.values())) == 1926 and all(np.isfinite(v).all() for v in f.values())
    assert f["rgb"].reshape(3, 16).sum(1) == pytest.approx(1) and f["lbp"][:10].sum() == pytest.approx(1)
    assert images.FeatureConfig.from_dict(__import__("json").loads(__import__("json").dumps(c.to_dict()))) == c
    assert len(c.columns("texture+color")) == 28 + 36 + 48 + 50
    assert all(np.isfinite(v).all() for v in images.extract(np.zeros((64, 64), np.uint8)).values())
    red = np.zeros((4, 4, 3), np.uint8) + np.array([255, 0, 0], np.uint8)
    assert images.hsv(red)[0, 0].tolist() == [0, 255, 255] and images.gray(red)[0, 0] == 76
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (64, 1, 3))
    assert np.abs(images.warp(ramp, [(0, 0), (63, 0), (63, 63), (0, 63)]).astype(int) - ramp).max() <= 1
    parts = images.cut(ramp, np.array([(-5, -5, 2, 2), (2.5, 3.5, 90, 70), (70, 0, 80, 10)]))
    assert parts[0] is None and parts[2] is None and parts[1].shape == (60, 62, 3)
    thumb, scale = images.thumbnail(np.zeros((300, 960, 3), np.uint8))
    assert thumb.shape == (150, 480) and scale == 0.5
    look = images.looks(ramp[..., 0], np.array([(0, 0, 40, 40), (0, 0, 3, 3)]))
    assert abs(look[0].mean()) < 1e-9 and abs(look[0].std() - 1) < 1e-3 and look[1] is None


def scene(cars, seed=0, size=(160, 240)):
    """A dull road with bright ringed rectangles for cars."""
    r = np.random.default_rng(seed)
    img = r.integers(90, 110, (*size, 3)).astype(np.uint8)
    for x1, y1, x2, y2 in np.asarray(cars, int).reshape(-1, 4):
        img[y1:y2, x1:x2] = (200, 60, 60)
        img[y1 + 8 : y2 - 8, x1 + 8 : x2 - 8] = (30, 30, 30)
    return img


def shots(spark, cars, seed=0):
    """Scenes as a DataFrame: path, pixels, height, width, cars, negatives, ignore, random_negatives."""
    rows = []
    for k, c in enumerate(cars):
        img = scene(c, seed + k)
        rows.append((f"f{seed + k}", bytearray(img.tobytes()), *img.shape[:2], [[float(v) for v in b] for b in c], [], [], True))
    boxes = "array<array<double>>"
    return spark.createDataFrame(rows, f"path string, pixels binary, height int, width int, cars {boxes}, negatives {boxes}, ignore {boxes}, random_negatives boolean")


@pytest.fixture(scope="module")
def trained(spark):
    c = images.FeatureConfig(blocks=("hog", "rgb"))
    more = [[[float(x), float(y), x + 64.0, y + 64.0]] for x, y in ((9, 57), (40, 12), (95, 33), (160, 80), (130, 20), (77, 51))]
    train = shots(spark, [[[20, 30, 84, 94]], [[120, 60, 184, 124]], [[60, 80, 124, 144], [150, 8, 214, 72]], *more])
    patches = det.sample_patches(train, [(64, 64)]).persist()
    rows = det.with_features(images.feature_frame(patches, c).drop("pixels"), c).withColumn("label", F.col("label").cast("double"))
    fitted = learning.Candidate("all | logreg", list(range(sum(c.widths().values()))), "logreg").fit(rows)
    return c, patches, det.fit_scorer(patches), fitted


def test_detector_finds_cars(spark, trained):
    c, patches, scorer, fitted = trained
    counts = {(r.path, r.label): r["count"] for r in patches.groupBy("path", "label").count().collect()}
    assert {counts[f"f{k}", 1] for k in (0, 1)} == {4} and counts["f2", 1] == 8 and all(0 < counts[f"f{k}", 0] <= 30 for k in range(3))
    d = det.DetectorConfig(max_windows=80)
    test = shots(spark, [[[80, 48, 144, 112]], [[16, 56, 80, 120]], []], 30)
    windows = det.scored(test, scorer, fitted, d, c).persist()
    found = det.detect(windows, d).orderBy(F.desc("score")).collect()
    best = {r.frame: [r.x1, r.y1, r.x2, r.y2] for r in reversed(found)}
    assert ba.iou_matrix([best["f30"]], [[80, 48, 144, 112]])[0, 0] > 0.5 and ba.iou_matrix([best["f31"]], [[16, 56, 80, 120]])[0, 0] > 0.5
    hard = det.hard_negatives(windows, test, 0.01, 3)
    near = {r.path: max(ba.iou_matrix([[r.x1, r.y1, r.x2, r.y2]], [[80, 48, 144, 112.0]]).max(), 0) for r in hard.collect() if r.path == "f30"}
    assert all(v < 0.3 for v in near.values())
    assert det.cut_windows(test, windows.where("n < 2")).where("height = 64 AND width = 64").count() == windows.where("n < 2").count()
    ap = det.average_precision(det.detect(windows, d), test).first()
    assert ap.n_gt == 2 and ap.recall == 1.0 and ap.ap > 0.4
    nothing = det.average_precision(det.detect(windows.where("false"), d), test).first()
    assert (nothing.ap, nothing.precision, nothing.recall, nothing.n_gt) == (0.0, 0.0, 0.0, 2)


def test_hard_negatives_on_spaces(spark):
    boxes = "array<array<double>>"
    scenes = spark.createDataFrame([("a", [[0.0, 0.0, 10.0, 10.0]], [[20.0, 0.0, 30.0, 10.0]], [[40.0, 0.0, 50.0, 10.0]], False), ("b", [], [], [], True)], f"path string, cars {boxes}, negatives {boxes}, ignore {boxes}, random_negatives boolean")
    w = [("a", 0, 1.0, 0.0, 11.0, 10.0, 0.9), ("a", 1, 21.0, 0.0, 31.0, 10.0, 0.8), ("a", 2, 41.0, 0.0, 51.0, 10.0, 0.7), ("a", 3, 60.0, 0.0, 70.0, 10.0, 0.6), ("b", 0, 0.0, 0.0, 5.0, 5.0, 0.31), ("b", 1, 0.0, 0.0, 5.0, 5.0, 0.29)]
    windows = spark.createDataFrame(w, "path string, n int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted((r.path, r.n) for r in det.hard_negatives(windows, scenes).collect()) == [("a", 1), ("b", 0)]


def test_frames_to_log(spark, trained):
    c, _, _, fitted = trained
    test = shots(spark, [[[80, 48, 144, 112]], [[10, 60, 74, 124]]], 20).select((F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(mins=F.substring("path", 2, 9).cast("int"))).cast("timestamp_ntz").alias("ts"), "pixels", "height", "width")
    square = lambda x, y: [(x, y), (x + 32.0, y), (x + 32.0, y + 32.0), (x, y + 32.0)]
    spots = spark.createDataFrame([("A", square(40.0, 24.0), 120, 80), ("B", square(5.0, 30.0), 120, 80)], "id string, polygon array<struct<x:double,y:double>>, width int, height int")
    log = fr.classify(test, spots, fitted.score, config=c)
    assert {(r.ts.minute, r.spot_id): r.occupied for r in log.collect()} == {(20, "A"): 1, (20, "B"): 0, (21, "A"): 0, (21, "B"): 1}
    assert [r.line.split("  ", 1)[1] for r in fr.status_lines(log).orderBy("ts").collect()] == ["free=1/2  A:X B:.", "free=1/2  A:. B:X"]


def loop_sites(frames, match_iou, merge_iou, most):
    """The definition of sites, worked out anew at each step."""
    sites = []
    middle = lambda s: np.median([b for _, b in s], axis=0)
    for t, boxes in enumerate(frames):
        pairs = dict(ba.match_best(boxes, np.array([middle(s) for s in sites]).reshape(-1, 4), match_iou))
        old = len(sites)
        sites += [[(t, b)] for i, b in enumerate(boxes) if i not in pairs]
        for i, j in pairs.items():
            assert j < old
            sites[j].append((t, boxes[i]))
    while True:
        mid = np.array([middle(s) for s in sites]).reshape(-1, 4)
        o, seen = ba.iou_matrix(mid, mid), [{t for t, _ in s} for s in sites]
        ok = [(-o[i, j], i, j) for i in range(len(sites)) for j in range(i + 1, len(sites)) if o[i, j] >= merge_iou and len(seen[i] & seen[j]) <= most * min(len(seen[i]), len(seen[j]))]
        if not ok:
            return [(middle(s).tolist(), len(s)) for s in sites]
        _, i, j = min(ok)
        sites[i] += sites.pop(j)


def test_sites_like_a_loop():
    r = np.random.default_rng(7)
    for _ in range(25):
        places = r.uniform(0, 60, (5, 2))
        frames = []
        for _ in range(12):
            at = places[r.random(5) < 0.6] + r.uniform(-6, 6, (1, 2))
            at = at + r.uniform(-4, 4, at.shape)
            frames.append(np.hstack([at, at + r.uniform(15, 25, at.shape)]))
        got = [(s["box"].tolist(), len(s["members"])) for s in ba.track(frames, 0.5, 0.2, 0.3)]
        want = loop_sites(frames, 0.5, 0.2, 0.3)
        assert [n for _, n in got] == [n for _, n in want] and np.allclose([b for b, _ in got], [b for b, _ in want])
    assert ba.track([np.empty((0, 4))]) == []


def test_discovery(spark):
    """A bay that is used, one that never changes, one that is empty; and cars that pass."""
    r, t0 = np.random.default_rng(0), datetime(2024, 1, 1, 8)
    det, frames = [], []
    for t in range(60):
        frames.append((0, t, t0 + timedelta(minutes=15 * t)))
        shake = lambda b: [float(v) for v in np.array(b) + r.uniform(-1, 1, 4)]
        if t < 20 or t >= 40:
            det.append((0, t, *shake([10, 10, 50, 40])))
        det.append((0, t, *shake([100, 10, 140, 40])))
        if t % 17 == 3:
            det.append((0, t, *shake([200 + t, 100, 240 + t, 130])))
    d = spark.createDataFrame(det, "camera int, t int, x1 double, y1 double, x2 double, y2 double")
    f = spark.createDataFrame(frames, "camera int, t int, ts timestamp_ntz")
    sites = discovery.find_sites(d).persist()
    _, blind = discovery.analyse(sites, f, d)
    assert {r.status for r in blind.collect()} <= {"candidate", "dropped"}
    pixels = []
    for _, t, ts in frames:
        img = np.random.default_rng(t).integers(90, 110, (240, 320, 3)).astype(np.uint8)
        for c, tt, x1, y1, x2, y2 in det:
            if tt == t:
                img[int(y1) : int(y2), int(x1) : int(x2)] = 200
                img[int(y1) + 8 : int(y2) - 8, int(x1) + 8 : int(x2) - 8] = 30
        pixels.append((0, t, ts, bytearray(img.tobytes()), 240, 320))
    shot = spark.createDataFrame(pixels, "camera int, t int, ts timestamp_ntz, pixels binary, height int, width int")
    presence, summary = discovery.analyse(sites, shot, d)
    spots = discovery.named_spots(sites, summary, 320, 240).collect()
    assert [(s.id, s.status, s.n_stays, s.n_departures, s.n_arrivals) for s in sorted(spots, key=lambda s: s.id)] == [("S1", "confirmed", 2, 1, 1), ("S2", "candidate", 1, 0, 0)]
    first = {s.id: s for s in spots}["S1"]
    look = lambda times: np.mean([images.looks(*(lambda th: (th[0], np.array([first.car_box]) * th[1]))(images.thumbnail(np.frombuffer(pixels[t][3], np.uint8).reshape(240, 320, 3))))[0] for t in times], 0)
    want = 1 - np.corrcoef(look(range(20)), look(range(20, 40)))[0, 1]
    got = summary.where(F.col("spot_id") == first.spot_id).first()
    assert abs(got.max_change - want) < 0.05 and got.verified_departures == got.verified_arrivals == 1 and got.detections == 40
    log = discovery.occupancy_log(presence, spark.createDataFrame([(s.spot_id, s.id) for s in spots], "spot_id string, id string"))
    assert log.where("spot_id = 'S1'").agg(F.sum("occupied")).first()[0] == 40 and log.count() == 120
    bays = spark.createDataFrame([(0, "b1", "office", 8.0, 9.0, 52.0, 42.0), (0, "b2", "static", 98.0, 9.0, 142.0, 41.0), (0, "b3", "unused", 200.0, 200.0, 240.0, 230.0)], "camera int, bay string, kind string, x1 double, y1 double, x2 double, y2 double")
    one, table = discovery.evaluate(discovery.named_spots(sites, summary, 320, 240), bays)
    r = one.first()
    assert (r.n_bays, r.n_discovered, r.n_confirmed, r.precision, r.precision_confirmed) == (3, 2, 1, 1.0, 1.0) and abs(r.recall - 2 / 3) < 1e-9
    assert {(r.bay, r.found, r.spot_id, r.status) for r in table.collect()} == {("b1", True, "S1", "confirmed"), ("b2", True, "S2", "candidate"), ("b3", False, None, None)}


def loop_ap(hits, n_gt):
    """Precision at each distinct score, the largest at or below it, times what the score adds to recall."""
    scores = sorted({s for s, _ in hits}, reverse=True)
    at = [(sum(h for s, h in hits if s >= x), sum(1 for s, _ in hits if s >= x)) for x in scores]
    p = [a / b for a, b in at]
    return sum((at[k][0] - (at[k - 1][0] if k else 0)) * max(p[k:]) for k in range(len(at))) / max(n_gt, 1)


def test_groups_of_cached_unions(spark):
    """A union of a cached part and another, both dealt by the key, is dealt anew before its groups are made."""
    from lotlight.operators.grouping import map_groups

    part = lambda k: spark.createDataFrame([(x, k) for x in range(20)], "key int, n int").repartition(4, "key")
    one = part(0).persist()
    one.count()
    both = one.unionByName(part(1).groupBy("key").agg(F.max("n").alias("n")))
    out = map_groups(both, "key", ["n"], lambda c: [(int(c["key"][0]), len(c["n"]))], "key int, size int").collect()
    assert sorted(map(tuple, out)) == [(x, 2) for x in range(20)]


def test_average_precision(spark):
    r = np.random.default_rng(2)
    rows = [(f"g{k % 3}", int(r.integers(0, 40)) / 40, int(r.random() < 0.5)) for k in range(200)]
    n_gt = spark.createDataFrame([("g0", 50), ("g1", 40), ("g2", 60), ("none", 3)], "g string, n_gt long")
    out = {x.g: x for x in metrics.average_precision(spark.createDataFrame(rows, "g string, score double, hit int"), n_gt, ["g"], 7).collect()}
    for g, n in (("g0", 50), ("g1", 40), ("g2", 60)):
        own = [(s, h) for k, s, h in rows if k == g]
        assert abs(out[g].ap - loop_ap(own, n)) < 1e-9 and abs(out[g].precision - sum(h for _, h in own) / len(own)) < 1e-9 and abs(out[g].recall - sum(h for _, h in own) / n) < 1e-9
    assert (out["none"].ap, out["none"].precision, out["none"].recall, out["none"].n_gt) == (0.0, 0.0, 0.0, 3)


def test_selection_protocol(spark):
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(1)
    x = r.normal(size=(240, 4))
    y = ((x[:, 0] + 0.3 * x[:, 1] + r.normal(scale=0.5, size=240)) > 0).astype(float)
    rows = [(f"k{k}", f"g{k % 8}", float(y[k]), [float(v) * (1000 if j == 1 else 1) for j, v in enumerate(x[k])]) for k in range(240)]
    df = spark.createDataFrame(rows, "key string, grp string, label double, v array<double>").select("key", "grp", "label", array_to_vector("v").alias("features"))
    tried = [learning.Candidate("all | logreg", [0, 1, 2, 3], "logreg"), learning.Candidate("noise | logreg", [2, 3], "logreg"), learning.Candidate("all | rf", [0, 1, 2, 3], "rf", small=True)]
    s = learning.run_selection(df, tried, k=3, ensemble_top=2, tune_top=1, grids={"logreg": {"C": [1e-6, 10]}, "rf": {"numTrees": [5]}})
    board = {b.candidate: b for b in s.board.collect()}
    assert {b for b in board if "tuned" in b} and {b for b in board if b.startswith("ensemble[")} and all(b.latency_ms > 0 for b in board.values())
    assert s.winner in board and s.top.count() == 5 and s.test.first().f1 > 0.7 and board["noise | logreg"].cv_f1 < board["all | logreg"].cv_f1
    best, f1 = learning.tune(learning.folds(df, "grp", "label", "key", 3), tried[0], 3, {"C": [1e-9, 1.0]})
    assert best == {"C": 1.0} and f1 > 0.7
    n = learning.subsample(df, "key", "label", 30).groupBy("label").count().collect()
    assert {x["count"] for x in n} == {30}
    dealt = learning.folds(df.withColumn("grp", F.lit("one")), "grp", "label", "key", 4).groupBy("fold", "label").count().collect()
    assert len(dealt) == 8 and max(x["count"] for x in dealt) - min(x["count"] for x in dealt) < 25


def test_replay(spark):
    log = day_log(21, 4, 5)
    log["truth"] = log.occupied
    df = spark.createDataFrame(log, "ts timestamp_ntz, spot_id string, occupied int, truth int")
    made, total = simulation.replay(df, 7, 2, 30, [0.5, 0.9])
    made, rates = made.collect(), {r.arm: r for r in total.collect()}
    assert set(rates) == {"0.5", "0.9", "free now"} and rates["0.9"].n_booked <= rates["0.5"].n_booked and rates["0.9"].rate >= 0.7
    for a, b in itertools.combinations([m for m in made if m.arm == "0.5"], 2):
        assert a.spot_id != b.spot_id or a.end <= b.start or b.end <= a.start
    naive = [(m.start.date(), m.spot_id) for m in made if m.arm == "free now"]
    assert len(naive) == len(set(naive)) and naive


def test_features_of_many_patches_are_those_of_each():
    from lotlight.operators import images

    r = np.random.default_rng(5)
    patches = [r.integers(0, 256, s, np.uint8) for s in ((64, 64, 3), (64, 64, 3), (50, 70, 3), (80, 33), (64, 64, 3))]
    c = images.FeatureConfig()
    made = images.extract_all(patches, c)
    for k, p in enumerate(patches):
        own = images.extract(p, c)
        assert all(np.array_equal(own[b], made[b][k]) for b in c.blocks)
    g = r.integers(0, 256, (3, 40, 56), np.uint8)
    gy, gx = np.zeros(g.shape), np.zeros(g.shape)
    gy[:, 1:-1], gx[:, :, 1:-1] = g[:, 2:] - g[:, :-2].astype(float), g[:, :, 2:] - g[:, :, :-2].astype(float)
    bins = np.minimum(np.rad2deg(np.arctan2(gy, gx)) % 180 * 9 / 180, 8).astype(int)
    cells = np.array([[[[np.hypot(gy, gx)[n, y : y + 8, x : x + 8][bins[n, y : y + 8, x : x + 8] == b].sum() for b in range(9)] for x in range(0, 56, 8)] for y in range(0, 40, 8)] for n in range(3)]) / 64
    v = np.concatenate([cells[:, i : i + 4, j : j + 6] for i in range(2) for j in range(2)], -1)
    for _ in range(2):
        v = np.minimum(v / np.sqrt((v**2).sum(-1, keepdims=True) + 1e-10), 0.2)
    assert np.allclose(images.hog_blocks(g, c), v / np.sqrt((v**2).sum(-1, keepdims=True) + 1e-10))


def test_drawn_scenes_are_dealt_over_tasks(spark):
    from lotlight.plans.learning_queries import scenes

    s = scenes(spark, "/root/testdata/sf0.001")
    assert s.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert s.count() == scenes(spark, "/root/testdata/sf0.001", False).count()


def test_scorer_from_made_features_is_that_from_pixels(spark):
    r = np.random.default_rng(3)
    rows = [(k % 2, bytearray((r.integers(0, 40, (64, 64, 3)) + (np.arange(64) % 16 * 8)[:, None, None] * (k % 2)).astype(np.uint8).tobytes()), 64, 64) for k in range(24)]
    p = spark.createDataFrame(rows, "label int, pixels binary, height int, width int")
    one, two = det.fit_scorer(p), det.fit_scorer(images.feature_frame(p, images.FeatureConfig(blocks=("hog", "rgb"))).select("label", "hog", "rgb"))
    assert np.allclose(one.weights, two.weights, atol=1e-6) and abs(one.threshold - two.threshold) < 1e-5
    blank = images.extract_all([], images.FeatureConfig())
    assert len(blank["hog"]) == 0  # a frame without a window


def test_first_of_equal_assignments():
    assert ba.assign_first(np.array([[0.5, 0.5, 0.2]])) == [(0, 0)]
    assert sorted(ba.assign_first(np.array([[0.3], [0.3]]))) == [(0, 0)]
    assert sorted(ba.assign_first(np.array([[0.4, 0.4], [0.4, 0.4], [0.4, 0.4]]))) == [(0, 0), (1, 1)]
    assert ba.assign_first(np.zeros((2, 3))) == [] and ba.assign_first(np.empty((0, 2))) == []
    r = np.random.default_rng(0)
    for _ in range(300):
        g = r.integers(0, 4, (r.integers(1, 5), r.integers(1, 5))) / 4
        ways = [w for w in itertools.product(range(-1, g.shape[1]), repeat=g.shape[0]) if len(u := [j for j in w if j >= 0]) == len(set(u)) and all(g[i, j] > 0 for i, j in enumerate(w) if j >= 0)]
        want = min(ways, key=lambda w: (-sum(g[i, j] for i, j in enumerate(w) if j >= 0), [j if j >= 0 else 99 for j in w]))
        assert sorted(ba.assign_first(g)) == [(i, j) for i, j in enumerate(want) if j >= 0]


def test_log_of_zero_and_products_of_single_precision(spark, tmp_path):
    from lotlight.plans.registry import QUERIES

    spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 1.0)], "event_id long, value double").withColumn("user_id", F.lit(1)).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.log_value for r in QUERIES["fn_math"](spark, str(tmp_path)).orderBy("event_id").collect()] == [float("-inf"), float("-inf"), 0.0]
    x = next(v for k in range(500) for v in [np.nextafter(np.float32((k + 0.5) / 1000), np.float32(0))] if v * np.float32(1000) == np.float32(k + 0.5) and float(v) * 1000 < k + 0.5)
    spark.createDataFrame([(1, [0.0] * 8 + [float(x)] * 16)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["prj_columns"](spark, str(tmp_path)).first().block_sum == 16 * round(float(x) * 1000 + 0.5)


def test_presence_draws_no_frame(spark):
    from lotlight.plans.registry import QUERIES

    plan = QUERIES["disc_presence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.catalog.clearCache()
    assert "pixels" not in plan


def test_match_best_with_own_best_columns_is_the_assignment():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.hstack([c := r.uniform(0, 40, (n, 2)), c + r.uniform(5, 30, (n, 2))]) for n in (r.integers(1, 5), r.integers(1, 30)))
        o = ba.iou_matrix(a, b)
        assert sorted(ba.match_best(a, b, 0.3)) == sorted((i, j) for i, j in ba.assign(o) if o[i, j] >= 0.3)


def test_wide_regression_ends_where_all_rows_say(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    from lotlight.operators import linear

    r = np.random.default_rng(6)
    x = (r.normal(size=(400, 6)) * [1, 1, 20, 1, 0, 1] + 3).astype(np.float32)
    y = (x[:, 0] + 0.05 * x[:, 2] + r.normal(size=400) > 4).astype(float)
    df = spark.createDataFrame([(float(b), a[:4].tolist(), a[4:].tolist()) for a, b in zip(x, y)], "label double, one array<float>, two array<float>").repartition(3).persist()
    for begun in (4, 1e9):  # steps that begin at a part of the rows, and at nothing
        monkeypatch.setattr(linear, "START", begun)
        line = linear.fit(df, 10.0, True)
        z, weight = (x - x.mean(0)) / line.deviation, np.where(y == 1, 200 / y.sum(), 200 / (1 - y).sum())
        left = weight * (1 / (1 + np.exp(-line.margins(x.astype(float)))) - y)
        assert np.abs(z.T @ left + 10 * line.weights * line.deviation).max() < 1e-2 and abs(left.sum()) < 1e-2 and line.weights[4] == 0
    c = learning.Candidate("some | logreg", [0, 2, 3, 5], "logreg", {"tol": 1e-12})
    rows = df.select("label", array_to_vector(F.concat("one", "two").cast("array<double>")).alias("features"))
    fitted = c.fit_blocks(df, ["one", "two"])
    own, spark_s = ([s.score for s in f.score(rows).select("score").collect()] for f in (fitted, c.fit(rows)))
    assert np.allclose(own, spark_s, atol=1e-3)
    held = np.array([list(s.features) for s in rows.collect()])
    assert np.allclose(1 / (1 + np.exp(-fitted.line(6).margins(held))), own, atol=1e-9)
    assert learning.Candidate("r", [0], "rf", small=True).fit(rows).line(6) is None


def test_linear_second_stage_scores_in_place(spark, trained):
    c, patches, scorer, fitted = trained
    d, test = det.DetectorConfig(max_windows=40), shots(spark, [[[80, 48, 144, 112]], [[16, 56, 80, 120]]], 40)
    there = det.scored(test, scorer, fitted, d, c)
    assert not {"hog", "features"} & set(det.proposals(test, scorer, d, c, fitted.line(sum(c.widths().values()))).columns)
    want = {(w.path, w.n): w.score for w in fitted.score(det.proposals(test, scorer, d, c)).collect()}
    got = {(w.path, w.n): w.score for w in there.collect()}
    assert want.keys() == got.keys() and len(got) > 0 and all(abs(want[k] - got[k]) < 1e-9 for k in got)


def test_cells_are_all_that_a_scorer_keeps(spark, trained):
    c, patches, scorer, _ = trained
    kept = det.cells_of(patches.select("label", "pixels", "height", "width"), images.FeatureConfig())
    assert {len(r.cells) for r in kept.collect()} == {576}
    made = images.feature_frame(patches, images.FeatureConfig(blocks=("hog",))).select("label", "hog").persist()
    two = det.fit_scorer(made)
    assert np.allclose(scorer.weights, two.weights, atol=1e-4) and abs(scorer.threshold - two.threshold) < 1e-3


def test_forest_is_grown_by_tasks(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from lotlight.operators import forest
    from lotlight.sources import sinks

    r = np.random.default_rng(8)
    x = r.normal(size=(600, 9))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    df = spark.createDataFrame([(k, float(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y))], "key int, label double, v array<double>").select("key", "label", array_to_vector("v").alias("features"))
    train, test = df.where("key < 400"), df.where("key >= 400")
    c = learning.Candidate("all | rf", list(range(9)), "rf", {"numTrees": 40})
    one = c.fit(train.repartition(7))
    assert len(one.model.lengths) == 40 and one.line(9) is None
    got = {s.key: (s.score, s.label) for s in one.score(test).collect()}
    assert len(got) == 200 and np.mean([(s >= 0.5) == b for s, b in got.values()]) > 0.85
    again = {s.key: s.score for s in c.fit(train.repartition(2)).score(test).collect()}
    assert all(again[k] == got[k][0] for k in got)  # however rows are dealt
    sinks.save_model(one, str(tmp_path / "m"))
    loaded = sinks.load_model(spark, str(tmp_path / "m"))[0]
    assert sorted(loaded.model.lengths) == sorted(one.model.lengths)
    assert all(abs(s.score - got[s.key][0]) < 1e-12 for s in loaded.score(test).collect())


def test_tree_of_a_forest_like_a_loop():
    from lotlight.operators import forest

    r = np.random.default_rng(9)
    bins, y = r.integers(0, 32, (80, 3)).astype(np.uint8), r.integers(0, 2, 80).astype(float)
    own = forest.grow(bins, y, np.random.default_rng(4), 20, 1, 3)
    weight = np.bincount(np.random.default_rng(4).integers(80, size=80), minlength=80)

    def loop(k, rows):  # every split is the best of all features and cuts
        n, h = weight[rows].sum(), (weight * y)[rows].sum()
        assert abs(own["chance"][k] - h / n) < 1e-6
        bad = {}
        for f, c in itertools.product(range(3), range(32)):
            sides = [rows[bins[rows, f] <= c], rows[bins[rows, f] > c]]
            if all(weight[s].sum() for s in sides):
                bad[f, c] = sum((weight * y)[s].sum() * (weight * (1 - y))[s].sum() / weight[s].sum() for s in sides)
        if own["feature"][k] < 0:
            assert h in (0, n) or not bad or min(bad.values()) > h * (n - h) / n - 1e-6
            return
        f, c, left = int(own["feature"][k]), int(own["cut"][k]), int(own["left"][k])
        assert abs(bad[f, c] - min(bad.values())) < 1e-9
        loop(left, rows[bins[rows, f] <= c])
        loop(left + 1, rows[bins[rows, f] > c])

    loop(0, np.flatnonzero(weight))
    got = forest.chances(own, bins)
    assert np.array_equal(got[weight > 0] > 0.5, y[weight > 0] == 1)


def test_no_tree_of_a_forest_reaches_the_driver(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    from lotlight.operators import forest

    r = np.random.default_rng(10)
    df = spark.createDataFrame([(float(r.integers(2)), r.normal(size=5).tolist()) for _ in range(3000)], "label double, v array<double>").select("label", array_to_vector("v").alias("x")).persist()
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()

    def stage(name):
        context.setJobGroup(name, name)
        df.count()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return max(s for j in context.statusTracker().getJobIdsForGroup(name) for s in context.statusTracker().getJobInfo(j).stageIds)

    def sent(*stages):
        total = 0
        for k in range(*stages):
            try:
                total += store.lastStageAttempt(k).resultSize()
            except Exception:  # one that was skipped
                pass
        return total

    first = stage("before forest")
    made = forest.fit(df, trees=100)
    fitted = stage("after forest")
    made.save(spark, str(tmp_path / "m"))
    saved = stage("after save")
    again = forest.Forest.load(spark, str(tmp_path / "m"))
    loaded = stage("after load")
    size = sum(made.lengths) * forest.NODE.itemsize
    assert len(made.lengths) == 100 and again.lengths == made.lengths
    assert 0 < sent(first, fitted) < size / 4 and sent(fitted, saved) < size / 4 and sent(saved, loaded) < size / 4
    one, two = (m.score(df, "x", "s").selectExpr("sum(s)").first()[0] for m in (made, again))
    assert one == two
    df.unpersist()


def test_registered_detector_keeps_every_window():
    from lotlight.plans import learning_queries as lq

    scorer = det.HogScorer(images.FeatureConfig(), np.zeros((7, 7, 36)), 0.0, -1.0)  # lets all pass
    boxes, _ = scorer.best(scene([[20, 30, 84, 94]], 0), lq.DET)
    assert len(boxes) == len(scorer.score(scene([[20, 30, 84, 94]], 0), (64, 64))[0]) > 60


def test_cut_windows_holds_windows_not_pixels(spark):
    test = shots(spark, [[[80, 48, 144, 112]], [[16, 56, 80, 120]]], 30)
    windows = spark.createDataFrame([("f30", 8.0, 8.0, 40.0, 40.0), ("f30", 80.0, 48.0, 144.0, 112.0), ("f31", 0.0, 0.0, 64.0, 32.0)], "path string, x1 double, y1 double, x2 double, y2 double")
    cut = det.cut_windows(test, windows)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [path], [path], Inner, BuildRight" in re.sub(r"#\d+", "", plan) and "Broadcast" not in plan
    there = det.cut_windows(lambda own: test.drop("cars").join(own, "path"), windows)
    whole = lambda df: sorted((r.path, r.height, r.width, bytes(r.pixels)) for r in df.collect())
    assert whole(cut) == whole(there) and [r[:3] for r in whole(cut)] == [("f30", 32, 32), ("f30", 64, 64), ("f31", 32, 64)]


def test_hard_negatives_go_into_both_stages(spark, monkeypatch):
    from lotlight.plans import learning_queries as lq

    fits, fit, second = [], det.fit_scorer, lq._classifier
    empty = [F.col("negatives")[0][k].alias(c) for k, c in enumerate(ba.COLUMNS)]
    monkeypatch.setattr(det, "hard_negatives", lambda windows, scenes, threshold: scenes.select("path", *empty))  # none is found on these few frames
    monkeypatch.setattr(det, "fit_scorer", lambda f: fits.append(f.count()) or fit(f))
    monkeypatch.setattr(lq, "_classifier", lambda f: fits.append(f.count()) or second(f))
    rows = lq.det_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    found, every = [r for r in rows if r.path != "all"], [r for r in rows if r.path == "all"]
    mined = sum(r.n_patches for r in found)
    assert mined == every[0].n_patches and fits == [fits[0], fits[0], fits[0] + mined, fits[0] + mined]
    assert all(r.score <= r.score_before + 0.002 for r in found)


def test_pictures_made_in_place_give_the_changes_of_moved_ones(spark):
    from lotlight.plans import bindings, box_queries as bq

    d = "/root/testdata/sf0.001"
    seen = bindings.camera_frames(spark, d).where("camera < 6").persist()
    sites, frames = discovery.find_sites(seen, bq.LOOSE).persist(), seen.select("camera", "t", "ts").distinct()
    about = seen.groupBy("camera", "t").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("n", F.array(*ba.COLUMNS).alias("b")))), lambda x: x["b"])).alias("about"))
    p, one = discovery.analyse(sites, frames, seen, bq.LOOSE, discovery.Shots(about, bq._picture))
    q, two = discovery.analyse(sites, frames, seen, bq.LOOSE, bindings.drawn(seen, ["camera", "t", "ts"]))
    assert "pixels" not in one._jdf.queryExecution().optimizedPlan().toString()
    one, two = ({r.spot_id: r.asDict() for r in x.collect()} for x in (one, two))
    assert one.keys() == two.keys() and max(r["n_departures"] for r in one.values()) > 0
    for k, r in one.items():
        assert abs(r.pop("max_change") - two[k].pop("max_change")) < 0.005 and r == two[k]
    assert sorted(map(tuple, p.select(q.columns).collect())) == sorted(map(tuple, q.collect()))
    old = sequences.bridged(sequences.presence(discovery.site_presence(sites, frames, seen, bq.LOOSE)), bq.LOOSE.min_absence_minutes)
    assert sorted(map(tuple, p.select(old.columns).collect())) == sorted(map(tuple, old.collect()))
