"""Spot discovery: sites tracked by camera, their presence over all frames, stays, transitions verified by appearance, status, named spots, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlight.functions import boxes as bx
from lotlight.operators import box_algorithms as ba
from lotlight.operators import images, metrics
from lotlight.operators import sequences as sq
from lotlight.operators.grouping import map_groups


@dataclass(frozen=True)
class DiscoveryConfig:
    match_iou: float = 0.5
    merge_iou: float = 0.2
    max_cooccurrence: float = 0.1
    min_stay_minutes: float = 45.0
    min_absence_minutes: float = 30.0
    min_change: float = 0.6
    min_density: float = 0.75
    pad: float = 0.08
    thumb_width: int = 480


@dataclass(frozen=True)
class Shots:
    """Pictures that are made where they are looked at, so that no pixel is moved: rows has camera, t and about, an array of doubles;
    load gives the RGB array of camera, t, ts, about."""

    rows: DataFrame
    load: Callable[[int, int, np.datetime64, np.ndarray], np.ndarray]


def site_presence(sites: DataFrame, frames: DataFrame, detections: DataFrame, c: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """spot_id (camera:site), camera, ts, present: a member was seen, or any box overlaps the site's."""
    s = sites.select("camera", spot_name().alias("spot_id"), bx.box().alias("own"), "frames")
    near = detections.select("camera", "t", bx.box().alias("seen")).join(s, "camera").where(bx.iou(F.col("seen"), F.col("own")) >= c.match_iou).select("spot_id", "t")
    member = s.select("spot_id", F.explode("frames").alias("t"))
    hit = near.union(member).distinct().withColumn("present", F.lit(1))
    every = frames.select("camera", "t", "ts").join(s.select("camera", "spot_id"), "camera")
    return every.join(hit, ["spot_id", "t"], "left").select("spot_id", "camera", "ts", F.coalesce("present", F.lit(0)).alias("present"))


def spot_name() -> Column:
    return F.concat_ws(":", F.col("camera").cast("string"), F.col("site").cast("string"))


def run_looks(frames: DataFrame, asked: DataFrame, width: int = 480) -> DataFrame:
    """spot_id, run, look: the mean over a run's frames of the site's pixels, normalised by frame, as an array.

    `frames` has camera, ts, pixels, height, width; `asked` has a row for each frame
    and run wanted: camera, ts, spot_id, run, x1 to y2. Pixels meet the boxes of
    their frame once, and means are summed before they are shuffled.
    """
    boxes = asked.groupBy("camera", "ts").agg(F.collect_list(F.struct("spot_id", "run", F.array(*ba.COLUMNS).alias("box"))).alias("sites"))  # a camera's sites

    def make(frame: np.ndarray, row: dict) -> list[tuple]:
        thumb, scale = images.thumbnail(frame, width)
        seen = images.looks(thumb, np.array([s["box"] for s in row["sites"]]) * scale)
        return [(s["spot_id"], s["run"], v.tolist()) for s, v in zip(row["sites"], seen) if v is not None]

    seen = images.frame_rows(frames.select("camera", "ts", "pixels", "height", "width").join(boxes, ["camera", "ts"]).drop("camera", "ts"), make, "spot_id string, run int, look array<float>")
    mean = Summarizer.mean(array_to_vector("look"))
    return seen.groupBy("spot_id", "run").agg(vector_to_array(mean).alias("look"))


def changes(runs: DataFrame, presence: DataFrame, sites: DataFrame, frames: DataFrame, c: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """spot_id, run, kind, change: 1 less the correlation of a stay's look and that of the absence after (departure) or before it (arrival)."""
    moves = _moves(runs)
    pairs = moves.select("spot_id", "run", "kind", F.when(F.col("kind") == "departure", F.col("run") + 1).otherwise(F.col("run") - 1).alias("other"))
    wanted = pairs.select("spot_id", "run").union(pairs.select("spot_id", "other")).distinct()
    at = sq.islands(presence, "spot_id", ("i",), "present").select("spot_id", "camera", "ts", "run").join(wanted, ["spot_id", "run"])
    asked = at.join(sites.select(spot_name().alias("spot_id"), *ba.COLUMNS), "spot_id")
    look = run_looks(frames, asked, c.thumb_width).persist()
    both = pairs.join(look.withColumnRenamed("look", "a"), ["spot_id", "run"]).join(look.select("spot_id", F.col("run").alias("other"), F.col("look").alias("b")), ["spot_id", "other"])
    pixels = both.select("spot_id", "run", "kind", F.explode(F.arrays_zip("a", "b")).alias("p")).select("spot_id", "run", "kind", "p.a", "p.b")
    return sq.correlation_change(pixels, ["spot_id", "run", "kind"])


def _moves(runs: DataFrame) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("departure"), F.lit("departure")), F.when(F.col("arrival"), F.lit("arrival"))))
    return runs.select("spot_id", "run", F.explode(kinds).alias("kind"))


def _runs(row: np.ndarray, us: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last frame of each run of equal values, and its minutes."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    last = np.append(first[1:], len(row)) - 1
    return first, last, (us[last] - us[first]) / 60e6 + step


class _Turns:
    """A site's runs, seen frame by frame: how unlike each run's mean look is to the one's before it."""

    def __init__(self, first: np.ndarray, wanted: np.ndarray) -> None:
        """first: of each run; wanted: the runs whose looks are asked for."""
        self.first, self.wanted, self.change = first, wanted, np.zeros(len(first))
        self.runs, self.sums, self.counts = np.empty(0, int), None, np.empty(0, int)  # the run that goes on, and before it the last that ended

    def add(self, at: int, thumbs: np.ndarray, box: np.ndarray) -> None:
        """The thumbnails of the frames from `at` on."""
        runs = np.searchsorted(self.first, np.arange(at, at + len(thumbs)), "right") - 1
        asked = self.wanted[runs]
        runs = runs[asked]
        found = images.looks_over(thumbs if asked.all() else thumbs[asked], box) if len(runs) else None
        if found is None:
            return
        starts = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        counts, runs = np.diff(np.append(starts, len(runs))), runs[starts]
        sums = (np.repeat(np.eye(len(starts), dtype=np.float32), counts, 1) @ found).astype(float)
        if len(self.runs):
            if runs[0] == self.runs[-1]:  # it goes on
                sums[0] += self.sums[-1]
                counts[0] += self.counts[-1]
                self.runs, self.sums, self.counts = self.runs[:-1], self.sums[:-1], self.counts[:-1]
            runs, sums, counts = np.append(self.runs, runs), np.vstack([self.sums, sums]), np.append(self.counts, counts)
        self._compare(runs[:-1], sums[:-1], counts[:-1])
        self.runs, self.sums, self.counts = runs[-2:], sums[-2:], counts[-2:]

    def _compare(self, runs: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        """Runs that have ended, side by side."""
        if len(runs) > 1:
            mean = sums / counts[:, None]
            mean -= mean.mean(1, keepdims=True)
            size = np.sqrt(np.einsum("ij,ij->i", mean, mean))
            below = size[1:] * size[:-1]
            change = np.where(below > 0, 1 - np.einsum("ij,ij->i", mean[1:], mean[:-1]) / np.where(below > 0, below, 1), 0.0)
            beside = runs[1:] == runs[:-1] + 1
            self.change[runs[1:][beside]] = change[beside]

    def changes(self) -> np.ndarray:
        if len(self.runs):
            self._compare(self.runs, self.sums, self.counts)
        return self.change


PIECE, CHUNK = 8192, 128  # frames of a site in a row, and frames whose pictures are at hand at once


def watched(sites: DataFrame, frames: DataFrame, detections: DataFrame, c: DiscoveryConfig = DiscoveryConfig(), shots: Shots | None = None) -> DataFrame:
    """`analyse` by camera, in one task each, over arrays: a row for each site and PIECE frames with spot_id, camera, first (number of its
    first frame), step, ts, raw and present (arrays), and the site's sums: n_stays, n_departures, n_arrivals, verified_departures,
    verified_arrivals, max_change, occupancy_rate, detections. Without shots no change is known. Pictures pass one CHUNK at a time."""
    kinds, load = dict(frames.dtypes), shots.load if shots else None
    none = {"t": F.lit(None).cast("int"), "ts": F.lit(None).cast(kinds["ts"]), "us": F.lit(None).cast("long"), **{x: F.lit(None).cast("double") for x in ba.COLUMNS}, "site": F.lit(-1), "n_members": F.lit(None).cast("long"), "seen": F.lit(None).cast("array<int>"), "about": F.lit(None).cast("array<double>")}
    tagged = lambda df, kind, **own: df.select("camera", F.lit(kind).alias("kind"), *[own.get(name, other).alias(name) for name, other in none.items()])
    box = {x: F.col(x).cast("double") for x in ba.COLUMNS}
    times, us = {"t": F.col("t").cast("int"), "ts": F.col("ts")}, F.unix_micros(F.col("ts").cast("timestamp"))
    own = frames.select("camera", "t", "ts").join(shots.rows.select("camera", "t", "about"), ["camera", "t"], "left") if shots else frames
    every = tagged(sites, 0, **box, site=F.col("site"), n_members=F.col("n_members").cast("long"), seen=F.col("frames"))
    every = every.unionByName(tagged(own, 1, **times, us=us, **({"about": F.col("about")} if shots else {}))).unionByName(tagged(detections, 2, t=times["t"], **box))

    def presence(cols: dict, boxes: np.ndarray, t: np.ndarray) -> np.ndarray:
        at, inverse = np.unique(t, return_inverse=True)
        hit = np.zeros((len(boxes), len(at)), bool)

        def place(when: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.minimum(np.searchsorted(at, when), len(at) - 1)
            return k, at[k] == when

        for site, members in enumerate(cols["seen"][cols["kind"] == 0]):
            k, known = place(np.asarray(members, int))
            hit[site, k[known]] = True
        rows = np.flatnonzero(cols["kind"] == 2)
        for part in (rows[k : k + PIECE] for k in range(0, len(rows), PIECE)):
            k, known = place(cols["t"][part].astype(int))
            n, site = np.nonzero((ba.iou_matrix(np.stack([cols[x][part].astype(float) for x in ba.COLUMNS], 1), boxes) >= c.match_iou) & known[:, None])
            hit[site, k[n]] = True
        return hit[:, inverse]

    def run(cols: dict) -> list[tuple]:
        own, at = cols["kind"] == 0, cols["kind"] == 1
        if not own.any() or not at.any():
            return []
        boxes, ts, us, t = np.stack([cols[x][own].astype(float) for x in ba.COLUMNS], 1), cols["ts"][at], cols["us"][at].astype(np.int64), cols["t"][at].astype(int)
        raws = presence(cols, boxes, t)
        step = float(np.median(np.diff(us) / 60e6)) if len(us) > 1 else 1.0
        presents, moves, stays, turns = raws.copy(), [], [], []
        for raw, present in zip(raws, presents):
            first, last, minutes = _runs(raw, us, step)
            for k in np.flatnonzero(~raw[first[1:-1]] & (minutes[1:-1] < c.min_absence_minutes)) + 1 if len(first) > 2 else []:
                present[first[k] : last[k] + 1] = True
            first, last, minutes = _runs(present, us, step)
            seen = np.append(0, np.cumsum(raw))
            stay = present[first] & (minutes >= c.min_stay_minutes) & ((seen[last + 1] - seen[first]) / (last + 1 - first) >= c.min_density)
            lasting = minutes >= c.min_absence_minutes
            departure, arrival = stay & np.append(lasting[1:], False), stay & np.append(False, lasting[:-1])
            wanted = departure | arrival
            wanted = wanted | np.append(False, departure[:-1]) | np.append(arrival[1:], False)
            stays.append(int(stay.sum()))
            moves.append((np.flatnonzero(departure), np.flatnonzero(arrival)))
            turns.append(_Turns(first, wanted))
        if load:
            about, camera = cols["about"][at], cols["camera"][0]
            for k in range(0, len(ts), CHUNK):
                made = [images.thumbnail(load(int(camera), int(t[i]), ts[i], about[i]), c.thumb_width) for i in range(k, min(k + CHUNK, len(ts)))]
                same = np.flatnonzero([True, *(x[0].shape != y[0].shape or x[1] != y[1] for x, y in zip(made[1:], made))]).tolist()
                for a, b in zip(same, [*same[1:], len(made)]):
                    thumbs = np.stack([x for x, _ in made[a:b]])
                    for site, turn in zip(boxes * made[a][1], turns):
                        turn.add(k + a, thumbs, site)
        out = []
        for k, (raw, present) in enumerate(zip(raws, presents)):
            change = turns[k].changes()
            left, came = change[moves[k][0] + 1], change[moves[k][1]]
            ok = [int((x >= c.min_change).sum()) for x in (left, came)]
            sums = (stays[k], len(left), len(came), *ok, float(max(left.max(initial=-np.inf), came.max(initial=-np.inf))) if len(left) + len(came) else 0.0, float(present.mean()), int(cols["n_members"][own][k]))
            name = f"{cols['camera'][0]}:{int(cols['site'][own][k])}"
            for a in range(0, len(ts), PIECE):
                out.append((name, cols["camera"][0], a, step, ts[a : a + PIECE], raw[a : a + PIECE].astype(np.int32), present[a : a + PIECE].astype(np.int32), *sums))
        return out

    sums = "n_stays long, n_departures long, n_arrivals long, verified_departures long, verified_arrivals long, max_change double, occupancy_rate double, detections long"
    return map_groups(every, "camera", ["kind", "ts", "site"], run, f"spot_id string, camera {dict(sites.dtypes)['camera']}, first int, step double, ts array<{kinds['ts']}>, raw array<int>, present array<int>, {sums}", True)


def analyse(sites: DataFrame, frames: DataFrame, detections: DataFrame, c: DiscoveryConfig = DiscoveryConfig(), shots: DataFrame | Shots | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames with bridged presence, and one row per site: detections, n_stays, n_departures, n_arrivals, those of them that are
    verified (verified_departures, verified_arrivals), max_change, occupancy_rate, status.

    A transition is verified if the site looks different: by `min_change` of `changes`, for which `frames` (camera, t, ts) needs
    pixels, height and width, or `shots` (camera, ts) has them, or makes them (`Shots`): then presence is worked out without making or
    moving a pixel. Without pixels there is no evidence, and no site is confirmed. What is used more than once is persisted.
    """
    own = shots if isinstance(shots, Shots) else None
    pictures = frames if shots is None else shots
    pieces = watched(sites, frames, detections, c, own).persist()
    pieces.count()  # else executors work them out twice, for presence and for the sums
    p = pieces.select("spot_id", "camera", "step", "first", F.posexplode(F.arrays_zip("ts", "raw", "present")).alias("k", "f"))
    p = p.select("spot_id", "camera", "f.ts", "f.present", (F.col("first") + F.col("k")).alias("i"), "f.raw", "step")
    if own is None and "pixels" in pictures.columns:
        runs = sq.stays(p, c.min_stay_minutes, c.min_density, c.min_absence_minutes).persist()
        return p, summarised(p, runs, changes(runs, p, sites, pictures, c), sites.select(spot_name().alias("spot_id"), F.col("n_members").cast("long").alias("detections")), c)
    rounded = {x: F.bround(x, 3) for x in ("max_change", "occupancy_rate")}
    summary = pieces.where("first = 0").drop("camera", "first", "step", "ts", "raw", "present").withColumns(rounded)
    return p, summary.withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("n_stays") == 0, "dropped").when(F.col("verified_departures") + F.col("verified_arrivals") > 0, "confirmed").otherwise("candidate")


def summarised(presence: DataFrame, runs: DataFrame, change: DataFrame | None, seen: DataFrame, c: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """The row of `analyse` for each site of `seen` (spot_id, detections), from its frames, runs and the change at its transitions (spot_id, run, kind, change)."""
    moves = _moves(runs)
    moves = moves.withColumn("change", F.lit(0.0)) if change is None else moves.join(change, ["spot_id", "run", "kind"], "left").withColumn("change", F.coalesce("change", F.lit(0.0)))
    of = lambda kind: F.col("kind") == kind
    ok = F.col("change") >= c.min_change
    counts = {"n_departures": of("departure"), "n_arrivals": of("arrival"), "verified_departures": of("departure") & ok, "verified_arrivals": of("arrival") & ok}
    counted = moves.groupBy("spot_id").agg(*[F.count_if(x).alias(name) for name, x in counts.items()], F.bround(F.max("change"), 3).alias("max_change"))
    summary = runs.groupBy("spot_id").agg(F.count_if("stay").alias("n_stays")).join(counted, "spot_id", "left").join(presence.groupBy("spot_id").agg(F.bround(F.avg("present"), 3).alias("occupancy_rate")), "spot_id")
    summary = summary.join(seen, "spot_id").na.fill(0, list(counts)).na.fill(0.0, ["max_change"])
    return summary.withColumn("status", _status())


def named_spots(sites: DataFrame, summary: DataFrame, width: float, height: float, include_candidates: bool = True, c: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """camera, spot_id, id (S1, S2, ... in reading order by camera), polygon (padded, in the frame), car_box (to a tenth), status, n_stays,
    n_departures and n_arrivals (verified ones), occupancy_rate."""
    s = sites.withColumn("spot_id", spot_name()).join(summary.drop("n_departures", "n_arrivals"), "spot_id")
    s = s.where(F.col("status").isin("confirmed", *(["candidate"] if include_candidates else [])))
    row = F.bround(F.col("y1") / F.greatest(F.col("y2") - F.col("y1"), F.lit(1.0)), 0)
    s = s.withColumn("id", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("camera").orderBy(row, "x1", "site"))))
    s = s.withColumn("p", bx.padded(bx.box(), c.pad, F.lit(float(width)), F.lit(float(height))))
    corner = lambda x, y: F.struct(F.col(f"p.{x}").alias("x"), F.col(f"p.{y}").alias("y"))
    polygon = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("polygon")
    counts = [F.col("verified_departures").alias("n_departures"), F.col("verified_arrivals").alias("n_arrivals")]
    return s.select("camera", "spot_id", "id", polygon, F.array(*[F.bround(x, 1) for x in ba.COLUMNS]).alias("car_box"), "status", "n_stays", *counts, "occupancy_rate")


def evaluate(spots: DataFrame, bays: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Spots (camera, id, polygon, status) against true bays (camera, bay, kind, x1 to y2), assigned one to one by overlap.

    Returns one row by camera: n_bays, n_discovered, n_confirmed, precision, precision_confirmed, recall; and camera, bay, kind,
    found, spot_id, status, iou (to 3 digits) for each bay.
    """
    hull = spots.select("camera", "id", "status", bx.bounds(F.col("polygon")).alias("b")).withColumn("n", F.row_number().over(Window.partitionBy("camera").orderBy("id")))
    truth = bays.withColumn("n", F.row_number().over(Window.partitionBy("camera").orderBy("bay")))
    both = hull.select(F.col("camera").alias("frame"), "n", "b.*", F.lit("a").alias("kind")).unionByName(truth.select(F.col("camera").alias("frame"), "n", *ba.COLUMNS, F.lit("b").alias("kind")))
    pairs = ba.best_matches(both, least).withColumnRenamed("frame", "camera")
    matched = pairs.join(hull.select("camera", F.col("n").alias("n_a"), F.col("id").alias("spot_id"), "status"), ["camera", "n_a"])
    table = truth.withColumnRenamed("n", "n_b").join(matched, ["camera", "n_b"], "left")
    table = table.select("camera", "bay", "kind", F.col("spot_id").isNotNull().alias("found"), "spot_id", "status", F.round("overlap", 3).alias("iou"))
    confirmed = F.col("status") == "confirmed"
    of_bays = table.groupBy("camera").agg(F.count("*").alias("n_bays"), F.count("spot_id").alias("hits"), F.count_if(confirmed).alias("hits_confirmed"))
    of_spots = hull.groupBy("camera").agg(F.count("*").alias("n_discovered"), F.count_if(confirmed).alias("n_confirmed"))
    one = of_bays.join(of_spots, "camera", "full").na.fill(0)
    return one.select(
        "camera", "n_bays", "n_discovered", "n_confirmed", metrics.over("hits", "n_discovered").alias("precision"),
        metrics.over("hits_confirmed", "n_confirmed").alias("precision_confirmed"), metrics.over("hits", "n_bays").alias("recall"),
    ), table


def occupancy_log(presence: DataFrame, spots: DataFrame) -> DataFrame:
    """ts, spot_id (the spot's name), occupied."""
    return presence.join(spots.select("spot_id", "id"), "spot_id").select("ts", F.col("id").alias("spot_id"), F.col("present").alias("occupied"))


def find_sites(detections: DataFrame, c: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    return ba.sites(detections, match_iou=c.match_iou, merge_iou=c.merge_iou, max_cooccurrence=c.max_cooccurrence)
