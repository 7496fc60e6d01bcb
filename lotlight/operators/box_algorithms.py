"""Order-dependent box algorithms on numpy arrays (n, 4), and their grouped forms; one frame or camera at a time."""

from __future__ import annotations

from bisect import insort
from heapq import heapify, heappop, heappush, merge

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlight.functions.boxes import iou
from lotlight.operators.grouping import map_groups


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.reshape(np.asarray(a, float), (-1, 1, 4)), np.reshape(np.asarray(b, float), (1, -1, 4))
    side = np.clip(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0, None)
    size = lambda wh: wh[..., 0] * wh[..., 1]
    inter = size(side)
    union = size(a[..., 2:] - a[..., :2]) + size(b[..., 2:] - b[..., :2]) - inter
    return inter / np.maximum(union, 1e-9)


def suppress(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> np.ndarray:
    """Indexes kept by greedy suppression, best first; of equal scores the earlier box goes first."""
    order, o = np.argsort(-np.asarray(scores), kind="stable"), iou_matrix(boxes, boxes)
    alive, kept = np.ones(len(order), bool), []
    for i in order:
        if alive[i]:
            kept.append(int(i))
            alive &= o[i] < threshold
    return np.array(kept, int)


def vote(boxes: np.ndarray, scores: np.ndarray, threshold: float, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Kept boxes replaced by the score-weighted mean of all boxes, suppressed ones too, that overlap them."""
    kept = suppress(boxes, scores, threshold)
    if not len(kept):
        return np.empty((0, 4)), np.empty(0)
    weight = (iou_matrix(boxes[kept], boxes) >= overlap) * np.asarray(scores, float)
    total = weight.sum(1, keepdims=True)
    return np.where(total > 0, weight @ np.asarray(boxes, float) / np.where(total > 0, total, 1), boxes[kept]), np.asarray(scores)[kept]


def match_greedy(boxes: np.ndarray, scores: np.ndarray, truth: np.ndarray, threshold: float = 0.5, ignore: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """(detection, truth or -1, hit), best score first; detections on ignored regions that hit nothing are left out."""
    o, free, out = iou_matrix(boxes, truth), np.ones(len(truth), bool), []
    shaded = iou_matrix(boxes, ignore).max(1, initial=0) >= threshold if ignore is not None and len(ignore) else np.zeros(len(boxes), bool)
    for i in np.argsort(-np.asarray(scores), kind="stable"):
        own = np.where(free, o[i], 0)
        j = int(own.argmax()) if len(own) else -1
        if j >= 0 and own[j] >= threshold:
            free[j] = False
            out.append((int(i), j, True))
        elif not shaded[i]:
            out.append((int(i), -1, False))
    return out


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns of the greatest total gain: shortest augmenting paths with potentials."""
    g = np.asarray(gain, float)
    if not g.size:
        return []
    if min(g.shape) == 1:
        k = int(g.argmax())
        return [divmod(k, g.shape[1])]
    flip = g.shape[0] > g.shape[1]
    cost = -(g.T if flip else g)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        slack, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[col]:
            done[col] = True
            r = owner[col]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            came[1:][better] = col
            following = int(np.where(done[1:], np.inf, slack[1:]).argmin()) + 1
            step = slack[following]
            u[owner[done]] += step
            v[done] -= step
            slack[~done] -= step
            col = following
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    pairs = [(int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign_first(gain: np.ndarray) -> list[tuple[int, int]]:
    """`assign` made total: of several assignments of the greatest gain (summed by row), the one whose first rows have the first columns, a column before none."""
    g = np.asarray(gain, float)

    def whole(taken: list[tuple[int, int]]) -> tuple[float, list[tuple[int, int]]]:
        """The best assignment that begins with `taken`, a pair for each of the first rows, and its gain."""
        rows, cols = np.arange(len(taken), g.shape[0]), np.setdiff1d(np.arange(g.shape[1]), [j for _, j in taken if j >= 0])
        rest = [(int(rows[i]), int(cols[j])) for i, j in assign(g[np.ix_(rows, cols)])]
        pairs, total = [p for p in [*taken, *rest] if p[1] >= 0 and g[p] > 0], 0.0
        for p in sorted(pairs):
            total += g[p]
        return total, pairs

    taken: list[tuple[int, int]] = []
    best, pairs = whole(taken)
    for i in range(g.shape[0]):
        own = dict(pairs).get(i, -1)
        used = {j for _, j in taken}
        for j in np.flatnonzero(g[i] > 0).tolist():
            if j == own:
                break
            if j not in used:
                total, other = whole([*taken, (i, j)])
                if total >= best:
                    best, pairs, own = total, other, j
                    break
        taken.append((i, own))
    return pairs


def match_best(a: np.ndarray, b: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of the assignment of greatest total overlap that reach the threshold."""
    o = iou_matrix(a, b)
    if threshold > 0:
        top = o.max(1, initial=0)
        rows = np.flatnonzero(top > 0)
        at, cols = np.nonzero(o[rows] == top[rows, None])
        if len(at) == len(rows) and len(set(cols.tolist())) == len(rows):  # each row has its own best column: no other assignment is as good
            return [(i, j) for i, j in zip(rows.tolist(), cols.tolist()) if o[i, j] >= threshold]
    return [(i, j) for i, j in assign(o) if o[i, j] >= threshold]


class Middles:
    """The median box of boxes that come one by one: a sorted list for each side."""

    def __init__(self) -> None:
        self.sides: list[list[float]] = [[], [], [], []]

    def add(self, box: np.ndarray) -> None:
        for side, v in zip(self.sides, box.tolist()):
            insort(side, v)

    def take(self, other: Middles) -> None:
        self.sides = [list(merge(a, b)) for a, b in zip(self.sides, other.sides)]

    def box(self) -> np.ndarray:
        n = len(self.sides[0])
        return np.array([(s[(n - 1) // 2] + s[n // 2]) / 2 for s in self.sides])


def track(frames: list[np.ndarray], match_iou: float = 0.5, merge_iou: float = 0.2, max_cooccurrence: float = 0.1) -> list[dict]:
    """Sites of boxes seen over time: {box, members: [(frame, box)]}; a site's box is the median of its members.

    A frame's boxes go to the sites of its best assignment, or begin sites of
    their own. Then, as long as two sites overlap by `merge_iou` and share at most
    `max_cooccurrence` of the frames of the one seen less, the two of these that
    overlap most become one, with the place of the first.
    """
    boxes, middles, members = np.empty((0, 4)), [], []
    for t, found in enumerate(frames):
        found = np.reshape(np.asarray(found, float), (-1, 4))
        own = dict(match_best(found, boxes, match_iou))
        new = [i for i in range(len(found)) if i not in own]
        for i, j in [*own.items(), *((i, len(boxes) + k) for k, i in enumerate(new))]:
            if j >= len(middles):
                middles.append(Middles())
                members.append([])
            middles[j].add(found[i])
            members[j].append((t, found[i]))
        boxes = np.vstack([boxes, found[new]])
        for j in own.values():
            boxes[j] = middles[j].box()
    return _merged(boxes, middles, members, merge_iou, max_cooccurrence)


def _merged(boxes: np.ndarray, middles: list[Middles], members: list[list], least: float, most: float) -> list[dict]:
    """Pairs wait in a heap by overlap; one that has changed since it was put there is skipped, as its new overlap was put there too."""
    times = [{t for t, _ in m} for m in members]
    alive, version = np.ones(len(boxes), bool), [0] * len(boxes)
    o = np.triu(iou_matrix(boxes, boxes), 1)
    heap = [(-o[i, j], int(i), int(j), 0, 0) for i, j in np.argwhere(o >= least)]
    heapify(heap)
    while heap:
        _, i, j, vi, vj = heappop(heap)
        if not (alive[i] and alive[j]) or (vi, vj) != (version[i], version[j]):
            continue
        if len(times[i] & times[j]) > most * min(len(times[i]), len(times[j])):
            continue
        alive[j] = False
        version[i] += 1
        middles[i].take(middles[j])
        members[i] += members[j]
        times[i] |= times[j]
        boxes[i] = middles[i].box()
        near = iou_matrix(boxes[i], boxes)[0]
        for k in np.flatnonzero((near >= least) & alive).tolist():
            if k != i:
                a, b = min(i, k), max(i, k)
                heappush(heap, (-near[k], a, b, version[a], version[b]))
    return [{"box": boxes[k], "members": members[k]} for k in np.flatnonzero(alive)]


COLUMNS = ["x1", "y1", "x2", "y2"]


def nms(boxes: DataFrame, threshold: float) -> DataFrame:
    """frame, n of the boxes kept. `boxes` has frame, n (a total order by score), x1 to y2.

    A fold over each frame's own boxes, all in built-in functions.
    """
    one = F.struct("n", *[F.col(c).cast("double").alias(c) for c in COLUMNS])
    frames = boxes.groupBy("frame").agg(F.sort_array(F.collect_list(one)).alias("all"))
    add = lambda kept, x: F.when(F.exists(kept, lambda k: iou(x, k) >= threshold), kept).otherwise(F.array_append(kept, x))
    kept = F.aggregate("all", F.slice("all", 1, 0), add)
    return frames.select("frame", F.explode(kept).alias("k")).select("frame", "k.n")


def _boxes(cols: dict[str, np.ndarray], rows=slice(None)) -> np.ndarray:
    return np.stack([cols[c][rows].astype(float) for c in COLUMNS], 1)


def nms_vote(boxes: DataFrame, threshold: float) -> DataFrame:
    """frame, x1 to y2, score: suppressed and voted."""

    def run(cols: dict) -> list[tuple]:
        b, s = vote(_boxes(cols), cols["score"].astype(float), threshold)
        return [(cols["frame"][0], *map(float, x), float(y)) for x, y in zip(b, s)]

    kept = boxes.select("frame", "n", *COLUMNS, "score")
    return map_groups(kept, "frame", ["n"], run, f"frame {dict(boxes.dtypes)['frame']}, x1 double, y1 double, x2 double, y2 double, score double")


def greedy_matches(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frame, n, hit. `boxes` has kind too: det, truth or ignore."""

    def run(cols: dict) -> list[tuple]:
        part = {k: cols["kind"] == k for k in ("det", "truth", "ignore")}
        n = cols["n"][part["det"]]
        found = match_greedy(_boxes(cols, part["det"]), -n.astype(float), _boxes(cols, part["truth"]), threshold, _boxes(cols, part["ignore"]))
        return [(cols["frame"][0], int(n[i]), int(hit)) for i, _, hit in found]

    kept = boxes.select("frame", "n", *COLUMNS, "kind")
    return map_groups(kept, "frame", ["n"], run, f"frame {dict(boxes.dtypes)['frame']}, n int, hit int")


def best_matches(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """frame, n_a, n_b, overlap of the best assignment of kind a to kind b, of equals the first (`assign_first`)."""

    def run(cols: dict) -> list[tuple]:
        a, b = cols["kind"] == "a", cols["kind"] == "b"
        o = iou_matrix(_boxes(cols, a), _boxes(cols, b))
        na, nb = cols["n"][a], cols["n"][b]
        return [(cols["frame"][0], int(na[i]), int(nb[j]), float(o[i, j])) for i, j in assign_first(o) if o[i, j] >= threshold]

    kept = boxes.select("frame", "n", *COLUMNS, "kind")
    return map_groups(kept, "frame", ["n"], run, f"frame {dict(boxes.dtypes)['frame']}, n_a int, n_b int, overlap double")


def sites(boxes: DataFrame, **limits: float) -> DataFrame:
    """camera, site, n_members, frames, x1 to y2: tracked and merged by camera. `boxes` has camera, t (int), x1 to y2."""

    def run(cols: dict) -> list[tuple]:
        b, t = _boxes(cols), cols["t"]
        starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        when = t[starts]
        found = track(np.split(b, starts[1:]), **limits)
        return [(cols["camera"][0], k, len(s["members"]), sorted({int(when[i]) for i, _ in s["members"]}), *map(float, s["box"])) for k, s in enumerate(found)]

    kept = boxes.select("camera", "t", *COLUMNS)
    return map_groups(kept, "camera", ["t", *COLUMNS], run, f"camera {dict(boxes.dtypes)['camera']}, site int, n_members int, frames array<int>, x1 double, y1 double, x2 double, y2 double", True)
