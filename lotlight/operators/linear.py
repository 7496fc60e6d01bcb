"""Logistic regression of wide rows by Newton's method: passes over float arrays, which stay as they are, and sums of a bounded size.

A pass gives the exact gradient over all rows and the curvature; partial sums are added up by blocks of the curvature's lines, so the
driver gets one matrix of the features' width squared, however many rows or tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotlight.operators.images import small_batches

LINES = 128  # of the curvature in one row of a pass's result
START = 4  # rows for each weight in the part that the first steps are made on


@dataclass(frozen=True)
class Line:
    """weights and offset for values as they are, and the mean and deviation (1 where there is none) of each."""

    weights: np.ndarray
    offset: float
    mean: np.ndarray
    deviation: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.offset


def matrix(columns: list[pa.Array]) -> np.ndarray:
    """A row's arrays side by side."""
    return np.hstack([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in columns])


def _few(rows: DataFrame) -> DataFrame:
    return rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))  # a partial sum for each core, not for each part


def _moments(rows: DataFrame, make: Callable) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Mean, deviation, number of rows and of those with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cars, mean, m2 = 0, 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = make(b.columns[1:]).astype(float)
                at, k = x.mean(0), len(x)
                m2 = m2 + ((x - at) ** 2).sum(0) + (at - mean) ** 2 * (n * k / (n + k))
                mean, n = mean + (at - mean) * (k / (n + k)), n + k
                cars += int((b.column(0).to_numpy(zero_copy_only=False) == 1).sum())
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "cars": [cars], "sums": [np.concatenate([mean, m2]).tobytes()]})

    n, cars, mean, m2 = 0, 0, 0.0, 0.0
    for r in _few(rows).mapInArrow(run, "n long, cars long, sums binary").collect():  # a row for each core
        at, own = np.frombuffer(r["sums"]).reshape(2, -1)
        m2 = m2 + own + (at - mean) ** 2 * (n * r["n"] / (n + r["n"]))
        mean, n, cars = mean + (at - mean) * (r["n"] / (n + r["n"])), n + r["n"], cars + r["cars"]
    deviation = np.sqrt(m2 / max(n - 1, 1))
    return mean, np.where(deviation > 0, deviation, 1.0), n, cars


def _pass(rows: DataFrame, make: Callable, mean: np.ndarray, deviation: np.ndarray, w: np.ndarray, share: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of losses, gradient and curvature at w (weights of standardised values, then the offset); share: the weight of a row of label 0, 1."""
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, bend = 0.0, np.zeros(d), np.zeros((d, d), np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            x = make(b.columns[1:])
            z = np.ones((len(x), d), x.dtype)
            np.subtract(x, mean.astype(x.dtype), out=z[:, :-1])
            z[:, :-1] /= deviation.astype(x.dtype)
            y = b.column(0).to_numpy(zero_copy_only=False) == 1
            weight, m = np.where(y, share[1], share[0]), (z @ w.astype(x.dtype)).astype(float)
            p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
            loss += float((weight * (np.logaddexp(0, m) - y * m)).sum())
            slope += z.T @ (weight * (p - y)).astype(x.dtype)
            a = (z * np.sqrt(weight * p * (1 - p))[:, None].astype(x.dtype)).astype(np.float32)
            bend += a.T @ a
        parts = [np.append(loss, slope).tobytes()] + [bend[k : k + LINES, k:].tobytes() for k in range(0, d, LINES)]
        for k, part in enumerate(parts):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "part": [part]})

    def add(key, parts):
        import pandas as pd

        kind = np.float64 if key[0] == 0 else np.float32
        total = sum(np.frombuffer(p, kind).astype(float) for p in parts["part"])
        return pd.DataFrame({"k": [key[0]], "part": [total.tobytes()]})

    found = {r["k"]: np.frombuffer(r["part"]) for r in _few(rows).mapInArrow(run, "k int, part binary").groupBy("k").applyInPandas(add, "k int, part binary").collect()}  # width / LINES rows
    bend = np.empty((d, d))
    for k in range(0, d, LINES):
        part = found.pop(k // LINES + 1).reshape(-1, d - k)
        bend[k : k + LINES, k:] = part
        bend[k:, k : k + LINES] = part.T
    return found[0][0], found[0][1:], bend


def _step(slope: np.ndarray, bend: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    bend[np.diag_indices(len(slope))] += penalty + 1e-9 * np.trace(bend) / len(slope)
    return -np.linalg.solve(bend, slope)


def _begin(rows: DataFrame, make: Callable, mean: np.ndarray, deviation: np.ndarray, share: tuple[float, float], ridge: float) -> np.ndarray:
    """What a part of the rows gives, in one task; each step as long as is best of a few."""
    d = len(mean) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(make(b.columns[1:]), b.column(0).to_numpy(zero_copy_only=False) == 1) for b in batches if b.num_rows]
        w = np.zeros(d)
        if held:
            z = np.hstack([(np.vstack([x for x, _ in held]) - mean.astype(np.float32)) / deviation.astype(np.float32), np.ones((sum(len(x) for x, _ in held), 1))]).astype(np.float32)
            y, penalty = np.concatenate([y for _, y in held]), np.append(np.full(d - 1, ridge), 0.0)
            held.clear()
            weight, m, best = np.where(y, share[1], share[0]), np.zeros(len(z)), np.inf
            total = lambda m, w: (weight * (np.logaddexp(0, m) - y * m)).sum() + (penalty * w**2).sum() / 2
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
                a = z * np.sqrt(weight * p * (1 - p))[:, None].astype(np.float32)
                step = _step(z.T @ (weight * (p - y)).astype(np.float32) + penalty * w, (a.T @ a).astype(float), penalty)
                along = (z @ step.astype(np.float32)).astype(float)
                now, t = min((total(m + t * along, w + t * step), t) for t in (0.25, 0.5, 1, 1.5, 2, 3, 4, 6, 8))
                if not now < best * 0.99:
                    break
                w, m, best = w + t * step, m + t * along, now
        yield pa.RecordBatch.from_pydict({"w": [w.tobytes()]})

    return np.frombuffer(rows.repartition(1).mapInArrow(run, "w binary").first()["w"])


def _descend(rows: DataFrame, make: Callable, mean: np.ndarray, deviation: np.ndarray, share: tuple[float, float], ridge: float, w: np.ndarray, steps: int, close: float) -> np.ndarray:
    step, best, penalty = np.zeros(len(w)), np.inf, np.append(np.full(len(mean), ridge), 0.0)
    for _ in range(steps):
        loss, slope, bend = _pass(rows, make, mean, deviation, w + step, share)
        total = loss + (penalty * (w + step) ** 2).sum() / 2
        if total > best * (1 + 1e-9):  # too far
            step = step / 2
            continue
        w, best, slope = w + step, total, slope + penalty * (w + step)
        step = _step(slope, bend, penalty)
        if -slope @ step / 2 <= close * best:
            return w + step
    return w


def fit(rows: DataFrame, ridge: float, balanced: bool = False, make: Callable = matrix, steps: int = 100, close: float = 1e-8) -> Line:
    """From rows at hand (label, then arrays that `make` turns into a matrix, a row each): the least sum of losses and ridge / 2 times the
    squares of the standardised values' weights. Ends when a step over all rows would lower it by less than a share `close`. Where rows are
    many, the steps begin at what a part of them gives: that saves passes, and where they end is settled by all rows."""
    small_batches(rows.sparkSession)
    mean, deviation, n, cars = _moments(rows, make)
    share = (n / (2 * max(n - cars, 1)), n / (2 * max(cars, 1))) if balanced else (1.0, 1.0)
    w = np.zeros(len(mean) + 1)
    if not 0 < cars < n:  # one label alone
        return Line(w[:-1], np.inf if cars else -np.inf, mean, deviation)
    part = START * len(w) / n
    if part < 0.5:
        w = _begin(rows.sample(part, seed=0), make, mean, deviation, share, ridge * part)
    w = _descend(rows, make, mean, deviation, share, ridge, w, steps, close)
    weights = w[:-1] / deviation
    return Line(weights, float(w[-1] - weights @ mean), mean, deviation)
