"""SimHash near-duplicates: fingerprints, a grid over per-segment bit counts, exact verification, components.

Search. A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit
segments, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints. The segments form `bands` bands; within a distance
of d, at least bands - d bands have Manhattan distance 0, so two linked
fingerprints share a grid cell (the counts of bands - d chosen bands) of at least
one of the grids. Cells of up to `dense` fingerprints are compared inside,
Manhattan distance over the bands first, then Hamming distance. Fingerprints of
denser cells are linked by another exact way, linear in their number: two of them
are within d = 2r if and only if the balls of radius r around them share a point,
and a point's ball holds only so many distinct fingerprints. Both ways find the
same links; a cell of n costs n * n / 2 comparisons one way and 2,081 points a
fingerprint the other (r = 2), so `dense` is about where they cost the same.

The number of bands follows from the number of distinct fingerprints: more bands
mean more grids (rows) and smaller cells (random candidates).

Only links between distinct fingerprints are made, a spanning star for each
group inside a cell, so copies and large groups cost no pairs.

Defined results: a null text counts as empty; texts without words have
fingerprint 0 and are linked like any other; equal rows get equal results; null
ids take part in links, and a component of null ids alone has a null id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import HOT_KEYS, counted_join, durable
from lotlight.llm.components import connected_components

BLOCK = 1 << 15
LOW_BITS = 0x5555555555555555


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 4
    seed: int = 42
    distance: int = 4
    #: None: those for which grids and random candidates cost least, 8 at least.
    bands: int | None = None
    dense: int = 2048


def bands_for(n: int, distance: int) -> int:
    """Two random segments of two bits have one count with a chance of 3/8; a grid takes bands - distance of the bands."""
    cost = lambda b: comb(b, distance) * (1 + n * 0.375 ** (32 * (b - distance) / b))
    return min(range(max(8, distance + 2), 17), key=cost)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a UTF-8 text; bounded memory for any length."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and \x09-\x0D, \x20
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - shingle + 1], ends[shingle - 1 :]
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, BLOCK):
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist())]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, print (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(x.as_py() or b"", p.shingle, p.seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, print long")


def _band_masks(bands: int) -> list[int]:
    """Two-bit segments dealt to bands as evenly as can be, neighbours together."""
    cuts = [round(k * 32 / bands) for k in range(bands + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _with_cells(prints: DataFrame, bands: int, distance: int) -> DataFrame:
    """print, cell for each grid; a cell is told by a 64-bit hash, and two cells that share one are verified alike."""
    x = F.col("print")
    low, high = x.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW_BITS))
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # 32 counts of two bits
    masks = _band_masks(bands)
    grids = [sum(masks[k] for k in c) for c in combinations(range(bands), bands - distance)]
    cells = F.array(*[F.xxhash64(F.lit(k), F.col("counts").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(grids)])
    return prints.withColumn("counts", counts).select("print", F.explode(cells).alias("cell"))


def _embedded(x: np.ndarray) -> np.ndarray:
    """Bit counts of the eight bytes; their Manhattan distance is a lower bound of the Hamming distance."""
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint8)).reshape(len(x), 8).astype(np.int8)


def _close(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs are within the distance: by the bound of their embeddings, then exactly."""
    out = np.abs(ea - eb).sum(axis=-1) <= distance
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count((a if a.ndim == 0 else a[at]) ^ b[at]) <= distance
    return out


def _links_of_run(x: np.ndarray, e: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of a cell's fingerprints; a row of the comparison at a time."""
    root = np.arange(len(x))
    for k in range(len(x) - 1):
        near = np.flatnonzero(_close(x[k], x[k + 1 :], e[k], e[k + 1 :], distance)) + k + 1
        if len(near):
            old = np.unique(np.append(root[near], root[k]))
            root[np.isin(root, old)] = old[0]
    far = np.flatnonzero(root != np.arange(len(x)))
    return x[far], x[root[far]]


def _links_of_cells(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by cell. Small cells are compared all at once, by how far apart their rows are."""
    held = (np.empty(0, np.int64), np.empty(0, np.uint64))

    def links(cell: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes, e = np.diff(np.append(starts, len(cell))), _embedded(x)
        found = [_links_of_run(x[s : s + n], e[s : s + n], distance) for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist())]
        left = np.repeat(np.where(sizes > 16, 0, sizes), sizes) - (np.arange(len(cell)) - np.repeat(starts, sizes))
        for lag in range(1, 16):
            at = np.flatnonzero(left > lag)
            if not len(at):
                break
            ok = at[_close(x[at], x[at + lag], e[at], e[at + lag], distance)]
            found.append((x[ok], x[ok + lag]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.uint64) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["a", "b"])

    for batch in batches:
        cell = np.concatenate([held[0], batch.column(0).to_numpy()])
        x = np.concatenate([held[1], batch.column(1).to_numpy().view(np.uint64)])
        if not len(cell):
            continue
        last = int(np.flatnonzero(cell == cell[-1])[0])
        held = cell[last:], x[last:]
        if last:
            yield links(cell[:last], x[:last])
    if len(held[0]):
        yield links(*held)


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """Links a, b between distinct fingerprints within 2 * radius, by shared points of their balls."""
    flips = [_signed(sum(1 << k for k in c)) for n in range(radius + 1) for c in combinations(range(64), n)]
    points = prints.select("print", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.min("print").alias("b"), F.collect_list("print").alias("all"))  # at most a ball's points
    return met.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a != b").distinct()


def print_links(prints: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """Links a, b that join all fingerprints (`print`, distinct; read several times) within the distance, directly or by others."""
    cells = _with_cells(prints, p.bands or bands_for(prints.count(), p.distance), p.distance)
    dense = durable(cells.groupBy("cell").count().where(F.col("count") > p.dense).select("cell"))
    more, n_dense = None, dense.count()
    if n_dense:
        marked = F.broadcast(dense) if n_dense <= HOT_KEYS else dense
        crowd = durable(cells.join(marked, "cell", "left_semi").select("print").distinct())
        if p.distance % 2:
            raise ValueError("dense cells need an even distance")
        more = _ball_links(crowd, p.distance // 2)
        cells = cells.join(marked, "cell", "left_anti")
    d = p.distance
    links = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "print").mapInArrow(lambda it: _links_of_cells(it, d), "a long, b long")
    return links if more is None else links.union(more)


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, print, component_id for each row of `docs`."""
    prints = durable(fingerprints(docs, p))
    # A fixed number of partitions: each print becomes many rows, so a few small partitions would not do.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = durable(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).repartition(parts, "print"))
    total, distinct = first.agg(F.sum("n"), F.count("*")).first()
    labels = connected_components(print_links(first.select("print"), p))
    roots = durable(first.join(labels.select(F.col("node").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    component = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    classes = counted_join(roots.select("print", "root", F.col("n").alias("rows")), component, "root", distinct)
    classes = classes.select("print", "component_id", F.col("rows").alias("n"))
    return counted_join(prints, classes, "print", total or 0).select("doc_id", "print", "component_id")
