"""Random forests whose trees are grown, gathered in a file and used by tasks; Spark hands the file to the executors, and no tree is in the driver's memory.

Values are cut into bins at quantiles of all rows, one byte each. A task gets all rows' bytes once and grows its share of the trees, level
by level, all nodes of a level at once; it counts rows by node, drawn feature and bin. Rows that have the same bytes are interchangeable,
so that a tree is the same however rows are dealt. A task holds a byte for each row and feature: 640 MB for 10 million rows of 64.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlight.operators.shared import gone_at_end, shared_folder

BINS = 32
CELLS = 1 << 21  # counts that are held at once
BLOCK = 4096  # rows that travel as one
#: Of Parquet: a tree is a large row, so that sizes are looked at after each.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}
NODE = np.dtype([("feature", "<i2"), ("cut", "u1"), ("left", "<i4"), ("chance", "<f4")])


def grow(bins: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tries: int) -> np.ndarray:
    """A tree over a bootstrap sample: feature (-1 at a leaf), last bin that goes left, left child (the right one follows it) and share of
    label 1 of each node. Splits are those of least Gini impurity among `tries` drawn features, of any gain."""
    weight = np.bincount(rng.integers(len(y), size=len(y)), minlength=len(y))
    rows = np.flatnonzero(weight)
    node, weight = np.zeros(len(rows), np.int64), weight[rows].astype(float)
    ones = weight * y[rows]
    levels, base, n_nodes = [], 0, 1  # base: the level's first node
    for level in range(depth + 1):
        all_n, all_1 = np.bincount(node, weight, n_nodes), np.bincount(node, ones, n_nodes)
        made = np.zeros(n_nodes, NODE)
        f, c, made["chance"] = np.full(n_nodes, -1), np.zeros(n_nodes, int), all_1 / np.maximum(all_n, 1)
        split = np.flatnonzero((all_1 > 0) & (all_1 < all_n) & (all_n >= 2 * least)) if level < depth else np.empty(0, int)
        if len(split):
            drawn = np.argpartition(rng.random((len(split), bins.shape[1]), np.float32), tries - 1, axis=1)[:, :tries] if tries < bins.shape[1] else np.tile(np.arange(tries), (len(split), 1))
            at = np.full(n_nodes, -1)
            at[split] = np.arange(len(split))
            order = np.argsort(at[node], kind="stable")
            place = at[node][order]
            step = max(1, CELLS // (tries * BINS))
            for a in range(0, len(split), step):
                m = min(step, len(split) - a)
                own = order[np.searchsorted(place, a) : np.searchsorted(place, a + m)]
                k = at[node[own]] - a
                cell = ((k[:, None] * tries + np.arange(tries)) * BINS + bins[rows[own, None], drawn[a : a + m][k]]).ravel()
                size = np.bincount(cell, np.repeat(weight[own], tries), m * tries * BINS).reshape(m, tries, BINS).cumsum(2)
                hits = np.bincount(cell, np.repeat(ones[own], tries), m * tries * BINS).reshape(m, tries, BINS).cumsum(2)
                n, h = all_n[split[a : a + m], None, None], all_1[split[a : a + m], None, None]
                rest, other = n - size, h - hits
                with np.errstate(divide="ignore", invalid="ignore"):
                    bad = hits * (size - hits) / size + other * (rest - other) / rest  # half the impurity, by size
                bad[(size < least) | (rest < least)] = np.inf
                best = bad.reshape(m, -1).argmin(1)
                good = (bad.reshape(m, -1)[np.arange(m), best] < (h * (n - h) / n).ravel() - 1e-9).nonzero()[0]
                f[split[a + good]], c[split[a + good]] = drawn[a + good, best[good] // BINS], best[good] % BINS
        parents = np.flatnonzero(f >= 0)
        to = np.zeros(n_nodes, int)
        to[parents] = base + n_nodes + 2 * np.arange(len(parents))
        made["feature"], made["cut"], made["left"] = f, c, to
        levels.append(made)
        base += n_nodes
        if not len(parents):
            break
        stay = f[node] >= 0
        rows, node, weight, ones = rows[stay], node[stay], weight[stay], ones[stay]
        node = to[node] - base + (bins[rows, f[node]] > c[node])
        n_nodes = 2 * len(parents)
    return np.concatenate(levels)


def chances(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The share of label 1 in each row's leaf."""
    at, going = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(going := going[tree["feature"][at[going]] >= 0]):
        k = tree[at[going]]
        at[going] = k["left"] + (bins[going, k["feature"]] > k["cut"])
    return tree["chance"][at]


def binned(v: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v[:, k]) for k, c in enumerate(cuts)], 1).astype(np.uint8)


def borders(df: DataFrame, features: str) -> list[np.ndarray]:
    """Between the bins of each value: quantiles over all rows."""
    q = F.percentile_approx("v", F.array(*[F.lit(k / BINS) for k in range(1, BINS)]), F.lit(10_000))
    rows = df.select(F.posexplode(vector_to_array(features)).alias("k", "v")).groupBy("k").agg(q.alias("q")).collect()  # a row for each feature
    return [np.unique(r["q"]) for r in sorted(rows, key=lambda r: r["k"])]


def _nodes(name: str) -> np.ndarray:
    """All nodes of a file of trees: each executor unpacks it once, beside it, and maps that."""
    packed = SparkFiles.get(name)
    flat = f"{packed}.nodes"
    if not os.path.exists(flat):
        own = f"{flat}-{uuid.uuid4().hex}"
        with pq.ParquetFile(packed) as f, open(own, "wb") as out:
            for k in range(f.num_row_groups):
                for tree in f.read_row_group(k, ["nodes"])["nodes"]:
                    out.write(tree.as_buffer())
        os.replace(own, flat)  # another worker may have done the same
    return np.memmap(flat, NODE, "r")


class Forest:
    """Borders of the bins, and a file of trees in the shared folder, in order, with their lengths."""

    def __init__(self, spark: SparkSession, cuts: list[np.ndarray], trees: DataFrame):
        """trees: tree, nodes. One task gathers them."""
        self.cuts, self.path = cuts, shared_folder(spark, "forest")
        size = (F.length("nodes") / NODE.itemsize).cast("int").alias("n")
        trees.select("tree", size, "nodes").repartition(1).sortWithinPartitions("tree").write.options(**LARGE_ROWS).parquet(self.path)
        gone_at_end(spark, self.path)
        made = spark.read.parquet(self.path)
        self.lengths = [r["n"] for r in made.select("tree", "n").orderBy("tree").collect()]  # a number for each tree
        file = made.inputFiles()[0]
        self.file = file.rpartition("/")[2]
        spark.sparkContext.addFile(file)

    def score(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """`df` with the trees' mean chance of label 1."""
        cuts, lengths, name = self.cuts, self.lengths, self.file

        @F.pandas_udf("double")
        def run(v):
            import pandas as pd

            if not len(v):
                return pd.Series([], dtype=float)
            nodes, bins, total, at = _nodes(name), binned(np.stack(v.to_numpy()), cuts), np.zeros(len(v)), 0
            for n in lengths:
                total += chances(nodes[at : at + n].view(np.ndarray), bins)
                at += n
            return pd.Series(total / len(lengths))

        return df.withColumn(out, run(vector_to_array(features)))

    def save(self, spark: SparkSession, path: str) -> None:
        about = [(-1 - k, bytearray(c.astype(float).tobytes())) for k, c in enumerate(self.cuts)]
        spark.createDataFrame(about, "tree int, nodes binary").coalesce(1).write.mode("overwrite").parquet(path)
        spark.read.parquet(self.path).select("tree", "nodes").write.options(**LARGE_ROWS).mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        df = spark.read.parquet(path)
        cuts = [np.frombuffer(r["nodes"]) for r in df.where("tree < 0").orderBy(F.desc("tree")).collect()]  # a row for each feature
        return cls(spark, cuts, df.where("tree >= 0"))


def fit(df: DataFrame, trees: int = 300, depth: int = 20, least: int = 1, seed: int = 0, features: str = "x", label: str = "label") -> Forest:
    """From rows of a vector and a label of 0 or 1: `trees` of at most `depth`, each node by the square root of the features."""
    spark = df.sparkSession
    cuts = borders(df, features)
    width, tries = len(cuts), int(np.ceil(np.sqrt(len(cuts))))
    groups = min(trees, 4 * spark.sparkContext.defaultParallelism)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
                y = (b.column(0).to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"block": [np.hstack([binned(v, cuts), y[:, None]]).tobytes()]})

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for g, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(g, []).append(block)
        for g, blocks in held.items():
            rows = np.sort(np.frombuffer(b"".join(blocks), f"V{width + 1}")).view(np.uint8).reshape(-1, width + 1)
            bins, y = np.ascontiguousarray(rows[:, :-1]), rows[:, -1].astype(float)
            for k in range(g, trees, groups):
                tree = grow(bins, y, np.random.default_rng([seed, k]), depth, least, tries)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([k], pa.int32()), "nodes": [tree.tobytes()]})

    blocks = df.select(label, vector_to_array(features)).mapInArrow(pack, "block binary")
    dealt = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "block").repartition(groups, "g")
    return Forest(spark, cuts, dealt.mapInArrow(plant, "tree int, nodes binary"))
