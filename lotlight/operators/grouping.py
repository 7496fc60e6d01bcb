"""Grouped numpy functions without a call's cost per group: sorted batches go over whole, groups are cut out there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of parts that are dealt alike to be dealt so itself, and leaves out the shuffle that a later grouping
    asks for. Where a part is cached, its partitions may be others than the plan says, and a group then falls apart without an
    error. So this session gets its shuffles back."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def spread(df: DataFrame, key: str, rows: int = 200) -> DataFrame:
    """`df` dealt by `key` to tasks of some `rows` rows, before work that takes long or much memory by row: a file of small rows is one task otherwise."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def map_groups(df: DataFrame, key: str, order: list[str], run: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str, long: bool = False) -> DataFrame:
    """Rows that `run` makes of the columns of each key's rows, in order. A group may span batches; one at a time is held.
    long: groups that take long are dealt to many tasks, so that no task has more than a few."""
    plain_unions(df.sparkSession)
    names = df.columns
    spark_schema = df.sparkSession.createDataFrame([], schema).schema

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(spark_schema)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], out.names)

        held: dict[str, np.ndarray] | None = None
        for part in parts:
            if not part.num_rows:
                continue
            cols = {n: part.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names)}
            if held:
                cols = {n: np.concatenate([held[n], cols[n]]) for n in names}
            k = cols[key]
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])).tolist()
            rows: list[tuple] = []
            for a, b in zip(starts, starts[1:]):
                rows += run({n: v[a:b] for n, v in cols.items()})
            held = {n: v[starts[-1] :] for n, v in cols.items()}
            yield made(rows)
        if held:
            yield made(run(held))

    dealt = df.repartition(16 * df.sparkSession.sparkContext.defaultParallelism, key) if long else df.repartition(key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(batches, schema)
