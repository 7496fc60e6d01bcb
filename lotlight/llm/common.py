"""Shared helpers: the shared folder, durable lineage cuts and their removal, joins of hot keys, column hygiene."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters \x09-\x0D and \x20.
WS = " \t\n\x0b\x0c\r"
#: Keys that a join may treat as hot, at most; so many rows are broadcast.
HOT_KEYS = 10_000
#: Rows that a key of a small table may have without being hot: they are no load for a task.
HOT_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some columns of it. One with fewer bytes a core than the least part a scan is cut into
    (`spark.sql.files.openCostInBytes`), as a small file of one row group has, is dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution().optimizedPlan()
    small = int(str(plan.stats().sizeInBytes())) < cores * spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    df = df.select(*(columns or ("*",)))
    return df.repartition(cores) if small else df


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names. Only in one process (tests) may that be unset: then it
    lies in a temporary folder, gone when the process ends; executors on other machines would not see that, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lotlight-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    return f"{where.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def forget(spark: SparkSession, *spent: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more, and have the driver collect its garbage: the files of a
    shuffle are deleted only when its plan has been collected, which a driver with memory to spare does far too seldom."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in spent:
        path = jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def remove_folder(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one, that no column of `df` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fenced(df: DataFrame, flag: str) -> DataFrame:
    """`df`, with filters on the boolean `flag` held above the expressions that make it.

    Catalyst moves a filter below the projections that define its columns and
    repeats their expressions in it, once for each use; a column that isn't
    deterministic keeps it from that.
    """
    at = unused(df, "_at")
    return df.withColumn(at, F.monotonically_increasing_id()).withColumn(flag, F.col(flag) & (F.col(at) >= 0)).drop(at)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, ways: int = 16, how: str = "left") -> DataFrame:
    """Equi-join in which a hot key of `left` is dealt to `ways` tasks.

    `right` must hold each key once and be much smaller than `left`: it is
    repeated once per way. `salt` must be a function of the row's own values,
    so that a recomputed task deals its rows alike.
    """
    salted = left.withColumn("_way", F.pmod(F.xxhash64(salt), F.lit(ways)).cast("int"))
    copies = right.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return salted.join(copies, [*on, "_way"], how).drop("_way")


def counted_join(left: DataFrame, right: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """Equi-join with `right`, which holds each key once and in a column `n` how many of the `total` rows of `left` have it.

    Keys of more than a HOT_KEYS-th of all rows, and of more than HOT_ROWS, are fewer than HOT_KEYS. Their hashes reach the
    driver, which runs `right` for them at once; both sides are parted by these, so that other keys of an equal hash meet too.
    Hot keys are broadcast and their rows are not shuffled; of the rest, no key has more rows than that in any task. No
    row passes a join to be told hot from cold, and without hot keys there is one plain join. `n` is dropped.
    """
    if left.schema[on].dataType != right.schema[on].dataType:
        raise TypeError(f"{on} must be of one type on both sides")
    hashed = F.xxhash64(F.col(f"`{on}`"))
    hot = [r[0] for r in right.where(F.col("n") > max(total / HOT_KEYS, HOT_ROWS)).select(hashed).collect()]
    right = right.drop("n")
    if not hot:
        return left.join(right, on, how)
    is_hot = F.expr(f"xxhash64(`{on}`) IN ({', '.join(f'{h}L' for h in hot)})")
    by_task = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return by_task.unionByName(left.where(~is_hot).join(right.where(~is_hot), on, how))


def replace_columns(df: DataFrame, changed: dict[str, Column], like: DataFrame) -> DataFrame:
    """`df` with columns replaced, in the order and types of `like`."""
    types = dict(like.dtypes)
    return df.select(*[(changed[c].cast(types[c]) if c in changed else F.col(f"`{c}`")).alias(c) for c in like.columns])
