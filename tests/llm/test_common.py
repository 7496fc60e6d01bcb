import pytest
from pyspark.sql import functions as F

from lotlight.llm.common import counted_join

#: A hot key, some others, one that only the left side has, and null.
KEYS = [7] * 500 + [k for k in range(100, 160) for _ in range(3)] + [900] * 200 + [None] * 4


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(k, i) for i, k in enumerate(KEYS)], "key long, row long")


def counted(left, keys):
    counts = left.where(F.col("key").isin(keys)).groupBy("key").agg(F.count("*").alias("n"))
    return counts.withColumn("what", F.concat(F.lit("w"), F.col("key").cast("string")))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_counted_join(left, how, kind):
    cast = lambda df: df.withColumn("key", F.col("key").cast("string").cast(kind))
    df, right = cast(left), cast(counted(left, [7, *range(100, 150)]))
    want = sorted(map(str, df.join(right.drop("n"), "key", how).collect()))
    assert len(want) == (650 if how == "inner" else len(KEYS))
    assert sorted(map(str, counted_join(df, right, "key", len(KEYS), how).collect())) == want


def test_counted_join_passes_no_row_of_no_match(left):
    """Rows are told hot from cold by no join, so that joins put out what matches alone; without a hot key there is one join."""
    for keys, joins in ([7, 100], 2), ([100, 101], 1):
        out = counted_join(left, counted(left, keys), "key", len(KEYS))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("Join Inner") == joins


def test_counted_join_of_unlike_keys(left):
    with pytest.raises(TypeError):
        counted_join(left, counted(left, [7]).withColumn("key", F.col("key").cast("int")), "key", len(KEYS))
