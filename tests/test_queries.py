import glob
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from lotlight.plans.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SLOW = {"ml_rf", "ml_xgb", "ml_softvote"}  # hundreds of trees


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.collect())) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8 and set(e.oracle_sql()) <= set(e.queries())


def test_without_the_other_subpackage(tmp_path):
    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "r", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'win_free_prob' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    for f in glob.glob(f"{ROOT}/lotlight/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert not re.search(r"lotlight\.llm|corpus_pipeline", open(f).read()), f


def test_filters_reach_the_scan(spark):
    plan = QUERIES["flt_isin"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(event_type|PushedFilters: \[[^\]]*EqualTo\(event_type", plan), plan
    assert "props" not in plan


def test_numbers_are_rounded_like_the_sql(spark, tmp_path):
    values = "[13.850000000000001, 109.14999999999999, 0.8500000000000001, 57.349999999999994, 0.25, 0.35, 0.0, -1.5, 1.7e308, 'inf'::DOUBLE, NULL]"  # times ten, the first four are halves by a float's rounding alone
    c = duckdb.connect()
    c.sql(f"COPY (SELECT CAST(row_number() OVER () AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' AS ts, CAST(1 AS BIGINT) AS user_id, 'a' AS event_type, value FROM (SELECT unnest({values}) AS value)) TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["fn_math"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['fn_math']})").fetchall()))
