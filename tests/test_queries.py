"""Every registered core query that has SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from seqlab.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu" or str(df[c].dtype).startswith(("Int", "Float")):
            df[c] = pd.to_numeric(df[c]).astype(float).round(5)
        else:
            df[c] = df[c].map(lambda v: "" if v is None or pd.isna(v) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got, want = ordered(queries.QUERIES[name](spark, SF).toPandas()), ordered(con.execute(queries.ORACLE_SQL[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], atol=1e-4, rtol=1e-9, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry_points_and_plans(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
    plan = queries.QUERIES["outing_rollup"](spark, SF)._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "ReadSchema" in plan  # one shuffle, shown in two plans


def test_panel_windows_share_one_exchange(spark):
    from seqlab.operators import panel

    df = spark.range(100).selectExpr("id % 5 as entity", "date_add(date'2020-01-01', cast(id as int) * 9) as day", "id as event_count", "cast(id as double) as score")
    df = df.repartition("entity")
    found = panel.prior_value(panel.history(panel.season_workload(df, "entity", "day"), "entity", "day", ["score"]), "entity", "day", "score")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
