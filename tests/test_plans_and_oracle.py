"""Plan-shape checks and the DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TIMELINE_QUERIES = ["hourly_vitals_collapsed", "hourly_labs_collapsed", "hourly_procedures", "hourly_active_meds",
                    "hourly_active_devices", "channel_stats"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", TIMELINE_QUERIES)
def test_no_range_join_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas"):
        assert bad not in plan, bad


def test_scan_prunes_columns(spark):
    df = entry.queries()["hourly_vitals_collapsed"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan  # the JSON column of events is never read


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "channel", "mean", "std", "max", "trend"]
    rows = df.collect()
    channels = {r["channel"] for r in rows}
    assert len(channels) == 5 and len(rows) == 5 * len({r["patient_id"] for r in rows}) > 0
    assert all(r["std"] >= 0 and r["max"] >= r["mean"] for r in rows if r["max"] >= 0)


def _norm(rows):
    out = []
    for r in rows:
        t = []
        for v in r:
            if isinstance(v, float):
                t.append(None if math.isnan(v) else round(v, 5) + 0.0)
            elif hasattr(v, "isoformat"):
                t.append(v.isoformat())
            else:
                t.append(v)
        out.append(tuple(t))
    return sorted(out, key=lambda x: tuple((e is None, str(e)) for e in x))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    got = _norm(tuple(r[c] for c in cols) for r in sdf.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    exp = _norm(tuple(r[i] for i in idx) for r in res.fetchall())
    assert got == exp


def test_materialized_tables_end_with_their_scope(spark):
    import os
    from cadence.operators.ranking import materialized_scope, ranked
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    with materialized_scope(spark):
        rows = ranked(spark.range(100).withColumnRenamed("id", "x"), [], ["x"]).collect()
        assert set(os.listdir(base)) - before
    assert [r["rn"] for r in sorted(rows)] == list(range(1, 101)) and set(os.listdir(base)) == before


def test_strict_labs_match_whole_symbols(spark):
    from pyspark.sql import functions as F
    from cadence.functions.vocab import TIMELINE_LABS, TIMELINE_LABS_STRICT, any_keyword
    df = spark.createDataFrame([("click",), ("K [Moles/volume]",), ("Na serum",), ("nausea",)], "d string")
    hits = lambda v: [r["h"] for r in df.select(any_keyword(F.col("d"), v.all_keywords(), v.mode).alias("h")).collect()]
    assert hits(TIMELINE_LABS) == [True, True, True, True] and hits(TIMELINE_LABS_STRICT) == [False, True, True, False]


def test_cohort_slices(spark):
    from cadence.operators.cohort import cohort_sample
    ids = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)], "patient_id long")
    assert [r[0] for r in cohort_sample(ids, 1, 2).collect()] == [3, 5]
    assert sorted(r[0] for r in cohort_sample(ids, 3).collect()) == [7, 9] and cohort_sample(ids, 9, 2).count() == 0
