"""Plans and results of steps that have to hold on large tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cadence.functions.vocab import STATIC_FEATURES
from cadence.operators import export as ex
from cadence.operators import timeline as tl


def _broadcast(df) -> str:
    """What ``df``, run, has sent to every task: the lines of the trees under its final plan's broadcast exchanges."""
    df.collect()
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0].splitlines():
        at = re.search(r"[A-Za-z(*]", line)
        if depth is not None and at and at.start() > depth:
            out.append(line)
        else:
            depth = at.start() if at and "BroadcastExchange" in line else None
    return "\n".join(out)


def _ready(spark, n=3):
    import datetime as dt
    split = spark.createDataFrame([(i, "train") for i in range(n + 1)], "patient_id long, split string")
    anchors = spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in range(n)], "patient_id long, t0 timestamp_ntz")
    static = anchors.select("patient_id", *[F.lit(float(i)).alias(c) for i, c in enumerate(STATIC_FEATURES)])
    targets = anchors.select("patient_id", *[F.col("patient_id").cast("double").alias(t) for t in ex.TARGETS])
    seg = spark.createDataFrame([(i, 1, 2, 3, float(i + 1)) for i in range(n)],
                                "patient_id long, ch int, h_start int, h_end int, value double")
    return ex.model_ready(static, ex.dense_matrix(seg, anchors, 2, 5), targets, split, 5, 2)


def test_dense_matrices_are_never_broadcast(spark):
    m = _ready(spark)
    assert "MapInArrow" in m._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in _broadcast(m)
    assert "collect_list" not in _broadcast(m)  # nor the segments that fill them
    got = {r["patient_id"]: r for r in m.collect()}
    assert got[1]["temporal"] == [[0, 0], [0, 0], [0, 2], [0, 2], [0, 0]] and got[1]["sequence_length"] == 5
    assert got[3]["temporal"] == [[0, 0]] * 5 and got[3]["sequence_length"] == 0  # no timeline


def test_batches_do_not_broadcast_their_rows(spark):
    b = ex.batches(_ready(spark), 2)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "temporal" in plan and "temporal" not in _broadcast(b)
    assert sorted(r["batch_len"] for r in b.collect()) == [2, 2]
    assert sorted(p for r in b.collect() for p in r["patient_id"]) == [0, 1, 2, 3]


def test_batches_hold_few_rows_at_once(spark):
    """Wide rows are small in files and shuffles: what a task unpacks or packs must not be chosen by bytes."""
    import pyarrow.parquet as pq
    n = 399
    b = ex.batches(_ready(spark, n), 4)
    assert b.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 3 * ex.TASK_BATCHES
    assert sorted(r["batch_len"] for r in b.collect()) == [4] * 100
    assert sorted(p for r in b.collect() for p in r["patient_id"]) == list(range(n + 1))
    groups = [meta.row_group(i).num_rows for f in b.inputFiles() for meta in [pq.read_metadata(f.removeprefix("file:"))]
              if "temporal" in meta.schema.to_arrow_schema().names for i in range(meta.num_row_groups)]
    assert sum(groups) == n + 1 and max(groups) <= ex.GRID_PATIENTS


def test_the_whole_grid_is_returned(spark):
    import __spark_entry__ as entry
    df = entry.queries()["dense_grid_zero_fill"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["patient_id", "hour_idx", "value"]
    per = df.groupBy("patient_id").agg(F.count("value").alias("n"), F.countDistinct("hour_idx").alias("h")).collect()
    assert per and all(r["n"] == r["h"] == tl.GRID_LEN for r in per)


def test_every_row_is_weighed_in_every_bootstrap_sample(spark):
    import hashlib
    import numpy as np
    from cadence.operators import bootstrap as bs
    rng = np.random.default_rng(4)
    t, s = rng.integers(0, 2, 200), rng.random(200)
    df = spark.createDataFrame([(i // 2, "icu_admission", float(a), float(b)) for i, (a, b) in enumerate(zip(s, t))],
                               "patient_id long, task string, prediction double, target double")
    n = 50
    u = np.array([[int(hashlib.md5(f"icu_admission:{i // 2}:{r}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(200)] for r in range(1, n + 1)])
    w = np.vstack([np.ones(200), (u[:, :, None] >= np.array(bs.POISSON_CDF)).sum(axis=2)])
    tp, fp, tn, fn = (w[:, (t == a) & ((s > .5) == b)].sum(axis=1) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))
    want = {"precision": tp / (tp + fp), "recall": tp / (tp + fn), "specificity": tn / (tn + fp), "f1_score": 2 * tp / (2 * tp + fp + fn)}
    got = {r["metric"]: r for r in bs.bootstrap_intervals(df, n).collect()}
    for m, v in want.items():
        assert [got[m][c] for c in ("estimate", "low", "high")] == pytest.approx([v[0], *np.percentile(v[1:], [2.5, 97.5])])


def test_outliers_by_arrays_and_by_ranks_agree(spark):
    """Groups of up to ``array_values`` values and larger ones get what numpy finds; NULL keys are a group."""
    import numpy as np
    from cadence.operators import quality as qa
    rng = np.random.default_rng(3)
    groups = {"a": np.append(rng.normal(size=40), [9.0, -9.0]), "b": np.array([1.0, 2, 3, 4, 100]), None: np.round(rng.normal(size=30), 1), "c": np.array([7.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame([*rows, ("a", None), ("b", float("nan"))], "g string, v double")
    for limit in (100, 20, 0):
        got = {r["g"]: r for r in qa.iqr_outliers(df, ["g"], array_values=limit).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            q1, q3 = np.quantile(vs, [0.25, 0.75])
            out = ((vs < q1 - 1.5 * (q3 - q1)) | (vs > q3 + 1.5 * (q3 - q1))).sum()
            assert (got[g]["q1"], got[g]["q3"]) == pytest.approx((q1, q3)) and got[g]["n_outliers"] == out


def test_outliers_of_small_groups_are_not_range_sorted(spark):
    from cadence.operators import quality as qa
    plan = qa.iqr_outliers(spark.createDataFrame([("a", 1.0)], "g string, v double"), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_active_segments_are_dealt_to_a_stated_number_of_tasks(spark):
    """Few bytes of segments become many hours: they must not be joined to one task by their size."""
    import datetime as dt
    from cadence.functions.vocab import Vocab
    t0 = dt.datetime(2024, 1, 1)
    anchors = spark.createDataFrame([(i, t0) for i in range(40)], "patient_id long, t0 timestamp_ntz")
    iv = spark.createDataFrame([(i, t0 + dt.timedelta(hours=i), None, "drug") for i in range(40)],
                               "patient_id long, start timestamp_ntz, stop timestamp_ntz, description string")
    df = tl.hourly_active_counts(iv, anchors, Vocab.of("v", [("drug", ["drug"])]))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    used = {r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}
    assert df.count() == sum(720 - i for i in range(40)) and len(used) > n // 2


def test_tables_of_a_baseline_are_not_broadcast(spark):
    import numpy as np
    from cadence.operators import baseline as ba
    p = spark.range(50).withColumnRenamed("id", "patient_id")
    x, _ = ba.feature_table(p, [(p.withColumn("a", F.rand(1)), ["a"]), (p.withColumn("b", F.rand(2)), ["b"])])
    assert "patient_id" not in _broadcast(x)
    labels = p.select("patient_id", *[(F.col("patient_id") % (i + 2) == 0).cast("int").alias(t) for i, t in enumerate(ba.TASKS)])
    tasks = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        model = ba.fit_baselines(x, ["a", "b"], labels, p)
        stages = [tasks.getStageInfo(s) for j in tasks.getJobIdsForGroup("fit") for s in tasks.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # the iterations, by far the most stages, run a task for each FIT_ROWS rows
    assert np.median([s.numTasks for s in stages if s]) == 1 and len(ba.linear_weights(model)[1]) == 4


def test_batch_members_reads_few_wide_rows_at_once(spark, tmp_path):
    """The query itself: each row group of its wide rows, which a reader unpacks whole, holds few; every patient is a member once."""
    import datetime as dt
    import pyarrow.parquet as pq
    import __spark_entry__ as entry
    n, kinds, t0 = 150, ("view", "click", "purchase", "error", "signup"), dt.datetime(2024, 1, 1)
    events = [(3 * i + j, t0 + dt.timedelta(hours=i + 30 * j), i, kinds[(i + j) % 5], float(i)) for i in range(n) for j in range(3)]
    orders = [(i, i, "O", 10.0 * i, t0, "1-URGENT") for i in range(n)]
    customers = [(i, i % 25, 1.0, "BUILDING") for i in range(n)]
    for name, rows, schema in (
            ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
            ("customer", customers, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    b = entry.queries()["batch_members"](spark, str(tmp_path))
    got = b.collect()
    assert sorted(r["patient_id"] for r in got) == list(range(n))
    places = {(r["split"], r["batch_id"], r["position"]) for r in got}
    assert len(places) == n and all(r["position"] < r["batch_len"] <= 32 and r["temporal_size"] == 720 for r in got)
    metas = [pq.read_metadata(f.removeprefix("file:")) for f in b.inputFiles()]
    groups = [m.row_group(i).num_rows for m in metas if "temporal" in m.schema.to_arrow_schema().names for i in range(m.num_row_groups)]
    assert sum(groups) == n and max(groups) <= ex.GRID_PATIENTS
