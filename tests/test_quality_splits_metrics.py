from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from cadence.operators import metrics as me
from cadence.operators import quality as qa
from cadence.operators import splits as sp
from cadence.operators.ranking import ranked, running_sums

from conftest import h, make_roles


def test_iqr_fixture(spark):
    # Q2: values 1,2,3,4,100 -> Q1=2, Q3=4, one outlier
    df = spark.createDataFrame([("p", "c", float(v)) for v in (1, 2, 3, 4, 100)], "patient_id string, column_name string, v double")
    r = qa.iqr_outliers(df, ["patient_id", "column_name"]).first()
    assert (r["q1"], r["q3"], r["n_outliers"]) == (2.0, 4.0, 1)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=30))
def test_iqr_matches_pandas(spark, vals):
    df = spark.createDataFrame([("p", "c", v) for v in vals], "patient_id string, column_name string, v double")
    r = qa.iqr_outliers(df, ["patient_id", "column_name"]).first()
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    iqr = q3 - q1
    assert abs(r["q1"] - q1) < 1e-9 and abs(r["q3"] - q3) < 1e-9
    assert r["n_outliers"] == int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())


def test_missing_and_coverage(spark):
    roles = make_roles(spark, patients=[("p1", None, None, "F", None, None), ("p2", None, None, None, None, None)],
                       observations=[("p1", h(0), None, "1"), ("p1", h(24 * 40), "x", None)])
    tabs = {"patients": roles.patients, "observations": roles.observations}
    m = {r["patient_id"]: r for r in qa.missing_by_patient(tabs, roles.patients).collect()}
    assert (m["p1"]["missing_cells"], m["p1"]["total_cells"]) == (4 + 2, 6 + 8)
    assert m["p2"]["missing_share"] == 5 / 6 and not m["p2"]["is_valid"]
    cov = {r[0]: r[1] for r in qa.temporal_coverage(roles.observations, roles.patients).collect()}
    assert cov == {"p1": 1.0, "p2": 0.0}


def test_temporal_consistency(spark):
    roles = make_roles(spark, patients=[("p1", None, None, None, None, None)],
                       observations=[("p1", dt.datetime(2020, 1, 1), "a", "1"), ("p1", dt.datetime(2023, 1, 1), "a", "1"),
                                     ("p1", None, "a", "1")])
    r = qa.temporal_consistency(roles.observations, roles.patients, dt.datetime(2022, 1, 1)).first()
    assert (r["n_valid"], r["n_future"], r["long_period"], r["consistency_score"]) == (2, 1, True, 0.5)


def test_temporal_cut_points():
    # W1 sizes: n = 10, 100, 9106 -> 7/2/1, 75/15/10, 6829/1366/911
    for n, sizes in ((10, (7, 2, 1)), (100, (75, 15, 10)), (9106, (6829, 1366, 911))):
        val_end, test_end = sp.temporal_cut_points(n)
        assert (val_end, test_end - val_end, n - test_end) == sizes


def test_temporal_split_order(spark):
    obs = spark.createDataFrame([(f"p{i:02d}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)],
                                "patient_id string, ts timestamp_ntz")
    got = {r["patient_id"]: r["split"] for r in sp.temporal_split(obs).collect()}
    assert [got[f"p{i:02d}"] for i in range(10)] == ["train"] * 7 + ["validation"] * 2 + ["test"]


def test_stratified_split_scarcity(spark):
    # 4 patients, min_pos 3 -> complete and disjoint
    flags = spark.createDataFrame([(f"p{i}", 1, i % 2, 0) for i in range(4)],
                                  "patient_id string, mortality int, icu int, ventilator int")
    out = sp.stratified_split(flags).collect()
    ids = [r["patient_id"] for r in out]
    assert sorted(ids) == [f"p{i}" for i in range(4)] and len(set(ids)) == 4


def test_stratified_split_positives_everywhere(spark):
    rnd = random.Random(3)
    flags = spark.createDataFrame([(i, int(rnd.random() < .05), int(rnd.random() < .1), int(rnd.random() < .1))
                                   for i in range(400)], "patient_id long, mortality int, icu int, ventilator int")
    split = sp.stratified_split(flags)
    c = {r["split"]: r for r in sp.split_counts(split, flags).collect()}
    assert sum(r["n_patients"] for r in c.values()) == 400
    assert c["test"]["n_patients"] == 40 and c["validation"]["n_patients"] == 60
    for s in ("train", "validation", "test"):
        assert c[s]["icu_pos"] >= 3 and c[s]["ventilator_pos"] >= 3


def test_random_split_sizes(spark):
    pts = spark.range(1500).withColumnRenamed("id", "patient_id")
    c = {r["split"]: r["n_patients"] for r in sp.split_counts(sp.random_split(pts)).collect()}
    assert c == {"test": 150, "validation": 225, "train": 1125}


def test_ranked_and_running_sums_match_windows(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("aab"), rnd.randint(0, 50), i) for i in range(500)]  # hot group 'a'
    df = spark.createDataFrame(rows, "g string, o int, id int")
    r = {(x["g"], x["id"]): x["rn"] for x in ranked(df, ["g"], ["o", "id"], num_partitions=7).collect()}
    exp = sorted(rows, key=lambda t: (t[0], t[1], t[2]))
    seen = {}
    for g, o, i in exp:
        seen[g] = seen.get(g, 0) + 1
        assert r[(g, i)] == seen[g]
    agg = df.groupBy("g", "o").agg(F.count(F.lit(1)).alias("c"))
    cs = {(x["g"], x["o"]): x["cum_c"] for x in running_sums(agg, ["g"], "o", ["c"], num_partitions=5).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "o", "id"]).groupby(["g", "o"]).size().groupby(level=0).cumsum()
    assert cs == {k: int(v) for k, v in pdf.items()}


def _preds(spark, task, scores, targets):
    return spark.createDataFrame([(i, task, float(s), float(t)) for i, (s, t) in enumerate(zip(scores, targets))],
                                 "patient_id long, task string, prediction double, target double")


def test_auroc_ties(spark):
    # Scores .1 .4 .4 .8, targets 0 0 1 1 -> 0.875
    b = me.binary_metrics(_preds(spark, "mortality_risk", [.1, .4, .4, .8], [0, 0, 1, 1])).first()
    assert abs(b["auroc"] - 0.875) < 1e-12
    assert abs(b["auprc"] - (0.5 * 1.0 + 0.5 * (2 / 3))) < 1e-12


def test_degenerate_confusion(spark):
    # E5: all targets 0 and all predictions below .5 -> 1, 0, 0, 1
    b = me.binary_metrics(_preds(spark, "icu_admission", [.1, .2, .3], [0, 0, 0])).first()
    assert (b["specificity"], b["sensitivity"], b["positive_predictive_value"], b["negative_predictive_value"]) == \
        (1.0, 0.0, 0.0, 1.0)
    assert b["auroc"] is None


def test_sigmoid_applied_when_out_of_range(spark):
    b = me.binary_metrics(_preds(spark, "ventilator_need", [-3.0, 0.2, 2.0], [0, 1, 1])).first()
    assert (b["tp"], b["fp"], b["tn"], b["fn"]) == (2, 0, 1, 0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=2, max_size=40))
def test_auroc_brute_force_and_monotone(spark, pairs):
    s = [p[0] / 20 for p in pairs]
    t = [p[1] for p in pairs]
    pos = [a for a, b in zip(s, t) if b == 1]
    neg = [a for a, b in zip(s, t) if b == 0]
    a1 = me.binary_metrics(_preds(spark, "mortality_risk", s, t)).first()["auroc"]
    a2 = me.binary_metrics(_preds(spark, "mortality_risk", [x ** 3 for x in s], t)).first()["auroc"]
    if not pos or not neg:
        assert a1 is None
        return
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a1 - brute) < 1e-12 and abs(a2 - brute) < 1e-12


def test_regression_metrics(spark):
    p = _preds(spark, "length_of_stay", [10, 20, 30], [10, 50, 30])
    r = me.regression_metrics(p).first()
    e = np.array([0, 30, 0.0])
    assert abs(r["mae"] - 10) < 1e-12 and abs(r["rmse"] - np.sqrt((e ** 2).mean())) < 1e-12
    assert abs(r["within_24h"] - 2 / 3) < 1e-12 and r["within_48h"] == 1.0
    c = me.regression_metrics(_preds(spark, "length_of_stay", [1, 2], [5, 5])).first()
    assert c["r2"] == 0.0  # E8: constant targets


def test_residual_histogram_all_bins(spark):
    p = _preds(spark, "length_of_stay", list(range(31)), [0] * 31)
    hist = me.residual_histogram(p).orderBy("bin").collect()
    assert len(hist) == 30 and sum(r["n"] for r in hist) == 31 and hist[-1]["n"] == 2


def test_residual_is_prediction_minus_target(spark):
    # over-predictions 0..10 lie right of zero; most of them are small
    p = _preds(spark, "length_of_stay", [0, 0, 0, 1, 10], [0] * 5)
    hist = me.residual_histogram(p, bins=10).orderBy("bin").collect()
    assert (hist[0]["bin_start"], hist[-1]["bin_end"]) == (0.0, 10.0)
    assert [r["n"] for r in hist] == [3, 1] + [0] * 7 + [1]


def test_roc_starts_at_the_origin(spark):
    pts = me.roc_points(_preds(spark, "mortality_risk", [.1, .4, .4, .8], [0, 0, 1, 1])).collect()
    got = sorted(((r["fpr"], r["tpr"], r["threshold"]) for r in pts), key=lambda x: x[:2])
    assert got == [(0.0, 0.0, None), (0.0, 0.5, 0.8), (0.5, 1.0, 0.4), (1.0, 1.0, 0.1)]


def test_auroc_counts_beyond_long(spark):
    # 5e9 positives and negatives each: their product doesn't fit a LONG
    n = 5_000_000_000
    g = spark.createDataFrame([("t", 0.2, 0, n, 0, 0, n, n), ("t", 0.9, n, 0, 0, n, n, n)],
                              "task string, score double, pos long, neg long, below_pos long, below_neg long, P long, N long")
    g = g.withColumn("tp_at", F.col("P") - F.col("below_pos")).withColumn("fp_at", F.col("N") - F.col("below_neg"))
    r = g.groupBy("task").agg(me._auroc().alias("a"), me._average_precision().alias("p")).first()
    assert (r["a"], r["p"]) == (1.0, 1.0)


def test_hot_group_is_split_across_partitions(spark):
    # one entity holds a third of all rows: range partitioning must cut it
    from cadence.operators.ranking import tagged
    rows = [("hot" if i % 3 == 0 else f"p{i % 97}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, o int")
    sizes = [r["n"] for r in tagged(df, ["g"], ["o"], 12).groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 10 and max(sizes) < 2 * 6000 / 12
    hot = ranked(df, ["g"], ["o"], num_partitions=12).where(F.col("g") == "hot").orderBy("o").collect()
    assert [r["rn"] for r in hot] == list(range(1, 2001))


def test_stratified_split_equals_sequential_definition(spark):
    rnd = random.Random(8)
    rows = [(i, int(rnd.random() < .08), int(rnd.random() < .12), int(rnd.random() < .2)) for i in range(300)]
    flags = spark.createDataFrame(rows, "patient_id long, mortality int, icu int, ventilator int")
    got = {r["patient_id"]: r["split"] for r in sp.stratified_split(flags, min_pos=3, seed=42).collect()}
    h = {r[0]: hashlib.md5(f"{r[0]}:42".encode()).hexdigest() for r in rows}
    order = sorted(h, key=lambda p: (h[p], p))
    lab = {p: dict(zip(("mortality", "icu", "ventilator"), r[1:])) for r in rows for p in [r[0]]}
    assigned = {}
    for label in ("mortality", "icu", "ventilator"):
        for split in ("test", "validation", "train"):
            for p in [p for p in order if lab[p][label] == 1 and p not in assigned][:3]:
                assigned[p] = split
    n_test, n_val = round(300 * 0.1), round(300 * 0.15)
    need = {"test": n_test - sum(v == "test" for v in assigned.values()),
            "validation": n_val - sum(v == "validation" for v in assigned.values())}
    for p in [p for p in order if p not in assigned]:
        if need["test"] > 0:
            assigned[p], need["test"] = "test", need["test"] - 1
        elif need["validation"] > 0:
            assigned[p], need["validation"] = "validation", need["validation"] - 1
        else:
            assigned[p] = "train"
    assert got == assigned


def test_ranking_keeps_null_groups(spark):
    from cadence.operators.ranking import next_in_group
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 3)], "g string, o int")
    r = {(x["g"], x["o"]): x["rn"] for x in ranked(df, ["g"], ["o"]).collect()}
    assert r == {("a", 1): 1, ("a", 3): 2, (None, 1): 1, (None, 2): 2}
    nx = {(x["g"], x["o"]): x["nxt"] for x in next_in_group(df, ["g"], ["o"], "o", "nxt").collect()}
    assert nx == {(None, 1): 2, (None, 2): None, ("a", 1): 3, ("a", 3): None}
    agg = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "g string, o int, c int")
    cs = {(x["g"], x["o"]): x["cum_c"] for x in running_sums(agg, ["g"], "o", ["c"]).collect()}
    assert cs == {(None, 1): 2, (None, 2): 5, ("a", 1): 5}


@pytest.mark.parametrize("rows,bound", [
    ([(i * 7919 % 1000, f"p{i % 13}", i) for i in range(1000)], 100_000), ([(i * 7919 % 1000, f"p{i % 13}", i) for i in range(1000)], 5),
    ([(5, None if i % 50 == 0 else f"p{i}", i) for i in range(300)], 100_000), ([(5, f"p{i}", i) for i in range(300)], 10),
    ([(1, "a", 0)], 10), ([], 10), ([(i // 200, f"p{i % 3}", i) for i in range(600)], 20)])
def test_first_rows_are_those_of_a_full_sort(spark, monkeypatch, rows, bound):
    from cadence.operators import ranking
    monkeypatch.setattr(ranking, "CUT_ROWS", bound)
    df = spark.createDataFrame(rows, "k long, name string, id long").repartition(3)
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    ranks = [0, 1, len(rows) // 3, len(rows) // 2, len(rows) - 1, len(rows), len(rows) + 5]
    for r, first in zip(ranks, ranking.first_rows(df, "k", ["name", "id"], ranks)):
        assert sorted(x["id"] for x in df.where(first).collect()) == sorted(x[2] for x in want[:max(0, r)])


def test_temporal_split_neither_sorts_nor_writes(spark, monkeypatch):
    import os
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    from cadence.operators import ranking
    monkeypatch.setattr(ranking, "CUT_ROWS", 50)
    obs = spark.range(2000).select((F.col("id") % 500).alias("patient_id"), F.timestamp_micros(F.col("id") * 1000003 % 977 * 1000000).cast("timestamp_ntz").alias("ts"))
    split = sp.temporal_split(obs)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort [" not in plan and set(os.listdir(base)) == before
    got = {r["patient_id"]: r["split"] for r in split.collect()}
    first = sorted((min((i * 1000003 % 977) for i in range(p, 2000, 500)), p) for p in range(500))
    val_end, test_end = sp.temporal_cut_points(500)
    assert got == {p: "train" if i < val_end else "validation" if i < test_end else "test" for i, (_, p) in enumerate(first)}
