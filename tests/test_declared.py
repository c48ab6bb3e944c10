"""Declared features against small hand-made or brute-force results."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import baseline as ba
from cadence.operators import bootstrap as bs
from cadence.operators import declared as de
from cadence.operators import metrics as me
from cadence.operators.quality import dtype_profile, iqr_outliers


def _preds(spark, scores, targets, task="mortality_risk"):
    return spark.createDataFrame([(i, task, float(s), float(t)) for i, (s, t) in enumerate(zip(scores, targets))],
                                 "patient_id long, task string, prediction double, target double")


def test_forward_fill_holds_until_the_next_value(spark):
    x = spark.createDataFrame([("a", 3, 1.0), ("a", 10, 2.0), ("a", 5, None), ("b", 719, 4.0)], "p string, hour_idx int, value double")
    got = sorted(tuple(r) for r in de.forward_fill(x, ["p"], 720).collect())
    assert got == [("a", 3, 9, 1.0), ("a", 10, 719, 2.0), ("b", 719, 719, 4.0)]


def test_clip_outliers(spark):
    x = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("g", None), (None, 5.0)], "g string, v double")
    got = {(r["g"], r["v"], r["clipped"]) for r in de.clip_outliers(x, ["g"]).collect()}
    assert ("g", 7.0, True) in got and ("g", None, False) in got and (None, 5.0, False) in got and len(got) == 7


def test_calibration_error(spark):
    r = de.calibration_error(_preds(spark, [0.05, 0.05, 0.95, 1.0], [0, 1, 1, 1])).first()
    assert abs(r["calibration_error"] - (0.5 * abs(0.05 - 0.5) + 0.5 * abs(0.975 - 1.0))) < 1e-12


def test_clip_outliers_of_the_unknown_group(spark):
    x = spark.createDataFrame([(g, v) for g in ("a", None) for v in (1.0, 2.0, 3.0, 4.0, 100.0)], "g string, v double")
    got = {(r["g"], r["v"]) for r in de.clip_outliers(x, ["g"]).collect() if r["clipped"]}
    assert got == {("a", 7.0), (None, 7.0)}
    assert {r["g"]: r["n_outliers"] for r in iqr_outliers(x, ["g"]).collect()} == {"a": 1, None: 1}


def test_metrics_leave_out_rows_without_prediction_or_target(spark):
    rows = [(1, 10.0, 12.0), (2, 20.0, 19.0), (3, None, 500.0), (4, 7.0, None)]
    p = spark.createDataFrame([(i, "length_of_stay", a, b) for i, a, b in rows], "patient_id long, task string, prediction double, target double")
    r = me.regression_metrics(p).first()
    assert r["n"] == 2 and r["r2"] == pytest.approx(1 - 5 / 24.5)
    b = spark.createDataFrame([(1, "icu_admission", .2, 0.0), (2, "icu_admission", .9, 1.0), (3, "icu_admission", None, 1.0),
                               (4, "icu_admission", .5, None)], "patient_id long, task string, prediction double, target double")
    assert sorted((r["threshold"] is None, r["threshold"]) for r in me.roc_points(b).collect()) == [(False, .2), (False, .9), (True, None)]
    assert me.roc_points(b).count() == 3 and de.calibration_error(b).first()["n"] == 2
    assert me.confusion(b).first()["n"] == 2 and de.risk_bands(b).agg(F.sum("n")).first()[0] == 2
    assert {r["task"]: r["loss"] for r in de.multi_task_loss(b).collect()}["icu_admission"] == pytest.approx(-(math.log(.8) + math.log(.9)) / 2)
    assert {r["label"]: r["n"] for r in de.class_weights(b).collect()} == {0: 1, 1: 2}  # needs targets only


def _poisson_cdf(n, k):
    return sum(math.exp(i * math.log(n) - n - math.lgamma(i + 1)) for i in range(int(k) + 1))


@pytest.mark.parametrize("n", [1, 5, 32, 33, 100, 2500])
def test_poisson_draws_are_quantiles(spark, n):
    """Every draw is the quantile of its uniform number, and mean and variance are the count."""
    key = F.concat_ws(":", F.lit("t"), "id")
    u = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    rows = spark.range(20000).select(u.alias("u"), bs.poisson_draw(F.lit(n).cast("long"), key).alias("k")).toPandas()
    assert abs(rows["k"].mean() / n - 1) < 4 / math.sqrt(20000 * n) and abs(rows["k"].var() / n - 1) < 0.05
    slack = 1e-9 if n <= bs.EXACT_UP_TO else 5e-4
    for k, part in rows.groupby("k"):
        low = _poisson_cdf(n, k - 1) if k else 0.0
        assert low - slack <= part["u"].min() and part["u"].max() <= _poisson_cdf(n, k) + slack
    assert spark.range(1).select(bs.poisson_draw(F.lit(0).cast("long"), F.lit("x"))).first()[0] == 0


def test_bootstrap_intervals_against_resampling(spark):
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, 600)
    s = np.clip(t * 0.3 + rng.random(600) * 0.7, 0, 1)
    got = {r["metric"]: r for r in bs.bootstrap_intervals(_preds(spark, s, t), 2000).collect()}
    draws = {m: [] for m in got}
    for _ in range(2000):
        w = rng.poisson(1, 600)
        tp, fp, tn, fn = (w[(t == a) & ((s > .5) == b)].sum() for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))
        for m, v in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("specificity", tn / (tn + fp)),
                     ("f1_score", 2 * tp / (2 * tp + fp + fn))):
            draws[m].append(v)
    for m, r in got.items():
        assert r["low"] <= r["estimate"] <= r["high"]
        assert np.allclose([r["low"], r["high"]], np.percentile(draws[m], [2.5, 97.5]), atol=0.012)


def test_bootstrap_work_does_not_grow_with_the_rows(spark):
    """No row is repeated per replicate: the only explosion has one row per task and replicate."""
    plan = bs.bootstrap_intervals(_preds(spark, [.1, .9], [0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("HashAggregate(keys=[task") and plan.count("Generate explode") == 1


def _ap(score, y, w):
    total, out = 0.0, 0.0
    tp = fp = 0.0
    for v in np.unique(score)[::-1]:
        pos, neg = w[(score == v) & (y == 1)].sum(), w[(score == v) & (y == 0)].sum()
        tp, fp, total = tp + pos, fp + neg, total + pos
        out += pos * tp / (tp + fp) if tp + fp else 0.0
    return out / total


@pytest.mark.parametrize("pieces", [1, 5])
def test_rank_intervals_against_the_same_weights_row_by_row(spark, pieces, monkeypatch):
    monkeypatch.setattr(bs, "ROWS", 7)
    rng = np.random.default_rng(2)
    t = rng.integers(0, 2, 150)
    s = np.round(np.clip(t * 0.3 + rng.random(150) * 0.7, 0, 1), 2)  # ties
    df = _preds(spark, s, t).unionByName(_preds(spark, [.3, .4], [1, 1], "icu_admission"))
    got = {(r["task"], r["metric"]): r for r in bs.bootstrap_rank_intervals(df, 60, num_partitions=pieces).collect()}
    keys = {r["prediction"]: r["k"] for r in df.where("task = 'mortality_risk'").select("prediction", F.xxhash64("task", "prediction").alias("k")).collect()}
    groups = sorted({(v, int(((s == v) & (t == 1)).sum()), int(((s == v) & (t == 0)).sum())) for v in s.tolist()})
    key = np.array([keys[g[0]] for g in groups], np.int64).view(np.uint64)
    pos = bs.weights(np.array([g[1] for g in groups]), key, 60)
    neg = bs.weights(np.array([g[2] for g in groups]), ~key, 60)
    score = np.repeat([g[0] for g in groups], 2)
    y = np.tile([1, 0], len(groups))
    auroc, auprc = [], []
    for r in range(61):
        w = np.stack([pos[:, r], neg[:, r]], axis=1).ravel()
        a, b = score[y == 1][:, None], score[y == 0][None]
        win = (a > b) + 0.5 * (a == b)
        auroc.append((w[y == 1][:, None] * w[y == 0] * win).sum() / (w[y == 1].sum() * w[y == 0].sum()))
        auprc.append(_ap(score, y, w))
    for m, v in (("auroc", auroc), ("auprc", auprc)):
        r = got["mortality_risk", m]
        assert np.allclose([r["estimate"], r["low"], r["high"]], [v[0], *np.percentile(v[1:], [2.5, 97.5])])
    exact = me.score_metrics(df.where("task = 'mortality_risk'")).first()
    assert got["mortality_risk", "auroc"]["estimate"] == pytest.approx(exact["auroc"])
    assert got["mortality_risk", "auprc"]["estimate"] == pytest.approx(exact["auprc"])
    assert got["icu_admission", "auroc"]["estimate"] is None and got["icu_admission", "auprc"]["low"] == 1.0


def test_replicate_weights_are_poisson():
    for n in (1, 3, 40):
        w = bs.weights(np.full(2000, n), np.arange(2000).astype(np.uint64), 100)
        assert (w[:, 0] == n).all() and abs(w[:, 1:].mean() / n - 1) < 0.01 and abs(w[:, 1:].var() / n - 1) < 0.03


def test_registered_bootstrap_draws_the_declared_samples(spark):
    import __spark_entry__ as entry
    from cadence.plans.declared import _binary
    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted((r["task"], r["metric"], round(r["low"], 6), round(r["high"], 6)) for r in df.collect())
    got = rows(entry.queries()["bootstrap_intervals"](spark, sf))
    assert got == rows(bs.bootstrap_intervals(_binary(spark, sf), 1000)) != rows(bs.bootstrap_intervals(_binary(spark, sf), 100))


def test_p_values_and_bonferroni(spark):
    z = spark.createDataFrame([(0.0,), (1.959963985,), (-2.575829304,)], "z double").select(de.two_sided_p(F.col("z")).alias("p_value"))
    p = [r["p_value"] for r in z.collect()]
    assert np.allclose(p, [1.0, 0.05, 0.01], atol=1e-6)
    assert np.allclose([r["p_adjusted"] for r in de.bonferroni(z).collect()], [1.0, 0.15, 0.03], atol=1e-5)


def test_folds_are_a_stratified_partition(spark):
    x = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "patient_id long, y int")
    got = {r["patient_id"]: r["fold"] for r in de.stratified_folds(x, ["y"], 5).collect()}
    assert len(got) == 200
    assert [sum(f == k and i % 10 == 0 for i, f in got.items()) for k in range(5)] == [4] * 5


def test_calendar_split(spark):
    x = spark.createDataFrame([("a", dt.datetime(2022, 12, 31, 23)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2023, 1, 1)),
                               ("c", None)], "patient_id string, ts timestamp_ntz")
    assert {r[0]: r[1] for r in de.calendar_split(x, dt.date(2023, 1, 1)).collect()} == {"a": "train", "b": "test"}


def test_weights_bands_and_loss(spark):
    p = _preds(spark, [0.1, 0.5, 0.9, 0.9], [0, 0, 1, 0])
    assert {r["label"]: r["weight"] for r in de.class_weights(p).collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    assert {r["band"]: (r["n"], r["outcome_rate"]) for r in de.risk_bands(p).collect()} == {
        "low": (1, 0.0), "moderate": (1, 0.0), "high": (2, 0.5)}
    both = p.unionByName(_preds(spark, [3.0], [1.0], "length_of_stay"))
    loss = {r["task"]: r["loss"] for r in de.multi_task_loss(both).collect()}
    bce = -(math.log(.9) + math.log(.5) + math.log(.9) + math.log(.1)) / 4
    assert loss["mortality_risk"] == pytest.approx(bce) and loss["length_of_stay"] == 4.0
    assert loss["total"] == pytest.approx(2 * bce + 4)


def test_psi_is_zero_for_equal_shares(spark):
    x = spark.createDataFrame([(s, "f", float(v)) for s in ("train", "test") for v in range(100)]
                              + [("late", "f", 99.0)] * 50, "split string, feature string, value double")
    got = {r["split"]: r["psi"] for r in de.population_stability(x, "train").collect()}
    assert abs(got["test"]) < 1e-12 and got["late"] > 2


def test_baselines_learn_and_match_closed_form_ridge(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((300, 4)) < 0.6, 0.0, rng.normal(2, 3, (300, 4)))  # sparse
    flag = (x[:, 0] + 0.3 * rng.normal(size=300) > 1).astype(int)
    stay = 5 + 2 * x[:, 1] - x[:, 3] + rng.normal(size=300)
    names = ["a", "vitals__mean", "b.c", "d"]
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["patient_id", *["f0", "f1", "f2", "f3"]]).toDF("patient_id", *names)
    table, columns = ba.feature_table(table, [(table, names[:2]), (table.where("patient_id < 290"), [names[3]])])
    x[290:, 3] = 0.0
    x = x[:, [0, 1, 3]]
    labels = spark.createDataFrame([(i, int(f), None, int(f) if i % 2 else None, float(v) if i < 250 else None) for i, (f, v) in enumerate(zip(flag, stay))],
                                   "patient_id long, mortality_risk int, icu_admission int, ventilator_need int, length_of_stay double")
    train = table.where("patient_id < 270").select("patient_id")
    model = ba.fit_baselines(table, columns, labels, train, penalty=0.05)
    ba.save_model(model, str(tmp_path / "model"))
    model = ba.load_model(str(tmp_path / "model"))
    got_columns, weights = ba.linear_weights(model)
    assert got_columns == columns == ["a", "vitals__mean", "d"] and set(weights) == {"mortality_risk", "ventilator_need", "length_of_stay"}
    xt, yt = x[:250], stay[:250]
    z, yc = (xt - xt.mean(axis=0)) / xt.std(axis=0), yt - yt.mean()
    w = np.linalg.solve(z.T @ z / 250 + 0.05 * np.eye(3), z.T @ yc / 250) / xt.std(axis=0)
    assert np.allclose(weights["length_of_stay"][0], w, atol=1e-4)
    assert weights["length_of_stay"][1] == pytest.approx(yt.mean() - xt.mean(axis=0) @ w, abs=1e-4)
    by_model = {r["patient_id"]: r for r in ba.scored_by(model, table).collect()}
    by_batch = {r["patient_id"]: r for r in ba.score_batches(table.repartition(3), columns, weights, rows=16).collect()}
    assert len(by_model) == len(by_batch) == 300
    for i in range(300):
        assert by_model[i]["icu_admission"] is None and by_batch[i]["icu_admission"] is None
        for t in weights:
            assert by_batch[i][t] == pytest.approx(by_model[i][t], abs=1e-9)
    right = np.mean([(by_batch[i]["mortality_risk"] > .5) == bool(flag[i]) for i in range(300)])
    assert right > 0.9


def test_scoring_of_missing_features_and_without_models(spark):
    x = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 1.0)], "patient_id long, a double, b double")
    got = {r["patient_id"]: r["length_of_stay"] for r in ba.score_batches(x, ["a", "b"], {"length_of_stay": ([1.0, 3.0], 0.5)}).collect()}
    assert got == {1: 6.5, 2: 3.5}
    assert ba.score_batches(x, ["a"], {}).first()["icu_admission"] is None
    assert ba.score_batches(x.limit(0), ["a", "b"], {"length_of_stay": ([1.0, 3.0], 0.5)}).count() == 0


def test_inferred_types_are_those_of_the_reader(spark, tmp_path):
    text = "i,f,n,b,bn,t,none\n1,1.5,1,True,True,x,\n2,2,,False,,1,\n"
    (tmp_path / "x.csv").write_text(text)
    import pandas as pd
    want = {c: str(t).replace("str", "object") for c, t in pd.read_csv(tmp_path / "x.csv").dtypes.items()}
    from cadence.sources.tables import load_csv_table
    df = load_csv_table(spark, str(tmp_path / "x.csv"), "x")
    got = {r["column_name"]: r["inferred_type"] for r in dtype_profile({"x": df}).collect()}
    assert got == want
