from __future__ import annotations

import datetime as dt

from cadence.functions.vocab import COMORBIDITIES
from cadence.operators import cohort as co
from cadence.operators import features as fe
from cadence.operators import targets as tg
from cadence.operators import timeline as tl

from conftest import h, make_roles


def test_label_encoding_unknowns(spark):
    # null gender -> Unknown (2); unseen race 'martian' -> Unknown (0)
    roles = make_roles(spark, patients=[("p1", dt.date(1950, 1, 1), None, None, "martian", "hispanic"),
                                        ("p2", None, None, "M", "white", "nonhispanic")])
    rows = {r["patient_id"]: r for r in fe.demographics(roles.patients, dt.date(2025, 1, 1)).collect()}
    assert rows["p1"]["gender"] == 2.0 and rows["p1"]["race"] == 0.0 and rows["p1"]["ethnicity"] == 1.0
    assert rows["p2"]["gender"] == 1.0 and rows["p2"]["race"] == 5.0 and rows["p2"]["ethnicity"] == 2.0
    assert rows["p2"]["age"] == 0.0
    assert abs(rows["p1"]["age"] - (dt.date(2025, 1, 1) - dt.date(1950, 1, 1)).days / 365.25) < 1e-12
    issues = {(r["patient_id"], r["attribute"]) for r in fe.encoding_issues(roles.patients).collect()}
    assert issues == {("p1", "gender"), ("p1", "race")}


def test_static_features_and_derived(spark):
    roles = make_roles(
        spark,
        patients=[("p1", dt.date(1950, 6, 1), None, "F", "asian", None), ("p2", dt.date(2010, 1, 1), None, "M", None, None)],
        conditions=[("p1", h(0), "Diabetes mellitus type 2"), ("p1", h(1), "Body mass index 30+ - obesity"),
                    ("p1", h(2), "BMI 300"), ("p2", h(0), "Chronic obstructive bronchitis")])
    rows = {r["patient_id"]: r for r in fe.static_features(roles.patients, roles.conditions, COMORBIDITIES,
                                                           dt.date(2025, 1, 1)).collect()}
    p1, p2 = rows["p1"], rows["p2"]
    assert (p1["diabetes"], p1["obesity"], p1["hypertension"]) == (1.0, 1.0, 0.0)
    assert p1["comorbidity_count"] == 2.0 and p1["high_comorbidity"] == 1.0
    assert p1["age_risk"] == 1.0 and p1["age_group"] == 3.0
    assert p2["copd"] == 1.0 and p2["age_group"] == 0.0 and p2["age_risk"] == 0.0
    assert p1["healthcare_coverage"] == 1.0 and p1["income_level"] == 0.5


def test_age_boundaries(spark):
    df = spark.createDataFrame([(17.99,), (18.0,), (64.99,), (65.0,), (65.01,)], "age double")
    got = [(r[0], r[1]) for r in df.select(fe.age_group(df.age), (df.age > 65).cast("double")).collect()]
    assert got == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (3.0, 1.0)]


def test_mortality_listed_vs_distinct(spark):
    # One severe condition well inside the grid is listed in two hours
    roles = make_roles(spark, observations=[("p1", h(0), "x", "1")],
                       conditions=[("p1", h(100, 30), "Severe pneumonia")],
                       procedures=[("p1", h(719, 30), "Intubation")])
    t = tg.targets(roles.conditions, roles.encounters, roles.procedures, tl.timeline_extent(roles)).first()
    # listed: 2 * 0.3 (condition) + 1 * 0.4 (procedure in the last hour only) = 1.0 (cap)
    assert abs(t["mortality_risk"] - 1.0) < 1e-12
    assert abs(t["mortality_risk_distinct"] - 0.7) < 1e-12
    assert t["icu_admission"] == 1.0 and t["ventilator_need"] == 0.0
    assert t["length_of_stay"] == 719.0


def test_mortality_single_condition(spark):
    roles = make_roles(spark, observations=[("p1", h(0), "x", "1")], conditions=[("p1", h(50, 10), "critical state")])
    t = tg.targets(roles.conditions, roles.encounters, roles.procedures, tl.timeline_extent(roles)).first()
    assert abs(t["mortality_risk"] - 0.6) < 1e-12 and abs(t["mortality_risk_distinct"] - 0.3) < 1e-12


def test_label_flags(spark):
    roles = make_roles(spark, patients=[("p1", None, dt.date(2024, 1, 1), None, None, None),
                                        ("p2", None, None, None, None, None)],
                       encounters=[("p2", h(0), None, "ICU admission")],
                       devices=[("p1", h(0), None, "Mechanical ventilator")])
    rows = {r["patient_id"]: r for r in tg.label_flags(roles.patients, roles.encounters, roles.procedures,
                                                       roles.devices).collect()}
    assert (rows["p1"]["mortality"], rows["p1"]["icu"], rows["p1"]["ventilator"]) == (1, 0, 1)
    assert (rows["p2"]["mortality"], rows["p2"]["icu"], rows["p2"]["ventilator"]) == (0, 1, 0)


def test_cohort_and_sample(spark):
    roles = make_roles(spark, observations=[("a", h(0), "SARS-CoV-2 RNA", "pos"), ("b", h(0), "Respiratory rate", "12"),
                                            ("c", h(0), None, "1")],
                       conditions=[("d", h(0), "Viral pneumonia"), ("e", h(0), "Sprain")])
    ids = co.cohort_ids([roles.conditions, roles.observations])
    assert sorted(r[0] for r in ids.collect()) == ["a", "b", "d"]
    assert [r[0] for r in co.cohort_sample(ids, 1, 1).collect()] == ["b"]
    assert co.restrict(roles.observations, ids).count() == 2


def test_scaler_fit_on_train(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 100.0)], "patient_id string, age double")
    train = df.where(df.patient_id != "c")
    params = fe.scaler_params(fe.fit_standard_scaler(train, ["age"]), ["age"])
    assert params == {"age": (2.0, 1.0)}
    out = {r[0]: r[1] for r in fe.apply_standard_scaler(df, params).collect()}
    assert out == {"a": -1.0, "b": 1.0, "c": 98.0}


def test_temporal_split_dropped_and_metadata(spark):
    from cadence.operators import splits as sp
    roles = make_roles(spark, patients=[("p1", dt.date(1990, 1, 1), None, "F", "white", "hispanic"),
                                        ("p2", None, None, None, None, None)],
                       observations=[("p1", h(0), "x", "1"), ("p2", None, "x", "1")])
    assert [r[0] for r in sp.temporal_split_dropped(roles.patients, roles.observations).collect()] == ["p2"]
    assert fe.patient_metadata(roles.patients).columns == ["patient_id", "birthdate", "gender", "race", "ethnicity"]


def test_batch_scoring_with_pluggable_model(spark):
    import pandas as pd
    from cadence.operators import export as ex

    def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
        s = (pdf["age"] / 100.0).clip(0, 1)
        return pd.DataFrame({"mortality_risk": s, "icu_admission": s / 2, "ventilator_need": s / 4,
                             "length_of_stay": pdf["age"] * 0 + 24.0})
    df = spark.createDataFrame([("a", 50.0), ("b", 80.0)], "patient_id string, age double")
    out = {r["patient_id"]: r for r in ex.score(df, scorer, ["age"]).collect()}
    assert out["a"]["mortality_risk"] == 0.5 and out["b"]["ventilator_need"] == 0.2
    plan = ex.score(df, scorer, ["age"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan or "PythonMapInArrow" in plan


def test_evaluation_report_and_join(spark, tmp_path):
    from cadence.operators import metrics as me
    from cadence.sources import sinks
    p = spark.createDataFrame([(1, "mortality_risk", 0.9), (2, "mortality_risk", 0.2), (3, "length_of_stay", 30.0)],
                              "patient_id long, task string, prediction double")
    t = spark.createDataFrame([(1, "mortality_risk", 1.0), (2, "mortality_risk", 0.0), (3, "length_of_stay", 24.0),
                               (4, "icu_admission", 1.0)], "patient_id long, task string, target double")
    j = me.attach_targets(p, t)
    assert j.count() == 3
    rep = me.evaluation_report(j)
    assert rep["binary_metrics"].first()["auroc"] == 1.0
    paths = sinks.write_report(rep, str(tmp_path / "eval"))
    assert spark.read.json(paths["regression_metrics"]).first()["mae"] == 6.0
