"""Hand-computed fixtures and brute-force properties for the hourly grid."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadence.functions.vocab import TIMELINE_MEDICATIONS, TIMELINE_PROCEDURES, TIMELINE_VITALS, Vocab
from cadence.operators import timeline as tl

from conftest import T0, h, make_roles


def _anchors(spark, pid="p1", t0=T0):
    return spark.createDataFrame([(pid, t0)], "patient_id string, t0 timestamp_ntz")


def _hours_of(df):
    return sorted(r["hour_idx"] for r in df.collect())


def test_proximity_edges(spark):
    # Window [t - 1h, t + 1h) around each grid hour
    cases = {h(0): [0, 1], h(0, 59, 59): [0, 1], h(1): [1, 2], h(719, 30): [719],
             h(0, -30): [0], h(-2): []}
    for ts, expected in cases.items():
        pts = spark.createDataFrame([("p1", ts)], "patient_id string, ts timestamp_ntz")
        assert _hours_of(tl.bin_points(pts, _anchors(spark))) == expected, ts


def test_interval_stabbing(spark):
    # Active iff start <= t < stop (open stop: to the end of the grid)
    cases = [((h(-5), h(2)), (0, 1)), ((h(1), None), (1, 719)), ((h(3), h(3)), None),
             ((h(0, 30), h(2)), (1, 1)), ((h(800), None), None)]
    for (start, stop), expected in cases:
        iv = spark.createDataFrame([("p1", start, stop)], "patient_id string, start timestamp_ntz, stop timestamp_ntz")
        rows = tl.active_bounds(iv, _anchors(spark)).collect()
        got = (rows[0]["lo"], rows[0]["hi"]) if rows else None
        assert got == expected, (start, stop)


def test_vital_ordering_and_coercion(spark):
    # A1: temperature 37, pulse 80 and pulse "n/a" in one hour -> per type 37, 80; collapsed 80
    roles = make_roles(spark, observations=[
        ("p1", h(5, 10), "Body temperature", "37"), ("p1", h(5, 20), "Heart rate (pulse)", "80"),
        ("p1", h(5, 30), "Pulse", "n/a"), ("p1", h(0), "Weight", "70")])
    anchors = tl.anchors_of(tl.timeline_extent(roles))
    wide = tl.hourly_values_wide(roles.observations, anchors, TIMELINE_VITALS, False)
    row = wide.where(F.col("hour_idx") == 5).collect()[0]
    assert row["temperature"] == 37.0 and row["heart_rate"] == 80.0 and row["collapsed"] == 80.0


def test_vital_null_rule(spark):
    # only non-numeric vital values -> no sparse value -> 0 after fill
    roles = make_roles(spark, observations=[("p1", h(3), "Temperature", "high"), ("p1", h(0), "x", "1")])
    anchors = tl.anchors_of(tl.timeline_extent(roles))
    wide = tl.hourly_values_wide(roles.observations, anchors, TIMELINE_VITALS, False)
    dense = tl.dense_grid(tl.hourly_collapsed(wide), anchors)
    assert dense.where(F.col("hour_idx").isin(2, 3)).agg(F.sum("value")).first()[0] == 0.0


def test_first_keyword_with_data_wins(spark):
    # within a type, the first keyword that has numeric data is used
    voc = Vocab.of("v", [("t", ["alpha", "beta"])])
    roles = make_roles(spark, observations=[
        ("p1", h(2), "alpha", "bad"), ("p1", h(2, 5), "beta", "4"), ("p1", h(2, 6), "alpha beta", "8")])
    anchors = tl.anchors_of(tl.timeline_extent(roles))
    row = tl.hourly_values_wide(roles.observations, anchors, voc, False).where(F.col("hour_idx") == 0).first()
    assert row["t"] == 8.0  # 'alpha' has one numeric value (8); 'beta' would give 6


def _brute_active(ivals, t0, vocab, n=720):
    out = {}
    for k in range(n):
        t = t0 + dt.timedelta(hours=k)
        active = [d for s, e, d in ivals if s <= t and (e is None or e > t)]
        c = sum(1 for _, kws in vocab.types if any(any(kw in d.lower() for kw in kws) for d in active))
        if c:
            out[k] = float(c)
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 760), st.one_of(st.none(), st.integers(0, 200)),
                          st.sampled_from(["Remdesivir 100mg", "dexamethasone", "aspirin", "Remdesivir"])),
                min_size=1, max_size=8))
def test_active_counts_match_brute_force(spark, ivs):
    ivals = [(T0 + dt.timedelta(minutes=30 * a), None if d is None else T0 + dt.timedelta(minutes=30 * a + 30 * d), s)
             for a, d, s in ivs]
    iv = spark.createDataFrame([("p1", s, e, d) for s, e, d in ivals],
                               "patient_id string, start timestamp_ntz, stop timestamp_ntz, description string")
    got = {r["hour_idx"]: r["value"] for r in
           tl.hourly_active_counts(iv, _anchors(spark), TIMELINE_MEDICATIONS).collect()}
    assert got == _brute_active(ivals, T0, TIMELINE_MEDICATIONS)


def test_procedure_type_counts(spark):
    pts = spark.createDataFrame([("p1", h(10, 10), "Intubation"), ("p1", h(10, 40), "Mechanical ventilation"),
                                 ("p1", h(11, 5), "ECMO start")], "patient_id string, ts timestamp_ntz, description string")
    got = {r["hour_idx"]: r["value"] for r in tl.hourly_type_counts(pts, _anchors(spark), TIMELINE_PROCEDURES).collect()}
    # ventilation matches 'ventilation' (type ventilation) -> hour 10: intubation+ventilation; 11: all three; 12: ecmo
    assert got == {10: 2.0, 11: 3.0, 12: 1.0}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 719), st.floats(-50, 50, allow_nan=False)), min_size=1, max_size=40,
                unique_by=lambda x: x[0]))
def test_sparse_stats_equal_dense(spark, cells):
    sparse = spark.createDataFrame([("p1", k, v) for k, v in cells], "patient_id string, hour_idx int, value double")
    row = tl.channel_stats(sparse, _anchors(spark)).first()
    dense = np.zeros(720)
    for k, v in cells:
        dense[k] = v
    assert abs(row["mean"] - dense.mean()) < 1e-9
    assert abs(row["std"] - dense.std()) < 1e-6
    assert abs(row["max"] - dense.max()) < 1e-12
    assert abs(row["trend"] - np.polyfit(np.arange(720), dense, 1)[0]) < 1e-9


def test_segments_equal_hourly(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(30):
        s = T0 + dt.timedelta(minutes=rnd.randint(-100, 50000))
        e = None if rnd.random() < 0.3 else s + dt.timedelta(minutes=rnd.randint(0, 3000))
        rows.append((f"p{i % 3}", s, e, rnd.choice(["remdesivir", "Dexamethasone iv", "baricitinib"])))
    iv = spark.createDataFrame(rows, "patient_id string, start timestamp_ntz, stop timestamp_ntz, description string")
    anchors = spark.createDataFrame([(f"p{i}", T0) for i in range(3)], "patient_id string, t0 timestamp_ntz")
    seg = tl.active_segments_multi(iv, anchors, {"m": TIMELINE_MEDICATIONS})
    hourly = tl.expand_segments(seg).drop("channel")
    a = tl.channel_stats(seg.drop("channel"), anchors).orderBy("patient_id").collect()
    b = tl.channel_stats(hourly, anchors).orderBy("patient_id").collect()
    for x, y in zip(a, b):
        for c in ("mean", "std", "max", "trend"):
            assert abs(x[c] - y[c]) < 1e-9


def test_extent_ignores_conditions_and_nulls(spark):
    roles = make_roles(spark, observations=[("p1", h(2), "x", "1"), ("p1", None, "x", "2")],
                       conditions=[("p1", h(-50), "early condition")],
                       medications=[("p1", h(1), h(900), "drug")])
    row = tl.timeline_extent(roles).first()
    assert row["timeline_start"] == h(1)
    assert row["timeline_end"] == h(721)  # least(t0 + 720h, max)
    assert row["n_timestamps"] == 3


def test_patient_without_channel_values_gets_zero_stats(spark):
    anchors = spark.createDataFrame([("p1", T0), ("p2", T0)], "patient_id string, t0 timestamp_ntz")
    sparse = spark.createDataFrame([("p1", 3, 2.0)], "patient_id string, hour_idx int, value double")
    rows = {r["patient_id"]: r for r in tl.channel_stats(sparse, anchors).collect()}
    assert (rows["p2"]["mean"], rows["p2"]["std"], rows["p2"]["max"], rows["p2"]["trend"]) == (0.0, 0.0, 0.0, 0.0)
    assert rows["p1"]["max"] == 2.0


def test_null_text_value_and_stop(spark):
    roles = make_roles(spark, observations=[("p1", h(0), None, "5"), ("p1", h(0, 10), "Temperature", None),
                                            ("p1", h(0, 20), "Temperature", "NaN"), ("p1", h(0, 30), "temp", " 36.5 ")],
                       medications=[("p1", h(2), None, None), ("p1", h(3), None, "Remdesivir")])
    anchors = tl.anchors_of(tl.timeline_extent(roles))
    wide = tl.hourly_values_wide(roles.observations, anchors, TIMELINE_VITALS, False)
    assert {r["hour_idx"]: r["temperature"] for r in wide.collect()} == {0: 36.5, 1: 36.5}
    act = {r["hour_idx"]: r["value"] for r in tl.hourly_active_counts(roles.medications, anchors,
                                                                      TIMELINE_MEDICATIONS).collect()}
    assert min(act) == 3 and max(act) == 719 and set(act.values()) == {1.0}


def test_patterns_are_evaluated_once_per_distinct_text(spark, monkeypatch):
    """The dictionary of texts gives the same rows as patterns on every row, and only it holds patterns."""
    voc = Vocab.of("v", [("heart", ["heart rate", "pulse"]), ("heat", ["temperature"])])
    texts = ["Heart rate", "PULSE oximetry", "Body temperature", "pulse and temperature", "other", None, ""]
    obs = [(f"p{i % 3}", h(minutes=i * 13), texts[i % 7], str(i)) for i in range(200)]
    ivl = [(f"p{i % 3}", h(hours=i % 9), h(hours=i % 9 + 2), texts[i % 7]) for i in range(60)]
    roles = make_roles(spark, observations=obs, medications=ivl, procedures=[(p, t, d) for p, t, d, _ in obs])
    anchors = spark.createDataFrame([(f"p{i}", T0) for i in range(3)], "patient_id string, t0 timestamp_ntz")

    def run():
        frames = (tl.hourly_values_wide(roles.observations, anchors, voc, False), tl.active_segments_multi(roles.medications, anchors, {"c": voc}),
                  tl.hourly_type_counts(roles.procedures, anchors, voc))
        return frames, [sorted(map(tuple, f.collect())) for f in frames]
    frames, by_text = run()
    heart = "heart rate"
    for f in frames:
        plan = f._jdf.queryExecution().optimizedPlan().toString()
        assert "rightHint=(strategy=broadcast)" in plan and heart not in plan  # no pattern is left for the rows
    monkeypatch.setattr(tl, "MAX_TEXTS", 0)
    frames, by_row = run()
    assert by_row == by_text and all(by_text)
    assert all(heart in f._jdf.queryExecution().optimizedPlan().toString() for f in frames)
