"""Registered queries: each takes ``(spark, sf_dir)`` and returns a lazy
DataFrame over the driver tables (bound onto clinical roles, see
``cadence.sources.bindings``). Floating outputs are rounded to 6 places so
they compare exactly with the DuckDB oracle."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hours_6dp, micros_between, round6
from ..functions.vocab import STATIC_FEATURES, TIMELINE_LABS
from ..operators import cohort as co
from ..operators import export as ex
from ..operators import features as fe
from ..operators import metrics as me
from ..operators import quality as qa
from ..operators import sequences as sq
from ..operators import splits as sp
from ..operators import targets as tg
from ..operators import timeline as tl
from ..operators.ranking import checkpointed
from ..session import ensure_utc
from ..sources import bindings as bd
from ..sources.tables import DRIVER_TABLES, parse_ts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, round6(c))
    return df


# ---------------------------------------------------------------------------
# Timeline (events binding)
# ---------------------------------------------------------------------------

def _event_timeline(spark, sf_dir, with_intervals=True):
    """Roles of the events binding and the checkpointed one-row-per-patient
    extent (shared by every branch of the query)."""
    roles = bd.event_roles(spark, sf_dir, with_intervals)
    extent = checkpointed(tl.timeline_extent(roles))
    return roles, extent, tl.anchors_of(extent)


def event_channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The five hourly category channels of the events binding as one frame of
    run-length segments ``(channel, patient_id, h_start, h_end, value)``
    (point channels: one-hour segments), plus the anchors.

    The one-row-per-patient extent is checkpointed once and shared; vitals and
    labs come from one aggregation of the observations, medications and
    devices from one pass over the intervals."""
    roles = bd.event_roles(spark, sf_dir)
    extent = checkpointed(tl.timeline_extent(roles))
    anchors = tl.anchors_of(extent)
    valued = tl.hourly_values_multi(roles.observations, anchors,
                                    {"vital_signs": bd.EVENT_VITALS, "laboratory_values": TIMELINE_LABS}, True)
    parts = [tl.point_segments(valued.select(F.lit(c).alias("channel"), "patient_id", "hour_idx",
                                             F.col(c).alias("value")).where(F.col("value").isNotNull()))
             for c in ("vital_signs", "laboratory_values")]
    if roles.medications is roles.devices:
        parts.append(tl.active_segments_multi(
            roles.medications, anchors, {"medications": bd.EVENT_MEDICATIONS, "devices": bd.EVENT_DEVICES}))
    else:
        for c, frame, voc in (("medications", roles.medications, bd.EVENT_MEDICATIONS),
                              ("devices", roles.devices, bd.EVENT_DEVICES)):
            parts.append(tl.active_segments_multi(frame, anchors, {c: voc}))
    parts.append(tl.point_segments(tl.hourly_type_counts(roles.procedures, anchors, bd.EVENT_PROCEDURES)
                                   .select(F.lit("procedures").alias("channel"), "*")))
    sparse = parts[0]
    for p_ in parts[1:]:
        sparse = sparse.unionByName(p_)
    return sparse, anchors, list(CHANNELS)


CHANNELS = ("vital_signs", "laboratory_values", "medications", "procedures", "devices")


@query("channel_stats")
def channel_stats(spark, sf_dir):
    """Flagship: full hourly timeline (5 categories) -> per-patient mean,
    population std, max and slope over the zero-filled 720-hour grid."""
    sparse, anchors, channels = event_channels(spark, sf_dir)
    out = tl.channel_stats(sparse, anchors, channels=channels)
    return _r(out.select("patient_id", "channel", "mean", "std", "max", "trend"), "mean", "std", "max", "trend")


@query("timeline_extent")
def timeline_extent(spark, sf_dir):
    _, extent, _ = _event_timeline(spark, sf_dir)
    return extent.withColumn("observed_hours", hours_6dp(micros_between("timeline_start", "timeline_end")))


@query("hourly_vitals_by_type")
def hourly_vitals_by_type(spark, sf_dir):
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    wide = tl.hourly_values_wide(roles.observations, anchors, bd.EVENT_VITALS, True)
    return _r(tl.hourly_values_long(wide, bd.EVENT_VITALS).drop("type_ord"), "value")


@query("hourly_vitals_collapsed")
def hourly_vitals_collapsed(spark, sf_dir):
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    wide = tl.hourly_values_wide(roles.observations, anchors, bd.EVENT_VITALS, True)
    return _r(tl.hourly_collapsed(wide), "value")


@query("hourly_labs_collapsed")
def hourly_labs_collapsed(spark, sf_dir):
    """Labs with the reference's own (compat) lab vocabulary: the one-letter
    keyword 'k' matches 'click', so clicks surface as potassium."""
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    wide = tl.hourly_values_wide(roles.observations, anchors, TIMELINE_LABS, True)
    return _r(tl.hourly_collapsed(wide), "value")


@query("hourly_procedures")
def hourly_procedures(spark, sf_dir):
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    return tl.hourly_type_counts(roles.procedures, anchors, bd.EVENT_PROCEDURES)


@query("hourly_active_meds")
def hourly_active_meds(spark, sf_dir):
    roles, _, anchors = _event_timeline(spark, sf_dir)
    return tl.hourly_active_counts(roles.medications, anchors, bd.EVENT_MEDICATIONS)


@query("hourly_active_devices")
def hourly_active_devices(spark, sf_dir):
    roles, _, anchors = _event_timeline(spark, sf_dir)
    return tl.hourly_active_counts(roles.devices, anchors, bd.EVENT_DEVICES)


@query("hourly_event_counts")
def hourly_event_counts(spark, sf_dir):
    """A6 in long form, summarised per (patient, hour, kind): number of listed
    events and the earliest listed timestamp."""
    roles, _, anchors = _event_timeline(spark, sf_dir)
    ev = tl.hourly_events(_listed_kinds(roles), anchors)
    return ev.groupBy("patient_id", "hour_idx", "kind").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"))


def _listed_kinds(roles):
    return {
        "conditions": roles.conditions.select("patient_id", "ts", "description"),
        "encounters": roles.encounters.select("patient_id", F.col("start").alias("ts"), "description"),
        "medications": roles.medications.select("patient_id", F.col("start").alias("ts"), "description"),
        "procedures": roles.procedures.select("patient_id", "ts", "description"),
    }


@query("hourly_event_lists")
def hourly_event_lists(spark, sf_dir):
    """Every listed event of every hour."""
    roles, _, anchors = _event_timeline(spark, sf_dir)
    return tl.hourly_events(_listed_kinds(roles), anchors).select(
        "patient_id", "hour_idx", "kind", "ts", F.col("record.description").alias("description"))


@query("event_time_records")
def event_time_records(spark, sf_dir):
    """The records of all five kinds at each distinct timestamp."""
    roles = bd.event_roles(spark, sf_dir)
    kinds = {"observations": roles.observations.select("patient_id", "ts", "description"), **_listed_kinds(roles)}
    return sq.event_time_records(kinds)


@query("hourly_vitals_text")
def hourly_vitals_text(spark, sf_dir):
    """A1 with P3: values arrive as text, some padded, some no number."""
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    ev = bd.read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    form = F.col("event_id") % 5
    text = F.when(form == 0, "n/a").when(form == 1, F.concat(F.lit(" "), F.col("value"))).otherwise(F.col("value").cast("string"))
    obs = ev.select(F.col("user_id").alias("patient_id"), "ts", F.col("event_type").alias("description"), text.alias("value"))
    return _r(tl.hourly_collapsed(tl.hourly_values_wide(obs, anchors, bd.EVENT_VITALS, False)), "value")


@query("derived_features")
def derived_features(spark, sf_dir):
    """the derived static values (F2-F4) with the channel statistics (A10)."""
    sparse, anchors, channels = event_channels(spark, sf_dir)
    stats = _r(tl.channel_stats(sparse, anchors, channels=channels)
               .select("patient_id", "channel", "mean", "std", "max", "trend"), "mean", "std", "max", "trend")
    return derived_static(spark, sf_dir).join(stats, "patient_id")


def place_weight(place):
    """A weight of a cell's place, for digests: sums of weight x value don't depend on the order of rows."""
    return (place.cast("long") * 7919 + 13) % 10007


def whole(value, scale: int):
    return F.round(value.cast("double") * scale).cast("long")


@query("dense_grid_zero_fill")
def dense_grid_zero_fill(spark, sf_dir):
    """The whole zero-filled grid, one row per patient and hour."""
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    wide = tl.hourly_values_wide(roles.observations, anchors, bd.EVENT_VITALS, True)
    return _r(tl.dense_grid(tl.hourly_collapsed(wide), anchors), "value")


@query("relative_time")
def relative_time(spark, sf_dir):
    """Hours since each patient's first timestamp, per observation."""
    _, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    ev = bd.read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]).withColumnRenamed("user_id", "patient_id")
    rel = tl.relative_hours(ev, anchors)
    return rel.select("event_id", "patient_id", hours_6dp(micros_between("t0", "ts")).alias("rel_hours"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


# ---------------------------------------------------------------------------
# Cohort (events + orders), static features (customer/orders binding)
# ---------------------------------------------------------------------------


def _cohort(spark, sf_dir):
    ev = bd.read_table(spark, sf_dir, "events", ["user_id", "event_type"]).select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("description"))
    od = bd.read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"]).select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("description"))
    return co.cohort_ids([(ev, bd.EVENT_COHORT_KEYWORDS), (od, bd.ORDER_COHORT_KEYWORDS)])


@query("cohort_keyword")
def cohort_keyword(spark, sf_dir):
    """P1 + U1: ids with a matching event type or order priority."""
    return _cohort(spark, sf_dir)


@query("cohort_tables_semijoin")
def cohort_tables_semijoin(spark, sf_dir):
    """The events of cohort members (left-semi join)."""
    ev = bd.read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type", "value"]) \
        .withColumnRenamed("user_id", "patient_id")
    return co.restrict(ev, _cohort(spark, sf_dir))


@query("cohort_sample")
def cohort_sample(spark, sf_dir):
    """The deterministic [10, 60) slice of the cohort in id order (the
    slice is the feature: a sampling operator)."""
    return co.cohort_sample(_cohort(spark, sf_dir), start=10, size=50)


@query("static_demographics")
def static_demographics(spark, sf_dir):
    """F1 + F5: age at 2025-01-01 and label codes."""
    return _r(fe.demographics(bd.customer_patients(spark, sf_dir)), "age")


@query("comorbidity_flags")
def comorbidity_flags(spark, sf_dir):
    roles = bd.order_roles(spark, sf_dir)
    return fe.comorbidity_flags(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES)


@query("static_features")
def static_features(spark, sf_dir):
    """F18 + F17 (+ F2-F4, F6): the 15 named static features."""
    roles = bd.order_roles(spark, sf_dir)
    return _r(fe.static_features(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES), "age")


@query("derived_static")
def derived_static(spark, sf_dir):
    roles = bd.order_roles(spark, sf_dir)
    st = fe.static_features(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES)
    return st.select("patient_id", "age_risk", "age_group", "comorbidity_count", "high_comorbidity")


@query("targets")
def targets(spark, sf_dir):
    """A12-A16 over the events timeline."""
    roles, extent, _ = _event_timeline(spark, sf_dir)
    t = tg.targets(roles.conditions, roles.encounters, roles.procedures, extent, bd.EVENT_TARGETS)
    los = extent.select("patient_id", hours_6dp(micros_between("timeline_start", "timeline_end"))
                        .alias("los_observed_hours"))
    return _r(t.drop("los_observed_hours").join(los, "patient_id"), "mortality_risk", "mortality_risk_distinct")


@query("label_flags")
def label_flags(spark, sf_dir):
    """A11 split labels for every customer: death date, ICU / ventilator text."""
    return _label_flags(spark, sf_dir)


def _label_flags(spark, sf_dir):
    """The flags read device text only, so events stand in for the intervals."""
    roles = bd.event_roles(spark, sf_dir, with_intervals=False)
    return tg.label_flags(roles.patients, roles.encounters, roles.procedures,
                          roles.observations.select("patient_id", "description"),
                          bd.EVENT_SPLIT_FLAGS["icu"], bd.EVENT_SPLIT_FLAGS["ventilator"])


@query("event_time_timeline")
def event_time_timeline(spark, sf_dir):
    """A8 + O2: per customer, sorted distinct order / ship timestamps."""
    o = bd.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    li = bd.read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    enc = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("ts"))
    proc = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("patient_id"),
                                                              F.col("l_shipdate").alias("ts"))
    return sq.event_time_timeline({"encounters": enc, "procedures": proc})


@query("padded_sequences")
def padded_sequences(spark, sf_dir):
    """F10 + O5 + F13: the 12 most recent order totals per customer, zero-padded."""
    o = bd.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).select(
        F.col("o_custkey").alias("patient_id"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("value"))
    pts = bd.read_table(spark, sf_dir, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "patient_id")
    return _r(sq.tail_sequences(o, pts, 12, ["o_orderdate", "o_orderkey"]), "value")


# ---------------------------------------------------------------------------
# Quality (customer/orders binding)
# ---------------------------------------------------------------------------


AS_OF = _dt.datetime(1999, 1, 1)


def _quality_tables(spark, sf_dir):
    roles = bd.order_roles(spark, sf_dir)
    return roles, {"patients": roles.patients, "observations": roles.observations, "conditions": roles.conditions}


@query("missing_profile")
def missing_profile(spark, sf_dir):
    """Q9: null count per column of the bound patient / observation tables."""
    _, tabs = _quality_tables(spark, sf_dir)
    return qa.null_profile(tabs)


@query("missing_by_entity")
def missing_by_entity(spark, sf_dir):
    """Q1 + Q6 + P8 per customer."""
    roles, tabs = _quality_tables(spark, sf_dir)
    return _r(qa.missing_by_patient(tabs, roles.patients), "missing_share", "completeness")


@query("iqr_outliers")
def iqr_outliers(spark, sf_dir):
    """Q2: IQR outliers of every numeric line-item column, per supplier."""
    li = bd.read_table(spark, sf_dir, "lineitem")
    return _r(qa.iqr_outliers(qa.unpivot_numeric(li, "l_suppkey"), ["patient_id", "column_name"]), "q1", "q3")


@query("temporal_consistency")
def temporal_consistency(spark, sf_dir):
    """Q3 + P9 with a fixed reference date (1999-01-01)."""
    roles = bd.order_roles(spark, sf_dir)
    return _r(qa.temporal_consistency(roles.observations, roles.patients, AS_OF), "consistency_score")


@query("temporal_coverage")
def temporal_coverage(spark, sf_dir):
    roles = bd.order_roles(spark, sf_dir)
    return _r(qa.temporal_coverage(roles.observations, roles.patients), "temporal_coverage")


def _per_patient_quality(spark, sf_dir, reject_limit=qa.REJECT_LIMIT):
    """Orders as encounters, their lines as medications."""
    roles, tabs = _quality_tables(spark, sf_dir)
    miss = qa.missing_by_patient(tabs, roles.patients, reject_limit=reject_limit)
    cov = qa.temporal_coverage(roles.observations, roles.patients)
    n_obs = roles.observations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_obs"))
    o = bd.read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    lines = bd.read_table(spark, sf_dir, "lineitem", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_l"))
    visits = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy(F.col("o_custkey").alias("patient_id")).agg(
        F.count(F.lit(1)).alias("n_enc"), F.sum(F.coalesce("_l", F.lit(0))).alias("n_med"))
    x = miss.join(cov, "patient_id").join(n_obs, "patient_id", "left").join(visits, "patient_id", "left")
    return x.select("patient_id", "is_valid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_obs", "n_enc", "n_med")],
                    "completeness", "temporal_coverage")


@query("quality_summary")
def quality_summary(spark, sf_dir):
    """Q5: cohort-level quality row."""
    s = qa.quality_summary(_per_patient_quality(spark, sf_dir))
    return _r(s, "avg_observations_per_patient", "avg_encounters_per_patient", "avg_medications_per_patient",
              "data_completeness", "temporal_coverage")


@query("recommendations")
def recommendations(spark, sf_dir):
    """Q8 over every customer, with thresholds that the whole tables cross, so
    each of the four rules speaks."""
    s = qa.quality_summary(_per_patient_quality(spark, sf_dir, reject_limit=0.02))
    return qa.recommendations(s, min_patients=100_000_000, min_completeness=0.999, min_coverage=1.01)


@query("missing_by_table")
def missing_by_table(spark, sf_dir):
    """Q1 per table."""
    return qa.missing_by_table(_quality_tables(spark, sf_dir)[1])


@query("dtype_profile")
def dtype_profile(spark, sf_dir):
    """Q10 over all tables."""
    return qa.dtype_profile({n: bd.read_table(spark, sf_dir, n) for n in DRIVER_TABLES})


@query("patient_issues")
def patient_issues(spark, sf_dir):
    """Q4: long issue list per customer (orders as observations)."""
    roles, tabs = _quality_tables(spark, sf_dir)
    roles = roles.with_(patients=checkpointed(roles.patients))  # read by every part
    tabs["patients"] = roles.patients
    miss = qa.missing_by_patient(tabs, roles.patients)
    cons = qa.temporal_consistency(roles.observations, roles.patients, AS_OF)
    n_obs = roles.patients.select("patient_id").join(
        roles.observations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_obs")), "patient_id", "left") \
        .select("patient_id", F.coalesce("n_obs", F.lit(0)).alias("n_obs"))
    cons = cons.join(n_obs.withColumnRenamed("n_obs", "n_obs_rows"), "patient_id")
    outl = qa.outliers_by_patient(tabs)
    seen = roles.observations.select("patient_id").unionByName(roles.conditions.select("patient_id"))
    return qa.patient_issues(miss, cons, outl, n_obs, roles.patients, seen)


@query("timestamp_text_forms")
def timestamp_text_forms(spark, sf_dir):
    """P4 + P5: event times written in eight text forms (with and without zone,
    fraction, seconds and time) and parsed back; zones keep the wall clock."""
    ev = bd.read_table(spark, sf_dir, "events", ["event_id", "ts"])
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    full = F.concat(clock, F.date_format("ts", ".SSSSSS"))
    form = (F.col("event_id") % 8).cast("int")
    text = (F.when(form == 0, F.concat_ws("T", day, full))
            .when(form == 1, F.concat(F.concat_ws("T", day, full), F.lit("Z")))
            .when(form == 2, F.concat(F.concat_ws(" ", day, full), F.lit("+02:00")))
            .when(form == 3, F.concat(F.concat_ws(" ", day, full), F.lit("-0530")))
            .when(form == 4, F.concat_ws("T", day, clock)).when(form == 5, F.concat(F.concat_ws("T", day, clock), F.lit("Z")))
            .when(form == 6, F.concat_ws("T", day, F.date_format("ts", "HH:mm"))).otherwise(day))
    return ev.select("event_id", form.alias("form"), parse_ts(text).alias("parsed"))


@query("dataset_coverage")
def dataset_coverage(spark, sf_dir):
    """Q11 over orders-as-encounters."""
    return qa.dataset_coverage(bd.coverage_encounters(spark, sf_dir))


@query("dataset_summary")
def dataset_summary(spark, sf_dir):
    """Q12: rows, columns and patients of every table, and the cohort's size."""
    tabs = {n: bd.read_table(spark, sf_dir, n) for n in DRIVER_TABLES}
    return qa.table_summary(tabs, {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"},
                            _cohort(spark, sf_dir))


@query("feature_catalogue")
def feature_catalogue(spark, sf_dir):
    """The catalogue with, per static feature, its mean over all customers."""
    roles = bd.order_roles(spark, sf_dir)
    st = fe.static_features(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES)
    means = st.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                                         for c in STATIC_FEATURES]))).groupBy("name").agg(F.avg("v").alias("mean"))
    return _r(ex.feature_catalogue(spark).join(means, "name", "left").na.fill(0.0, ["mean"]), "mean")


@query("patient_metadata")
def patient_metadata(spark, sf_dir):
    """F14."""
    return fe.patient_metadata(bd.customer_patients(spark, sf_dir)).withColumn("birthdate", F.col("birthdate").cast("string"))


def _cohort_patients(spark, sf_dir):
    return co.restrict(bd.customer_patients(spark, sf_dir), _cohort(spark, sf_dir))


@query("value_counts")
def value_counts(spark, sf_dir):
    """Q13: gender and race counts of the cohort's patients."""
    return qa.value_counts(_cohort_patients(spark, sf_dir), ["gender", "race"])


@query("date_describe")
def date_describe(spark, sf_dir):
    """Q13: birth date described as text."""
    return qa.text_describe(_cohort_patients(spark, sf_dir), "birthdate")


# ---------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------

@query("temporal_split")
def temporal_split(spark, sf_dir):
    """Customers by first order date (ties by id)."""
    roles = bd.order_roles(spark, sf_dir)
    return sp.temporal_split(roles.observations).drop("first_ts")


@query("split_counts")
def split_counts(spark, sf_dir):
    """W5 + W7 over the temporal split with the A11 label flags."""
    roles = bd.order_roles(spark, sf_dir)
    return sp.split_counts(sp.temporal_split(roles.observations), _label_flags(spark, sf_dir))


@query("stratified_split")
def stratified_split(spark, sf_dir):
    """W2 membership."""
    return sp.stratified_split(_label_flags(spark, sf_dir))


@query("stratified_split_sizes")
def stratified_split_sizes(spark, sf_dir):
    """W2 sizes."""
    return sp.split_counts(sp.stratified_split(_label_flags(spark, sf_dir)))


@query("random_split")
def random_split(spark, sf_dir):
    """W3 membership."""
    return sp.random_split(bd.read_table(spark, sf_dir, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "patient_id"))


@query("undated_patients")
def undated_patients(spark, sf_dir):
    """Customers without a dated event."""
    pts = bd.read_table(spark, sf_dir, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "patient_id")
    ev = bd.read_table(spark, sf_dir, "events", ["user_id", "ts"]).withColumnRenamed("user_id", "patient_id")
    return sp.temporal_split_dropped(pts, ev)


@query("random_split_sizes")
def random_split_sizes(spark, sf_dir):
    """W3 sizes."""
    pts = bd.read_table(spark, sf_dir, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "patient_id")
    return sp.split_counts(sp.random_split(pts))


@query("scaled_static")
def scaled_static(spark, sf_dir):
    """F7 + F9: static features standard-scaled with mean/std fitted on the
    temporal split's train patients only."""
    roles = bd.order_roles(spark, sf_dir)
    st = fe.static_features(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES)
    split = sp.temporal_split(roles.observations)
    train = st.join(split.where(F.col("split") == "train").select("patient_id"), "patient_id", "left_semi")
    params = fe.scaler_params(fe.fit_standard_scaler(train))
    out = fe.apply_standard_scaler(st, params)
    return _r(out, *STATIC_FEATURES)


# ---------------------------------------------------------------------------
# Metrics (labels/documents and lineitem/part predictions)
# ---------------------------------------------------------------------------

def _binary(spark, sf_dir):
    return me.binary_metrics(bd.predictions(spark, sf_dir))


@query("binary_metrics")
def binary_metrics(spark, sf_dir):
    """E1-E5 + E12 + F11 per binary task."""
    b = _binary(spark, sf_dir)
    return _r(b, "precision", "recall", "f1", "specificity", "sensitivity", "positive_predictive_value",
              "negative_predictive_value", "auroc", "auprc")


@query("regression_metrics")
def regression_metrics(spark, sf_dir):
    """E6-E9."""
    return _r(me.regression_metrics(bd.predictions(spark, sf_dir)), "mae", "rmse", "mape", "r2",
              "within_24h", "within_48h")


@query("overall_metrics")
def overall_metrics(spark, sf_dir):
    """E10 + E11."""
    return _r(me.overall_metrics(_binary(spark, sf_dir)), "average_auroc", "auroc_std", "clinical_composite_score")


@query("interpretation")
def interpretation(spark, sf_dir):
    """E14."""
    p = bd.predictions(spark, sf_dir)
    return me.interpretation(checkpointed(me.binary_metrics(p)), me.regression_metrics(p))  # three rows, read twice


@query("metric_summary")
def metric_summary(spark, sf_dir):
    """E13."""
    p = bd.predictions(spark, sf_dir)
    b = checkpointed(me.binary_metrics(p))  # three rows, read twice
    return _r(me.summary_table(b, me.regression_metrics(p), me.overall_metrics(b)), "value")


@query("roc_points")
def roc_points(spark, sf_dir):
    """E15."""
    p = me.sigmoid_if_needed(bd.predictions(spark, sf_dir).where(F.col("task").isin(*me.BINARY_TASKS)))
    return _r(me.roc_points(p), "threshold", "fpr", "tpr")


@query("predictions_with_targets")
def predictions_with_targets(spark, sf_dir):
    """Scores of all documents joined with the targets of the labelled ones."""
    doc = bd.read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    lab = bd.read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    tasks = F.array(F.lit("mortality_risk"), F.lit("icu_admission"))
    p = doc.select(F.col("doc_id").alias("patient_id"), F.explode(tasks).alias("task"),
                   (F.col("n_chars") / 20000.0).alias("prediction"))
    t = lab.select(F.col("doc_id").alias("patient_id"), F.inline(F.array(
        F.struct(F.lit("mortality_risk").alias("task"), F.col("quality").cast("double").alias("target")),
        F.struct(F.lit("icu_admission").alias("task"), F.col("toxic").cast("double").alias("target")))))
    return _r(me.attach_targets(p, t), "prediction")


@query("residual_histogram")
def residual_histogram(spark, sf_dir):
    """E16."""
    return _r(me.residual_histogram(bd.predictions(spark, sf_dir)), "bin_start", "bin_end")


# ---------------------------------------------------------------------------
# Temporal matrix and model-ready export (events binding)
# ---------------------------------------------------------------------------


EVENT_CATEGORIES = (("vital_signs", bd.EVENT_VITALS), ("laboratory_values", TIMELINE_LABS),
                    ("medications", bd.EVENT_MEDICATIONS), ("procedures", bd.EVENT_PROCEDURES),
                    ("devices", bd.EVENT_DEVICES))


@query("temporal_channels")
def temporal_channels(spark, sf_dir):
    """every per-type hourly channel (18 with the events binding) as a
    sparse long frame ``(patient_id, hour_idx, ch, value)``."""
    roles = bd.event_roles(spark, sf_dir)
    anchors = tl.anchors_of(checkpointed(tl.timeline_extent(roles)))
    ch, _ = ex.temporal_channels(roles, anchors, EVENT_CATEGORIES)
    return _r(ch, "value")


def _model_ready(spark, sf_dir):
    """Model-ready rows of the events binding and the fitted channel scaler."""
    roles = bd.event_roles(spark, sf_dir)
    extent = checkpointed(tl.timeline_extent(roles))
    anchors = tl.anchors_of(extent)
    seg, names = ex.temporal_segments(roles, anchors, EVENT_CATEGORIES)
    seg = checkpointed(seg)  # read by the scaler fit and by the dense matrix
    orders = bd.order_roles(spark, sf_dir)
    users = anchors.select("patient_id")
    static = fe.static_features(orders.patients.join(users, "patient_id", "left_semi"), orders.conditions,
                                bd.ORDER_COMORBIDITIES)
    split = checkpointed(sp.temporal_split(roles.observations).drop("first_ts"))
    train = split.where(F.col("split") == "train").select("patient_id")
    sparams = fe.scaler_params(fe.fit_standard_scaler(static.join(train, "patient_id", "left_semi")))
    cparams = ex.fit_channel_scaler(seg, anchors.join(train, "patient_id", "left_semi"), len(names))
    temporal = ex.dense_matrix(seg, anchors, len(names), scaler=cparams)
    targets = tg.targets(roles.conditions, roles.encounters, roles.procedures, extent, bd.EVENT_TARGETS)
    return ex.model_ready(fe.apply_standard_scaler(static, sparams), temporal, targets, split,
                          n_channels=len(names)), cparams


@query("model_ready_export")
def model_ready_export(spark, sf_dir):
    """S9 rows (arrays; ``model_ready_fields`` and ``model_ready_cells`` compare
    their contents): scaled static vector, 720 x 18 scaled temporal matrix, time
    index, sequence length and targets."""
    return _model_ready(spark, sf_dir)[0]


def _places(field: str):
    return F.transform(F.col(field), lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("position"),
                                                           v.cast("double").alias("value")))


@query("model_ready_fields")
def model_ready_fields(spark, sf_dir):
    """S9 exploded: every slot of the static vector and the time index, the
    length and the four targets of every model-ready row."""
    m, _ = _model_ready(spark, sf_dir)
    single = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(0).alias("position"), F.col(c).cast("double").alias("value"))
                       for c in ("sequence_length", *ex.TARGETS)])
    out = m.select("patient_id", "split", F.inline(F.concat(_places("static"), _places("time_index"), single)))
    return out.withColumn("value", F.round("value", 4))


@query("model_ready_cells")
def model_ready_cells(spark, sf_dir):
    """Every temporal matrix, per channel: its shape, how many cells differ from the scaled value of an
    empty cell, and a digest of all cells."""
    m, params = _model_ready(spark, sf_dir)
    empty = F.array(*[F.lit(-mean / std) for _, (mean, std) in sorted(params.items())])
    rows = m.select("patient_id", F.size("temporal").alias("hours"), F.posexplode("temporal").alias("hour_idx", "_row"))
    cells = rows.select("patient_id", "hours", F.size("_row").alias("channels"), "hour_idx", F.posexplode("_row").alias("ch", "v"))
    differs = F.abs(F.col("v").cast("double") - F.element_at(empty, F.col("ch") + 1)) > 1e-5
    return cells.groupBy("patient_id", "ch").agg(
        F.max("hours").alias("hours"), F.max("channels").alias("channels"), F.count_if(differs).alias("filled"),
        F.sum(place_weight(F.col("hour_idx")) * whole(F.col("v"), 1000)).alias("digest"))


@query("batch_assembly")
def batch_assembly(spark, sf_dir):
    """Model-ready rows, every field, grouped into batches of 32 per split."""
    return ex.batches(_model_ready(spark, sf_dir)[0], 32)


@query("batch_members")
def batch_members(spark, sf_dir):
    """S10 exploded: the members of every batch in order, with their scalar fields, the sizes of their arrays and
    digests of the arrays' contents."""
    b = ex.batches(_model_ready(spark, sf_dir)[0], 32)
    scalars = ("patient_id", "sequence_length", *ex.TARGETS)
    sizes = [F.transform(c, F.size).alias(f"{c}_size") for c in ("static", "temporal", "time_index")]
    zero = F.lit(0).cast("long")

    def digest(values):
        return F.aggregate(F.transform(values, lambda v, i: place_weight(i) * whole(v, 1000)), zero, lambda x, y: x + y)
    sizes += [F.transform("static", digest).alias("static_digest"), F.transform("time_index", digest).alias("time_index_digest"),
              F.transform("temporal", lambda m: digest(F.flatten(m))).alias("temporal_digest")]
    x = b.select("split", "batch_id", "batch_len", F.posexplode(F.arrays_zip(*[F.col(c) for c in scalars], *sizes)).alias("position", "m"))
    return x.select("split", "batch_id", "batch_len", "position", "m.patient_id", "m.sequence_length",
                    *[F.round(F.col(f"m.{t}").cast("double"), 4).alias(t) for t in ex.TARGETS],
                    *[F.col(f"m.{c}_{of}").alias(f"{c}_{of}") for c in ("static", "temporal", "time_index") for of in ("size", "digest")])
