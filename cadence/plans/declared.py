"""Registered queries of the declared features X1-X13."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.vocab import SCALED_STATIC
from ..operators import baseline as ba
from ..operators import bootstrap as bs
from ..operators import declared as de
from ..operators import features as fe
from ..operators import metrics as me
from ..operators import splits as sp
from ..operators import timeline as tl
from ..operators.ranking import checkpointed
from ..sources import bindings as bd
from .queries import _event_timeline, _label_flags, _r, event_channels, query

SPLIT_DATE = dt.date(1996, 1, 1)


def _binary(spark, sf_dir):
    return bd.predictions(spark, sf_dir).where(F.col("task").isin(*me.BINARY_TASKS))


def _groups(spark, sf_dir):
    return bd.read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source"]).withColumnRenamed("doc_id", "patient_id")


@query("forward_fill")
def forward_fill(spark, sf_dir):
    """X1 over the collapsed hourly vitals."""
    roles, _, anchors = _event_timeline(spark, sf_dir, with_intervals=False)
    wide = tl.hourly_values_wide(roles.observations, anchors, bd.EVENT_VITALS, True)
    return _r(de.forward_fill(tl.hourly_collapsed(wide), ["patient_id"], tl.GRID_LEN), "value")


@query("clip_outliers")
def clip_outliers(spark, sf_dir):
    """Line-item prices clipped within each supplier; every tenth supplier counts as unknown (NULL, one group)."""
    li = bd.read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    li = li.withColumn("l_suppkey", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")))
    return _r(de.clip_outliers(li.withColumnRenamed("l_extendedprice", "v"), ["l_suppkey"]), "v")


@query("calibration_error")
def calibration_error(spark, sf_dir):
    """X3."""
    return _r(de.calibration_error(_binary(spark, sf_dir)), "calibration_error")


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    """The declared 1000 samples of the confusion metrics."""
    return _r(bs.bootstrap_intervals(_binary(spark, sf_dir)), "estimate", "low", "high")


@query("bootstrap_rank_intervals")
def bootstrap_rank_intervals(spark, sf_dir):
    """The declared 1000 samples of AUROC and average precision (weights by array, so no SQL oracle)."""
    return _r(bs.bootstrap_rank_intervals(_binary(spark, sf_dir)), "estimate", "low", "high")


@query("multiple_testing")
def multiple_testing(spark, sf_dir):
    """Outcome rate of each language against the rest, Bonferroni per task."""
    t = de.subgroup_tests(_binary(spark, sf_dir), _groups(spark, sf_dir), "lang")
    return _r(de.bonferroni(t, family=["task"]), "rate", "p_value", "p_adjusted")


@query("subgroup_metrics")
def subgroup_metrics(spark, sf_dir):
    """X6 by language and source."""
    s = de.subgroup_metrics(_binary(spark, sf_dir), _groups(spark, sf_dir), ["lang", "source"])
    return _r(s.select("task", "attribute", "value", "n", "precision", "recall", "f1", "auroc", "auprc"),
              "precision", "recall", "f1", "auroc", "auprc")


@query("risk_bands")
def risk_bands(spark, sf_dir):
    """X7."""
    return _r(de.risk_bands(_binary(spark, sf_dir)), "mean_score", "outcome_rate")


@query("stratified_folds")
def stratified_folds(spark, sf_dir):
    """X8 over the A11 labels."""
    return de.stratified_folds(_label_flags(spark, sf_dir), list(sp.LABELS))


@query("calendar_split")
def calendar_split(spark, sf_dir):
    """Customers by first order before 1996."""
    o = bd.read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"]).select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("ts"))
    return de.calendar_split(o, SPLIT_DATE)


@query("class_weights")
def class_weights(spark, sf_dir):
    """X10."""
    return _r(de.class_weights(_binary(spark, sf_dir)), "weight")


@query("multi_task_loss")
def multi_task_loss(spark, sf_dir):
    """X11."""
    return _r(de.multi_task_loss(bd.predictions(spark, sf_dir)), "loss", "weight")


@query("population_stability")
def population_stability(spark, sf_dir):
    """Order price and balance of later customers against the earlier ones."""
    o = bd.read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice"]).withColumnRenamed(
        "o_custkey", "patient_id")
    split = de.calendar_split(o.withColumnRenamed("o_orderdate", "ts"), SPLIT_DATE)
    c = bd.read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    long = o.select("patient_id", F.lit("o_totalprice").alias("feature"), F.col("o_totalprice").alias("value")).unionByName(
        c.select(F.col("c_custkey").alias("patient_id"), F.lit("c_acctbal").alias("feature"), F.col("c_acctbal").alias("value")))
    return _r(de.population_stability(long.join(split, "patient_id").drop("patient_id"), "train"), "psi")


def _static(spark, sf_dir):
    roles = bd.order_roles(spark, sf_dir)
    return roles, fe.static_features(roles.patients, roles.conditions, bd.ORDER_COMORBIDITIES)


@query("baseline_model")
def baseline_model(spark, sf_dir):
    """Three logistic regressions and a ridge regression on the static features of customers and the channel
    statistics of their events, fitted on the temporal split's train patients (iterative fits, so no SQL oracle)."""
    roles, static = _static(spark, sf_dir)
    sparse, anchors, channels = event_channels(spark, sf_dir)
    stats = ba.channel_features(tl.channel_stats(sparse, anchors, channels=channels), channels)
    table, columns = ba.feature_table(roles.patients, [(static, list(SCALED_STATIC)), stats])
    table = checkpointed(table)  # read by the fit and by the scoring
    events = bd.event_roles(spark, sf_dir, with_intervals=False)
    stay = events.observations.groupBy("patient_id").agg(
        (tl.micros_between(F.min("ts"), F.max("ts")) / tl.HOUR_US).alias("length_of_stay"))
    flags = _label_flags(spark, sf_dir).join(stay.hint("merge"), "patient_id", "left").select(
        "patient_id", F.col("mortality").alias("mortality_risk"), F.col("icu").alias("icu_admission"),
        F.col("ventilator").alias("ventilator_need"), "length_of_stay")
    train = sp.temporal_split(roles.observations).where("split = 'train'")
    model = ba.fit_baselines(table, columns, flags, train)
    return _r(ba.score_batches(table, *ba.linear_weights(model)), *ba.TASKS)


#: A stated scoring model on static features: weights and intercept of each task.
STATED_COLUMNS = ("age", "age_risk", "comorbidity_count", "high_comorbidity", "diabetes", "heart_disease")
STATED_WEIGHTS = {
    "mortality_risk": ([0.03, 0.5, 0.2, 0.4, 0.1, 0.3], -4.0),
    "icu_admission": ([0.02, 0.25, 0.3, 0.2, 0.15, 0.25], -2.5),
    "ventilator_need": ([0.01, 0.4, 0.25, 0.1, 0.2, 0.2], -3.0),
    "length_of_stay": ([0.5, 6.0, 4.0, 12.0, 3.0, 8.0], 24.0),
}


@query("batch_scores")
def batch_scores(spark, sf_dir):
    """Every customer scored by a stated linear model, four outputs."""
    _, static = _static(spark, sf_dir)
    return _r(ba.score_batches(static, list(STATED_COLUMNS), STATED_WEIGHTS), *ba.TASKS)
