"""Outcome targets (A12-A16) and split label flags.

Targets read the events listed in the hourly windows: a point event at
``k = floor((d - t0)/step)`` is listed in hours ``k`` and ``k + 1`` that fall
on the grid, so with ``count_mode='listed'`` (compat) it counts once per
listing (usually twice); ``'distinct'`` counts each event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.vocab import any_keyword
from .timeline import GRID_LEN, listed_hours

KEYWORDS = {
    "severe_condition": V.TARGET_SEVERE_CONDITION,
    "critical_procedure": V.TARGET_CRITICAL_PROCEDURE,
    "icu_encounter": V.TARGET_ICU_ENCOUNTER,
    "icu_procedure": V.TARGET_ICU_PROCEDURE,
    "ventilator_procedure": V.TARGET_VENTILATOR_PROCEDURE,
}


def _lit_match(kws) -> F.Column:
    return any_keyword(F.col("description"), kws, "literal")


def targets(conditions: DataFrame, encounters: DataFrame, procedures: DataFrame, extent: DataFrame,
            keywords: dict | None = None, grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """One row per patient with a timeline:
    ``mortality_risk`` (compat, listed counts), ``mortality_risk_distinct``,
    ``icu_admission``, ``ventilator_need``, ``length_of_stay`` (compat: last
    minus first grid point, i.e. (grid_len-1)*step) and
    ``los_observed_hours`` (the observed extent)."""
    kw = dict(KEYWORDS, **(keywords or {}))
    anchors = extent.select("patient_id", F.col("timeline_start").alias("t0"))
    cond = listed_hours(conditions.select("patient_id", "ts", "description"), anchors, "ts", grid_len, step_hours)
    proc = listed_hours(procedures.select("patient_id", "ts", "description"), anchors, "ts", grid_len, step_hours)
    enc = listed_hours(encounters.select("patient_id", F.col("start").alias("ts"), "description"), anchors, "ts",
                       grid_len, step_hours)
    c = cond.where(F.col("n_listed") > 0).groupBy("patient_id").agg(
        F.sum(F.when(_lit_match(kw["severe_condition"]), F.col("n_listed")).otherwise(0)).alias("_sev_l"),
        F.count_if(_lit_match(kw["severe_condition"])).alias("_sev_d"))
    p = proc.where(F.col("n_listed") > 0).groupBy("patient_id").agg(
        F.sum(F.when(_lit_match(kw["critical_procedure"]), F.col("n_listed")).otherwise(0)).alias("_crit_l"),
        F.count_if(_lit_match(kw["critical_procedure"])).alias("_crit_d"),
        F.max(_lit_match(kw["icu_procedure"])).alias("_icu_p"),
        F.max(_lit_match(kw["ventilator_procedure"])).alias("_vent_p"))
    e = enc.where(F.col("n_listed") > 0).groupBy("patient_id").agg(
        F.max(_lit_match(kw["icu_encounter"])).alias("_icu_e"))
    x = extent.select("patient_id", "observed_hours").join(c, "patient_id", "left").join(p, "patient_id", "left") \
              .join(e, "patient_id", "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    b = lambda n: F.coalesce(F.col(n), F.lit(False))
    score = lambda s, cr: F.least(F.lit(0.3) * z(s) + F.lit(0.4) * z(cr), F.lit(1.0))
    return x.select(
        "patient_id",
        score("_sev_l", "_crit_l").alias("mortality_risk"),
        score("_sev_d", "_crit_d").alias("mortality_risk_distinct"),
        F.when(b("_icu_e") | b("_icu_p"), 1.0).otherwise(0.0).alias("icu_admission"),
        F.when(b("_vent_p"), 1.0).otherwise(0.0).alias("ventilator_need"),
        F.lit(float((grid_len - 1) * step_hours)).alias("length_of_stay"),
        F.col("observed_hours").alias("los_observed_hours"))


def label_flags(patients: DataFrame, encounters: DataFrame, procedures: DataFrame, devices: DataFrame,
                icu_keywords=V.SPLIT_ICU_KEYWORDS, vent_keywords=V.SPLIT_VENTILATOR_KEYWORDS) -> DataFrame:
    """Per patient 0/1 ``mortality`` (death date present), ``icu``
    (encounter or procedure text), ``ventilator`` (procedure or device text).
    Each table contributes one partially aggregated flag row per patient."""
    def flag(df, kws, name):
        return df.groupBy("patient_id").agg(
            F.max(any_keyword(F.col("description"), kws, "escaped").cast("int")).alias(name))
    icu = flag(encounters.select("patient_id", "description").unionByName(
        procedures.select("patient_id", "description")), icu_keywords, "icu")
    vent = flag(procedures.select("patient_id", "description").unionByName(
        devices.select("patient_id", "description")), vent_keywords, "ventilator")
    x = patients.select("patient_id", F.col("deathdate").isNotNull().cast("int").alias("mortality"))
    x = x.join(icu.hint("merge"), "patient_id", "left").join(vent.hint("merge"), "patient_id", "left")
    return x.select("patient_id", "mortality", F.coalesce("icu", F.lit(0)).alias("icu"),
                    F.coalesce("ventilator", F.lit(0)).alias("ventilator"))
