"""M1: the complete pipeline as one lazily composed Spark job graph.

load roles -> cohort (P1/U1, optional S4 slice) -> restrict (J1) -> quality
(Q1/Q3/Q4/Q5/Q7/Q8, P8) -> split (W2 -> W1 -> W3 fallback, W4) -> timeline
(A7, F15 channels) -> static (F18, F17) + targets (A16) -> fitted scaling on
train (F7, F8; state saved, S8) -> model-ready rows (S9, partitioned by
split) + reports (S5, S7).

Driver work is limited to counts for cut points, the <= 9 * min_pos
pre-assigned stratified ids and the fitted scaler numbers.
"""

from __future__ import annotations

import datetime as dt
import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import COHORT_KEYWORDS, COMORBIDITIES, SCALED_STATIC, TEMPORAL_CATEGORIES
from ..operators import cohort as co
from ..operators import export as ex
from ..operators import features as fe
from ..operators import quality as qa
from ..operators import splits as sp
from ..operators import targets as tg
from ..operators import timeline as tl
from ..operators.ranking import checkpointed, materialized_scope
from ..sources import sinks
from ..sources.tables import Roles


@dataclass
class PipelineConfig:
    test_size: float = 0.1
    validation_size: float = 0.15
    min_pos_per_label: int = 3
    seed: int = 42
    split_strategy: str = "stratified"          # stratified | temporal | random
    as_of: dt.date = dt.date(2025, 1, 1)
    grid_len: int = tl.GRID_LEN
    step_hours: float = 1.0
    cohort_keywords: tuple = COHORT_KEYWORDS
    comorbidities: object = COMORBIDITIES
    categories: tuple = TEMPORAL_CATEGORIES
    target_keywords: dict = field(default_factory=dict)
    sample_size: int | None = None
    start_index: int = 0


def restrict_roles(roles: Roles, cohort: DataFrame) -> Roles:
    return roles.with_(**{n: co.restrict(df, cohort) for n, df in roles.frames().items()})


def choose_split(roles: Roles, valid: DataFrame, cfg: PipelineConfig) -> tuple[DataFrame, str, dict[str, str]]:
    """Stratified -> temporal -> random; returns the split, the strategy
    used and the reason of each strategy that the data didn't allow. Only
    ``CannotSplit`` moves on to the next strategy; any other failure is raised."""
    order = {"stratified": ["stratified", "temporal", "random"], "temporal": ["temporal", "random"],
             "random": ["random"]}[cfg.split_strategy]
    skipped: dict[str, str] = {}
    for strategy in order:
        try:
            if strategy == "stratified":
                flags = tg.label_flags(roles.patients, roles.encounters, roles.procedures, roles.devices)
                flags = flags.join(valid, "patient_id", "left_semi")
                split = sp.stratified_split(flags, cfg.test_size, cfg.validation_size, cfg.min_pos_per_label, cfg.seed)
            elif strategy == "temporal":
                obs = roles.observations.join(valid, "patient_id", "left_semi")
                split = sp.temporal_split(obs, cfg.test_size, cfg.validation_size).drop("first_ts")
            else:
                split = sp.random_split(valid, cfg.test_size, cfg.validation_size, cfg.seed)
        except sp.CannotSplit as e:
            skipped[strategy] = str(e)
            continue
        return checkpointed(split), strategy, skipped
    raise sp.CannotSplit(f"no split strategy is possible: {skipped}")


def run_pipeline(roles: Roles, output_dir: str, cfg: PipelineConfig | None = None,
                 raw: dict[str, DataFrame] | None = None) -> dict:
    """``raw``: the loaded tables keyed by ``patient_id`` (``patient_slices``);
    when given, the missing-value and outlier scans cover every raw column,
    otherwise the role frames. Everything is written to ``output_dir``; tables
    materialised on the way are deleted at the end."""
    with materialized_scope(roles.patients.sparkSession):
        return _run(roles, output_dir, cfg or PipelineConfig(), raw)


def _run(roles: Roles, output_dir: str, cfg: PipelineConfig, raw: dict[str, DataFrame] | None) -> dict:
    spark = roles.patients.sparkSession
    # cohort and optional deterministic slice
    cohort = co.cohort_ids([roles.conditions, roles.observations], cfg.cohort_keywords)
    if cfg.sample_size is not None or cfg.start_index:
        cohort = co.cohort_sample(cohort, cfg.start_index, cfg.sample_size)
    cohort = checkpointed(cohort)
    r = restrict_roles(roles, cohort)
    # quality
    base = cohort.select("patient_id")
    tabs = {n: co.restrict(df, cohort) for n, df in raw.items()} if raw else dict(r.frames())
    missing = checkpointed(qa.missing_by_patient(tabs, base))
    outliers = qa.outliers_by_patient(tabs)
    valid = missing.where(F.col("is_valid")).select("patient_id")
    cov = qa.temporal_coverage(r.observations, base)
    counts = [r.observations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_obs")),
              r.encounters.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_enc")),
              r.medications.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_med"))]
    per = missing.select("patient_id", "is_valid", "completeness").join(cov, "patient_id")
    for c in counts:
        per = per.join(c, "patient_id", "left")
    per = per.na.fill(0, ["n_obs", "n_enc", "n_med"])
    summary = qa.quality_summary(per)
    cons = qa.temporal_consistency(r.observations, base, dt.datetime.combine(cfg.as_of, dt.time()))
    cons = cons.join(per.select("patient_id", F.col("n_obs").alias("n_obs_rows")), "patient_id")
    seen = r.observations.select("patient_id").unionByName(r.conditions.select("patient_id"))
    issues = qa.patient_issues(missing, cons, outliers, per.select("patient_id", "n_obs"), r.patients, seen)
    reports = sinks.write_report({"quality_summary": summary, "recommendations": qa.recommendations(summary),
                                  "issues": issues}, os.path.join(output_dir, "validation_report"))
    # split
    split, strategy, skipped = choose_split(r, valid, cfg)
    v = restrict_roles(r, valid)
    # timeline, channels, static, targets
    extent = checkpointed(tl.timeline_extent(v, cfg.grid_len, cfg.step_hours))
    anchors = tl.anchors_of(extent)
    channels, names = ex.temporal_segments(v, anchors, cfg.categories, cfg.grid_len, cfg.step_hours)
    channels = checkpointed(channels)  # read by the scaler fit and by the dense matrix
    static = fe.static_features(v.patients, v.conditions, cfg.comorbidities, cfg.as_of)
    targets = tg.targets(v.conditions, v.encounters, v.procedures, extent, cfg.target_keywords, cfg.grid_len,
                         cfg.step_hours)
    # fitted scaling on the training split only
    train_ids = split.where(F.col("split") == "train").select("patient_id")
    static_params = fe.scaler_params(fe.fit_standard_scaler(static.join(train_ids, "patient_id", "left_semi")),
                                     SCALED_STATIC)
    chan_params = ex.fit_channel_scaler(channels, anchors.join(train_ids, "patient_id", "left_semi"), len(names),
                                        cfg.grid_len)
    sinks.save_state(spark, {"static": static_params, "temporal": chan_params},
                     os.path.join(output_dir, "pipeline_state"))
    static_scaled = fe.apply_standard_scaler(static, static_params)
    temporal = ex.dense_matrix(channels, anchors, len(names), cfg.grid_len, chan_params)
    ready = ex.model_ready(static_scaled, temporal, targets, split, cfg.grid_len, len(names), cfg.step_hours)
    ex.write_model_ready(ready, os.path.join(output_dir, "model_ready"))
    meta = ex.split_metadata(spark.read.parquet(os.path.join(output_dir, "model_ready")), n_channels=len(names),
                             grid_len=cfg.grid_len)
    meta_rows = [m.asDict() for m in meta.collect()]  # three rows
    result = {"split_strategy": strategy, "split_skipped": skipped, "splits": meta_rows, "temporal_channels": names,
              "reports": reports, "model_ready": os.path.join(output_dir, "model_ready")}
    # written through Spark so the output folder may be any shared file system
    spark.createDataFrame([(json.dumps(result, default=str),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(os.path.join(output_dir, "pipeline_results"))
    return result
