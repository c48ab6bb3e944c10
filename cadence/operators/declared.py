"""Features that the reference declares in its configuration: X1-X3, X5-X12
(X4: ``bootstrap``, X13: ``baseline``).

Ranks, quartiles and running sums come from the skew-safe helpers; everything
else is a grouped aggregation with map-side combine.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as me
from .quality import iqr_outliers
from .ranking import ranked

# Fixed values of the reference's configuration.
LOSS_WEIGHTS = {"mortality_risk": 2.0, "icu_admission": 1.5, "ventilator_need": 1.5, "length_of_stay": 1.0}
N_FOLDS = 5


def forward_fill(sparse: DataFrame, keys: list[str], grid_len: int) -> DataFrame:
    """Each observed value holds until the next observed hour: run-length
    segments ``(*keys, h_start, h_end, value)``. A group has at most
    ``grid_len`` rows, so the window is bounded; the dense grid is never built."""
    nxt = F.lead("hour_idx").over(Window.partitionBy(*keys).orderBy("hour_idx"))
    x = sparse.where(F.col("value").isNotNull()).select(*keys, "hour_idx", "value", nxt.alias("_next"))
    return x.select(*keys, F.col("hour_idx").alias("h_start"),
                    (F.coalesce("_next", F.lit(grid_len)) - 1).cast("int").alias("h_end"), "value")


def clip_outliers(long: DataFrame, group: list[str], value: str = "v") -> DataFrame:
    """Values clipped to [Q1 - 1.5 IQR, Q3 + 1.5 IQR] of their group, with
    ``clipped`` saying whether they were; NULL and NaN stay. A group of NULL key is a
    group of its own."""
    b = iqr_outliers(long, group, value).select(*[F.col(g).alias(f"_g_{g}") for g in group], "q1", "q3")
    x = long.join(b, [long[g].eqNullSafe(b[f"_g_{g}"]) for g in group], "left")
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    bad = F.coalesce(((v < lo) | (v > hi)) & ~F.isnan(v), F.lit(False))
    new = F.when(bad, F.when(v < lo, lo).otherwise(hi)).otherwise(v)
    return x.select(*[c for c in long.columns if c != value], new.alias(value), bad.alias("clipped"))


def calibration_error(preds: DataFrame, buckets: int = 10, target_threshold: float = 0.5) -> DataFrame:
    """Expected calibration error per task over equal-width score buckets."""
    p = me.sigmoid_if_needed(me.complete(preds))
    b = F.least(F.floor(F.col("prediction") * buckets), F.lit(buckets - 1))
    c = p.groupBy("task", b.alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("_p"),
        F.avg((F.col("target") > target_threshold).cast("double")).alias("_y"))
    return c.groupBy("task").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("n")).alias("calibration_error"))


def two_sided_p(z: F.Column) -> F.Column:
    """Two-sided normal p-value by the rational approximation 26.2.17 of
    Abramowitz and Stegun (error below 7.5e-8)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(2.0 * 0.3989422804014327 * F.exp(-a * a / 2.0) * poly, F.lit(1.0))


def bonferroni(tests: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """``p_adjusted = least(p * m, 1)`` over the ``m`` tests of a family."""
    by = family or []
    m = tests.groupBy(*by).agg(F.count(p).alias("_m")) if by else tests.agg(F.count(p).alias("_m"))
    x = tests.join(m, by) if by else tests.join(F.broadcast(m))  # one row
    return x.withColumn("p_adjusted", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def subgroup_tests(preds: DataFrame, groups: DataFrame, attribute: str, target_threshold: float = 0.5) -> DataFrame:
    """Outcome rate of each subgroup against the rest: pooled two-proportion z
    test per (task, subgroup)."""
    y = (F.col("target") > target_threshold).cast("long")
    c = preds.where(F.col("target").isNotNull()).join(groups.select("patient_id", F.col(attribute).alias("value")), "patient_id").groupBy("task", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    tot = c.groupBy("task").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    x = c.join(tot, "task")
    rest, rest_pos = F.col("_n") - F.col("n"), F.col("_pos") - F.col("pos")
    pool = F.col("_pos") / F.col("_n")
    se = F.sqrt(pool * (1 - pool) * (1.0 / F.col("n") + 1.0 / F.when(rest > 0, rest)))
    z = (F.col("pos") / F.col("n") - rest_pos / F.when(rest > 0, rest)) / F.when(se > 0, se)
    return x.select("task", "value", "n", (F.col("pos") / F.col("n")).alias("rate"), two_sided_p(z).alias("p_value"))


def subgroup_metrics(preds: DataFrame, groups: DataFrame, attributes: list[str]) -> DataFrame:
    """The binary metrics of every value of every attribute (rows without a
    value form the subgroup NULL), in the one ranking pass of E12. Scores are
    calibrated over the whole task first, so subgroups stay comparable."""
    p = me.sigmoid_if_needed(preds.where(F.col("task").isin(*me.BINARY_TASKS)))
    values = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    g = groups.select("patient_id", F.inline(values))
    x = p.join(g, "patient_id").withColumn("_task", F.to_json(F.struct("task", "attribute", "value")))
    x = x.select("patient_id", F.col("_task").alias("task"), "prediction", "target")
    tasks = F.from_json("task", "task string, attribute string, value string")
    scored = me.score_metrics(x)
    return scored.select(tasks.alias("_k"), *[c for c in scored.columns if c != "task"]).select("_k.*", *[
        c for c in scored.columns if c != "task"])


def risk_bands(preds: DataFrame, cuts: tuple[float, ...] = (0.3, 0.7),
               names: tuple[str, ...] = ("low", "moderate", "high"), target_threshold: float = 0.5) -> DataFrame:
    """Per task and score band the size, mean score and outcome rate."""
    p = me.sigmoid_if_needed(me.complete(preds).where(F.col("task").isin(*me.BINARY_TASKS)))
    band = F.lit(names[-1])
    for c, n in reversed(list(zip(cuts, names))):
        band = F.when(F.col("prediction") < c, F.lit(n)).otherwise(band)
    return p.groupBy("task", band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_score"),
        F.avg((F.col("target") > target_threshold).cast("double")).alias("outcome_rate"))


def stratified_folds(labels: DataFrame, strata: list[str], k: int = N_FOLDS) -> DataFrame:
    """Patient-level folds; within each stratum patients in md5 order are
    dealt to the folds in turn, so every fold has the stratum's share."""
    x = labels.select("patient_id", *strata, F.md5(F.col("patient_id").cast("string")).alias("_h"))
    r = ranked(x, strata, ["_h", "patient_id"], "_rn")
    return r.select("patient_id", ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def calendar_split(observations: DataFrame, split_date: dt.date) -> DataFrame:
    """Patients whose first dated observation lies before the date train,
    the others test; patients without dates are not assigned (as W1)."""
    first = observations.where(F.col("ts").isNotNull()).groupBy("patient_id").agg(F.min("ts").alias("_first"))
    before = F.col("_first") < F.lit(dt.datetime.combine(split_date, dt.time())).cast("timestamp_ntz")
    return first.select("patient_id", F.when(before, "train").otherwise("test").alias("split"))


def class_weights(preds: DataFrame, target_threshold: float = 0.5) -> DataFrame:
    """Inverse-frequency weight n / (classes * n_class) per task and class."""
    c = preds.where(F.col("task").isin(*me.BINARY_TASKS) & F.col("target").isNotNull()).groupBy(
        "task", (F.col("target") > target_threshold).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("task").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.join(tot, "task").select("task", "label", "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def multi_task_loss(preds: DataFrame, weights: dict[str, float] | None = None, eps: float = 1e-7) -> DataFrame:
    """X11: binary cross-entropy (scores within [eps, 1 - eps]) or mean squared
    error per task, its weight, and the weighted sum as task ``total``."""
    w = weights or LOSS_WEIGHTS
    preds = me.complete(preds)
    p = me.sigmoid_if_needed(preds.where(F.col("task").isin(*me.BINARY_TASKS)))
    q = F.greatest(F.least(F.col("prediction"), F.lit(1 - eps)), F.lit(eps))
    bce = p.groupBy("task").agg(F.avg(-(F.col("target") * F.log(q) + (1 - F.col("target")) * F.log(1 - q))).alias("loss"))
    d = F.col("prediction") - F.col("target")
    mse = preds.where(F.col("task") == me.REGRESSION_TASK).groupBy("task").agg(F.avg(d * d).alias("loss"))
    each = bce.unionByName(mse)
    weight = reduce(lambda a, t: F.when(F.col("task") == t, F.lit(w[t])).otherwise(a), w, F.lit(0.0))
    each = each.withColumn("weight", weight)
    return each.unionByName(each.agg(F.lit("total").alias("task"), F.sum(F.col("loss") * F.col("weight")).alias("loss"),
                                     F.sum("weight").alias("weight")))


def population_stability(values: DataFrame, reference: str, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """PSI of every feature and split against the ``reference`` split, from
    ``(split, feature, value)``: equal-width bins over the reference's range
    (values outside go to the end bins), shares of at least ``floor``."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    b = v.where(F.col("split") == reference).groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = v.join(b, "feature")
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / width * bins))))
    c = x.groupBy("feature", "split", F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("feature", "split").agg(F.sum("n").alias("_n"))
    grid = tot.select("feature", "split", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    share = grid.join(c, ["feature", "split", "bin"], "left").select(
        "feature", "split", "bin", F.greatest(F.coalesce("n", F.lit(0)) / F.col("_n"), F.lit(floor)).alias("q"))
    ref = share.where(F.col("split") == reference).select("feature", "bin", F.col("q").alias("p"))
    return share.where(F.col("split") != reference).join(ref, ["feature", "bin"]).groupBy("feature", "split").agg(
        F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))
