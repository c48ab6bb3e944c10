"""Poisson bootstrap intervals of the confusion and rank metrics.

A Poisson bootstrap weighs every row with a Poisson(1) number. The sum of ``n`` such weights is a Poisson(``n``)
number, so rows that a metric can't tell apart are counted once and one number is drawn for all of them (a
compound draw): the replicates have the same distribution and no row is ever repeated. Draws depend only on
what they are drawn for (task, cell or score, replicate), so reruns and lost executors give the same
numbers. Replicate 0 is the data itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as me
from .ranking import materialize, tagged

SAMPLES = 1000
#: Counts up to this are drawn from their exact distribution, larger ones from its expansion at the normal
#: quantile (an error of the distribution function below 0.0005, shrinking with the count).
EXACT_UP_TO = 32
#: Terms of the exact distribution: no draw of a count up to ``EXACT_UP_TO`` lies beyond.
TERMS = 110

# Coefficients of the rational approximation of the normal quantile (relative error below 1.15e-9).
NORMAL_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
NORMAL_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
NORMAL_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
NORMAL_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
NORMAL_TAIL = 0.02425


def _polynomial(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def normal_quantile(u: Column) -> Column:
    def tail(p: Column) -> Column:
        return _let(F.sqrt(-2.0 * F.log(p)), lambda q: _polynomial(NORMAL_C, q) / _polynomial(NORMAL_D, q))
    middle = _let(u - 0.5, lambda q: _polynomial(NORMAL_A, q * q) * q / _polynomial(NORMAL_B, q * q))
    return F.when(u < NORMAL_TAIL, tail(u)).when(u > 1 - NORMAL_TAIL, -tail(1.0 - u)).otherwise(middle)


def poisson_draw(n: Column, key: Column) -> Column:
    """A Poisson(``n``) number that only depends on ``n`` and the text ``key``: the inverse distribution function."""
    mean = n.cast("double")

    def exact(u: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            p = s["p"] * mean / i
            return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["k"] + (s["c"] <= u).cast("long")).alias("k"))
        zero = F.exp(-mean)
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)),
                           F.struct(zero.alias("p"), zero.alias("c"), F.lit(0).cast("long").alias("k")), step)["k"]

    def expanded(z: Column) -> Column:
        root = F.sqrt(mean)
        return F.greatest(F.ceil(mean + root * z + (z * z - 1) / 6.0 + (z - z * z * z) / (72.0 * root) - 0.5), F.lit(0))

    return _let((F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32,
                lambda u: F.when(n <= EXACT_UP_TO, exact(u)).otherwise(_let(normal_quantile(u), expanded)))


def _intervals(long: DataFrame, level: float) -> DataFrame:
    """``task, metric, estimate, low, high`` from ``task, rep, metric, v``: percentiles of the replicates 1 and up."""
    tail = (1 - level) / 2
    drawn = F.when(F.col("rep") > 0, F.col("v"))
    return long.groupBy("task", "metric").agg(
        F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("estimate"),
        F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"))


#: P(Poisson(1) <= k) for k = 0, 1, ... 8.
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
               0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402)


def poisson_weight(digest: Column) -> Column:
    """A Poisson(1) number from an MD5 in hex: how many steps of the distribution function the number of its first 8
    digits, over 2**32, has reached (digits order as the numbers do)."""
    weight = F.lit(len(POISSON_CDF))
    for k, c in reversed(list(enumerate(POISSON_CDF))):
        weight = F.when(digest < f"{math.ceil(c * 2.0**32):08x}", k).otherwise(weight)
    return weight.cast("long")


def bootstrap_intervals(preds: DataFrame, samples: int = SAMPLES, level: float = 0.95, threshold: float = 0.5,
                        target_threshold: float = 0.5) -> DataFrame:
    """Precision, recall, specificity and F1 of every task with their percentile intervals.

    Every row of the predictions gets a weight of its own in each replicate; rows of the same task, patient and cell
    share it. Replicates are summed map-side: ``samples`` x 4 counts per task are shuffled, not the resampled rows."""
    p = me.sigmoid_if_needed(me.complete(preds))
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: by size the few bytes would be one task
    rows = p.repartition(n, "task", "patient_id").groupBy(
        "task", "patient_id", (F.col("target") > target_threshold).alias("_t"),
        (F.col("prediction") > threshold).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    rep = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("rep"))
    rep = rep.withColumn("_d", F.md5(F.concat_ws(":", "task", "patient_id", "rep")))
    w = F.when(F.col("rep") == 0, 1).otherwise(poisson_weight(F.col("_d")))  # replicate 0 is the data itself
    part = lambda t, q: F.sum(F.when((F.col("_t") == t) & (F.col("_p") == q), F.col("_w")).otherwise(0))
    rep = rep.select("task", "rep", "_t", "_p", (w * F.col("_n")).alias("_w")).groupBy("task", "rep").agg(
        part(True, True).alias("tp"), part(False, True).alias("fp"), part(False, False).alias("tn"), part(True, False).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v")) for m, v in (
        ("precision", ratio(tp, tp + fp)), ("recall", ratio(tp, tp + fn)), ("specificity", ratio(tn, tn + fp)),
        ("f1_score", ratio(2 * tp, 2 * tp + fp + fn)))])
    return _intervals(rep.select("task", "rep", F.inline(cells)), level)


# ------------------------------------------------------------------ rank metrics

#: Distinct scores whose replicate weights are held at once.
ROWS = 512


def _uniform(key: np.ndarray, samples: int) -> np.ndarray:
    """One number in (0, 1) for each key and replicate 1.. ``samples`` (a mixed counter)."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64)[:, None] + np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _quantile_table(n: int) -> np.ndarray:
    """P(Poisson(n) <= k) for k = 0, 1, ... up to where it is 1 in doubles."""
    k = np.arange(int(n + 12 * math.sqrt(n) + 30))
    log_p = k * math.log(n) - n - np.array([math.lgamma(i + 1.0) for i in k])
    return np.cumsum(np.exp(log_p))


def weights(n: np.ndarray, key: np.ndarray, samples: int) -> np.ndarray:
    """Rows of replicate weights: ``n`` itself, then ``samples`` Poisson(``n``) numbers of each key."""
    u = _uniform(key, samples)
    out = np.zeros((len(n), samples + 1))
    out[:, 0] = n
    for count in np.unique(n[n > 0]):
        at = n == count
        out[at, 1:] = np.searchsorted(_quantile_table(int(count)), u[at], side="right")
    return out


def _chunks(pdf: pd.DataFrame, samples: int):
    """Weights of the positives and negatives of ascending scores, a bounded number of scores at a time."""
    key = pdf["key"].to_numpy().view(np.uint64)
    for i in range(0, len(pdf), ROWS):
        part = slice(i, i + ROWS)
        yield (weights(pdf["pos"].to_numpy()[part], key[part], samples),
               weights(pdf["neg"].to_numpy()[part], ~key[part], samples))


def bootstrap_rank_intervals(preds: DataFrame, samples: int = SAMPLES, level: float = 0.95,
                             target_threshold: float = 0.5, num_partitions: int | None = None) -> DataFrame:
    """AUROC (E1) and average precision (E2) of every task with their percentile intervals.

    Rows are counted once per distinct score and cut into range partitions. A partition draws its scores' weights
    a few hundred at a time and keeps three numbers for each replicate; running sums of those over the partitions
    of a task place every partition among the others. AUROC adds up from them; average precision needs the counts
    above, so its partitions draw the same weights once more.
    """
    p = me.sigmoid_if_needed(me.complete(preds))
    pos = (F.col("target") > target_threshold).cast("long")
    g = p.groupBy("task", F.col("prediction").alias("score")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    g = g.withColumn("key", F.xxhash64("task", "score"))
    g = tagged(g, ["task"], ["score"], num_partitions).select("task", "score", "pos", "neg", "key", F.col("_pid").alias("piece"))

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        below, all_pos, inner = (np.zeros(samples + 1) for _ in range(3))
        for w_pos, w_neg in _chunks(pdf, samples):
            under = below + np.cumsum(w_neg, axis=0) - w_neg
            inner += (w_pos * (under + w_neg / 2.0)).sum(axis=0)
            all_pos += w_pos.sum(axis=0)
            below += w_neg.sum(axis=0)
        return pd.DataFrame({"task": pdf["task"].iloc[0], "piece": pdf["piece"].iloc[0], "rep": np.arange(samples + 1),
                             "pos": all_pos, "neg": below, "inner": inner})

    part = materialize(g.groupBy("task", "piece").applyInPandas(
        totals, "task string, piece int, rep int, pos double, neg double, inner double"), "replicates")
    by = Window.partitionBy("task", "rep").orderBy("piece")
    lower, upper = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    placed = part.select("task", "piece", "rep", "pos", "neg", "inner", zero(F.sum("neg").over(lower)).alias("neg_below"),
                         zero(F.sum("pos").over(upper)).alias("pos_above"), zero(F.sum("neg").over(upper)).alias("neg_above"))
    placed = materialize(placed, "placed-replicates")

    def precisions(pdf: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
        offsets = offsets.sort_values("rep")
        tp, fp = offsets["pos_above"].to_numpy().copy(), offsets["neg_above"].to_numpy().copy()
        total = np.zeros(samples + 1)
        for w_pos, w_neg in _chunks(pdf.sort_values("score", ascending=False), samples):
            hits, others = tp + np.cumsum(w_pos, axis=0), fp + np.cumsum(w_neg, axis=0)
            total += np.divide(w_pos * hits, hits + others, out=np.zeros_like(hits), where=hits + others > 0).sum(axis=0)
            tp, fp = hits[-1], others[-1]
        return pd.DataFrame({"task": pdf["task"].iloc[0], "rep": np.arange(samples + 1), "part": total})

    ap = g.groupBy("task", "piece").cogroup(placed.groupBy("task", "piece")).applyInPandas(
        precisions, "task string, rep int, part double").groupBy("task", "rep").agg(F.sum("part").alias("part"))
    roc = placed.groupBy("task", "rep").agg(
        F.sum(F.col("inner") + F.col("pos") * F.col("neg_below")).alias("wins"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    both = roc.join(ap, ["task", "rep"])
    pairs = F.col("P") * F.col("N")
    cells = F.array(F.struct(F.lit("auroc").alias("metric"), (F.col("wins") / F.when(pairs > 0, pairs)).alias("v")),
                    F.struct(F.lit("auprc").alias("metric"), (F.col("part") / F.when(F.col("P") > 0, F.col("P"))).alias("v")))
    return _intervals(both.select("task", "rep", F.inline(cells)), level)
