"""DuckDB oracle SQL of the declared features."""

from __future__ import annotations

from .declared import STATED_COLUMNS, STATED_WEIGHTS
from .oracle import _EVENT_BASE, _FLAGS, _PATIENTS, _PREDS, _VITAL_KW, _valued, _with

ORACLE: dict[str, str] = {}

ORACLE["forward_fill"] = _with(_EVENT_BASE, _VITAL_KW, _valued("vkw", "vit")) + """
SELECT patient_id, CAST(hour_idx AS INTEGER) AS h_start,
       CAST(coalesce(lead(hour_idx) OVER (PARTITION BY patient_id ORDER BY hour_idx), 720) - 1 AS INTEGER) AS h_end,
       round(value, 6) AS value FROM vit_collapsed"""

ORACLE["clip_outliers"] = """
WITH li AS (SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS l_suppkey
            FROM lineitem),
q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
      FROM li GROUP BY 1),
b AS (SELECT l_suppkey, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT l_orderkey, l_linenumber, l.l_suppkey, round(greatest(lo, least(hi, l_extendedprice)), 6) AS v,
       l_extendedprice < lo OR l_extendedprice > hi AS clipped
FROM li l JOIN b ON b.l_suppkey IS NOT DISTINCT FROM l.l_suppkey"""

ORACLE["calibration_error"] = _with(_PREDS, """
cb AS (SELECT task, least(floor(prediction * 10), 9) AS b, count(*) AS n, avg(prediction) AS p,
              avg(CASE WHEN target > 0.5 THEN 1.0 ELSE 0.0 END) AS y FROM bp GROUP BY 1, 2)""") + """
SELECT task, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - y)) / sum(n), 6) AS calibration_error FROM cb GROUP BY task"""

ORACLE["bootstrap_intervals"] = _with(_PREDS, """
w AS (SELECT task, rep, target > 0.5 AS t, prediction > 0.5 AS p,
             ('0x' || substr(md5(task || ':' || patient_id || ':' || rep), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM bp, range(0, 1001) AS r(rep)),
k AS (SELECT task, rep, t, p, CASE WHEN rep = 0 THEN 1 ELSE
        (SELECT count(*) FROM (VALUES (0.36787944117144233), (0.7357588823428847), (0.9196986029286058), (0.9810118431238462),
          (0.9963401531726563), (0.9994058151824183), (0.9999167588507119), (0.9999897508033253), (0.999998874797402)) AS c(x)
         WHERE w.u >= c.x) END AS n FROM w),
cnt AS (SELECT task, rep, coalesce(sum(n) FILTER (WHERE t AND p), 0) AS tp, coalesce(sum(n) FILTER (WHERE NOT t AND p), 0) AS fp,
             coalesce(sum(n) FILTER (WHERE NOT t AND NOT p), 0) AS tn, coalesce(sum(n) FILTER (WHERE t AND NOT p), 0) AS fn
      FROM k GROUP BY 1, 2),
m AS (
  SELECT task, rep, 'precision' AS metric, coalesce(tp / nullif(tp + fp, 0), 0.0) AS v FROM cnt
  UNION ALL SELECT task, rep, 'recall', coalesce(tp / nullif(tp + fn, 0), 0.0) FROM cnt
  UNION ALL SELECT task, rep, 'specificity', coalesce(tn / nullif(tn + fp, 0), 0.0) FROM cnt
  UNION ALL SELECT task, rep, 'f1_score', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) FROM cnt)""") + """
SELECT task, metric, round(max(v) FILTER (WHERE rep = 0), 6) AS estimate,
       round(quantile_cont(v, 0.025) FILTER (WHERE rep > 0), 6) AS low,
       round(quantile_cont(v, 0.975) FILTER (WHERE rep > 0), 6) AS high
FROM m GROUP BY task, metric"""


def _stated(task: str) -> str:
    weights, offset = STATED_WEIGHTS[task]
    linear = " + ".join(f"{w!r}::DOUBLE * coalesce({c}, 0)" for c, w in zip(STATED_COLUMNS, weights)) + f" + ({offset!r}::DOUBLE)"
    return f"round({linear}, 6)" if task == "length_of_stay" else f"round(1.0 / (1.0 + exp(-({linear}))), 6)"


ORACLE["batch_scores"] = _with(_PATIENTS) + f"""
SELECT patient_id, {", ".join(f"{_stated(t)} AS {t}" for t in STATED_WEIGHTS)} FROM stat"""

ORACLE["multiple_testing"] = _with(_PREDS, """
c AS (SELECT task, lang AS value, count(*) AS n, sum(CASE WHEN target > 0.5 THEN 1 ELSE 0 END) AS pos
      FROM every p JOIN documents d ON d.doc_id = p.patient_id WHERE task <> 'length_of_stay' AND target IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, sum(n) OVER (PARTITION BY task) AS tn, sum(pos) OVER (PARTITION BY task) AS tpos,
             count(*) OVER (PARTITION BY task) AS m FROM c),
y AS (SELECT *, tn - n AS rn, tpos - pos AS rpos, tpos / tn AS pool FROM x),
z AS (SELECT *, abs((pos / n - rpos / rn) / nullif(sqrt(pool * (1 - pool) * (1.0 / n + 1.0 / nullif(rn, 0))), 0)) AS a FROM y),
t AS (SELECT *, 1.0::DOUBLE / (1.0 + 0.2316419::DOUBLE * a) AS t FROM z),
p AS (SELECT *, least(2.0 * 0.3989422804014327::DOUBLE * exp(-a * a / 2.0) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE
       + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))), 1.0) AS pv FROM t)""") + """
SELECT task, value, n, round(pos / n, 6) AS rate, round(pv, 6) AS p_value, round(least(pv * m, 1.0), 6) AS p_adjusted FROM p"""

ORACLE["subgroup_metrics"] = _with(_PREDS, """
sb AS (SELECT p.task, 'lang' AS attribute, d.lang AS value, p.prediction AS s, p.target > 0.5 AS y
       FROM bp p JOIN documents d ON d.doc_id = p.patient_id
       UNION ALL SELECT p.task, 'source', d.source, p.prediction, p.target > 0.5
       FROM bp p JOIN documents d ON d.doc_id = p.patient_id),
cf AS (SELECT task, attribute, value, count(*) AS n, count(*) FILTER (WHERE y AND s > 0.5) AS tp,
              count(*) FILTER (WHERE NOT y AND s > 0.5) AS fp, count(*) FILTER (WHERE y AND s <= 0.5) AS fn
       FROM sb GROUP BY 1, 2, 3),
pairs AS (SELECT a.task, a.attribute, a.value, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auroc
          FROM sb a JOIN sb b ON a.task = b.task AND a.attribute = b.attribute AND a.value IS NOT DISTINCT FROM b.value
          WHERE a.y AND NOT b.y GROUP BY 1, 2, 3),
ap AS (SELECT a.task, a.attribute, a.value, a.s, count(*) FILTER (WHERE b.y) / count(*) AS prec
       FROM (SELECT DISTINCT task, attribute, value, s FROM sb) a
       JOIN sb b ON a.task = b.task AND a.attribute = b.attribute AND a.value IS NOT DISTINCT FROM b.value AND b.s >= a.s
       GROUP BY 1, 2, 3, 4),
av AS (SELECT a.task, a.attribute, a.value, avg(ap.prec) AS auprc FROM sb a JOIN ap ON a.task = ap.task
         AND a.attribute = ap.attribute AND a.value IS NOT DISTINCT FROM ap.value AND a.s = ap.s WHERE a.y GROUP BY 1, 2, 3)""") + """
SELECT c.task, c.attribute, c.value, c.n, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
       round(pairs.auroc, 6) AS auroc, round(av.auprc, 6) AS auprc
FROM cf c LEFT JOIN pairs ON pairs.task = c.task AND pairs.attribute = c.attribute AND pairs.value IS NOT DISTINCT FROM c.value
LEFT JOIN av ON av.task = c.task AND av.attribute = c.attribute AND av.value IS NOT DISTINCT FROM c.value"""

ORACLE["risk_bands"] = _with(_PREDS) + """
SELECT task, CASE WHEN prediction < 0.3 THEN 'low' WHEN prediction < 0.7 THEN 'moderate' ELSE 'high' END AS band,
       count(*) AS n, round(avg(prediction), 6) AS mean_score,
       round(avg(CASE WHEN target > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS outcome_rate
FROM bp GROUP BY 1, 2"""

ORACLE["stratified_folds"] = _with(_FLAGS.replace("IN ('error', 'purchase')", "IN ('error', 'purchase')")) + """
SELECT patient_id, CAST((row_number() OVER (PARTITION BY mortality, icu, ventilator
                                            ORDER BY md5(CAST(patient_id AS VARCHAR)), patient_id) - 1) % 5 AS INTEGER) AS fold
FROM flags"""

ORACLE["calendar_split"] = """
SELECT o_custkey AS patient_id, CASE WHEN min(o_orderdate) < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END AS split
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1"""

ORACLE["class_weights"] = _with(_PREDS, """
cc AS (SELECT task, CAST(target > 0.5 AS INTEGER) AS label, count(*) AS n FROM every WHERE task <> 'length_of_stay' AND target IS NOT NULL
       GROUP BY 1, 2)""") + """
SELECT task, label, n, round(sum(n) OVER (PARTITION BY task) / (count(*) OVER (PARTITION BY task) * n), 6) AS weight FROM cc"""

ORACLE["multi_task_loss"] = _with(_PREDS, """
q AS (SELECT task, target, greatest(least(prediction, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS q FROM bp),
l AS (SELECT task, avg(-(target * ln(q) + (1 - target) * ln(1 - q))) AS loss FROM q GROUP BY 1
      UNION ALL SELECT task, avg((prediction - target) * (prediction - target)) FROM preds
      WHERE task = 'length_of_stay' GROUP BY 1),
w AS (SELECT task, loss, CASE task WHEN 'mortality_risk' THEN 2.0 WHEN 'length_of_stay' THEN 1.0 ELSE 1.5 END AS weight FROM l)""") + """
SELECT task, round(loss, 6) AS loss, round(CAST(weight AS DOUBLE), 6) AS weight FROM w
UNION ALL SELECT 'total', round(sum(loss * weight), 6), round(CAST(sum(weight) AS DOUBLE), 6) FROM w"""

ORACLE["population_stability"] = """
WITH s AS (SELECT o_custkey AS id, CASE WHEN min(o_orderdate) < TIMESTAMP '1996-01-01' THEN 'train' ELSE 'test' END AS split
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
v AS (SELECT s.split, 'o_totalprice' AS feature, o_totalprice AS value FROM orders JOIN s ON s.id = o_custkey
      UNION ALL SELECT s.split, 'c_acctbal', c_acctbal FROM customer JOIN s ON s.id = c_custkey),
b AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM v WHERE split = 'train' GROUP BY 1),
k AS (SELECT split, feature, greatest(0, least(9, floor((value - lo) / (hi - lo) * 10))) AS bin, count(*) AS n
      FROM v JOIN b USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT split, feature, sum(n) AS tot FROM k GROUP BY 1, 2),
g AS (SELECT t.split, t.feature, r.bin, greatest(coalesce(k.n, 0) / t.tot, 0.0001) AS q
      FROM t CROSS JOIN range(0, 10) AS r(bin) LEFT JOIN k ON k.split = t.split AND k.feature = t.feature AND k.bin = r.bin)
SELECT q.feature, q.split, round(sum((q.q - p.q) * ln(q.q / p.q)), 6) AS psi
FROM g q JOIN g p ON p.feature = q.feature AND p.bin = q.bin AND p.split = 'train'
WHERE q.split <> 'train' GROUP BY 1, 2"""
