"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans: proximity and activity use the
literal range predicates on a generated 720-point grid, and every
classification joins a keyword table with ``regexp_matches``. Floats are
rounded to 6 places, as on the Spark side.
"""

from __future__ import annotations

# Shared CTEs ---------------------------------------------------------------

_EVENT_BASE = """
iv AS (
  SELECT user_id AS patient_id, event_type AS description, ts AS start,
         LEAD(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS stop
  FROM events),
stamps AS (
  SELECT user_id AS patient_id, ts FROM events
  UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'signup'
  UNION ALL SELECT patient_id, start FROM iv
  UNION ALL SELECT patient_id, stop FROM iv
  UNION ALL SELECT user_id, ts FROM events WHERE event_type IN ('purchase', 'error')),
anchors AS (
  SELECT patient_id, min(ts) AS t0 FROM stamps WHERE ts IS NOT NULL GROUP BY patient_id),
grid AS (
  SELECT a.patient_id, r.hour_idx, a.t0 + r.hour_idx * INTERVAL 1 HOUR AS t
  FROM anchors a CROSS JOIN range(0, 720) AS r(hour_idx))"""

_VITAL_KW = """
vkw(type, type_ord, kw, kw_ord) AS (VALUES
  ('engagement', 0, 'click', 0), ('engagement', 0, 'view', 1),
  ('conversion', 1, 'purchase', 0), ('conversion', 1, 'signup', 1),
  ('failure', 2, 'error', 0), ('failure', 2, 'err', 1))"""

_LAB_KW = """
lkw(type, type_ord, kw, kw_ord) AS (VALUES
  ('glucose', 0, 'glucose', 0), ('glucose', 0, 'blood glucose', 1),
  ('creatinine', 1, 'creatinine', 0),
  ('sodium', 2, 'sodium', 0), ('sodium', 2, 'na', 1),
  ('potassium', 3, 'potassium', 0), ('potassium', 3, 'k', 1),
  ('hemoglobin', 4, 'hemoglobin', 0), ('hemoglobin', 4, 'hgb', 1),
  ('white_blood_cells', 5, 'white blood cell', 0), ('white_blood_cells', 5, 'wbc', 1),
  ('platelets', 6, 'platelet', 0),
  ('c_reactive_protein', 7, 'c-reactive protein', 0), ('c_reactive_protein', 7, 'crp', 1))"""

_OTHER_KW = """
mkw(type, kw) AS (VALUES ('browsing', 'view'), ('clicking', 'click'), ('buying', 'purchase')),
pkw(type, kw) AS (VALUES ('checkout', 'purchase'), ('failure', 'error')),
dkw(type, kw) AS (VALUES ('session', 'signup'), ('session', 'view'), ('alarm', 'error'))"""


def _valued(kwtab: str, name: str) -> str:
    """Per-type and collapsed hourly values with the literal window."""
    return f"""
{name}_win AS (
  SELECT g.patient_id, g.hour_idx, e.event_type, e.value
  FROM grid g JOIN events e
    ON e.user_id = g.patient_id AND e.ts >= g.t - INTERVAL 1 HOUR AND e.ts < g.t + INTERVAL 1 HOUR
  WHERE e.value IS NOT NULL AND NOT isnan(e.value)),
{name}_kwmean AS (
  SELECT w.patient_id, w.hour_idx, k.type, k.type_ord, k.kw_ord, avg(w.value) AS mean
  FROM {name}_win w JOIN {kwtab} k ON regexp_matches(w.event_type, k.kw, 'i')
  GROUP BY ALL),
{name}_type AS (
  SELECT patient_id, hour_idx, type, type_ord, arg_min(mean, kw_ord) AS value
  FROM {name}_kwmean GROUP BY ALL),
{name}_collapsed AS (
  SELECT patient_id, hour_idx, arg_max(value, type_ord) AS value FROM {name}_type GROUP BY ALL)"""


_PROC = """
proc_counts AS (
  SELECT g.patient_id, g.hour_idx, CAST(count(DISTINCT k.type) AS DOUBLE) AS value
  FROM grid g JOIN events e
    ON e.user_id = g.patient_id AND e.event_type IN ('purchase', 'error')
   AND e.ts >= g.t - INTERVAL 1 HOUR AND e.ts < g.t + INTERVAL 1 HOUR
  JOIN pkw k ON regexp_matches(e.event_type, k.kw, 'i')
  GROUP BY ALL)"""


def _active(kwtab: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT g.patient_id, g.hour_idx, CAST(count(DISTINCT k.type) AS DOUBLE) AS value
  FROM grid g JOIN iv
    ON iv.patient_id = g.patient_id AND iv.start <= g.t AND (iv.stop IS NULL OR iv.stop > g.t)
  JOIN {kwtab} k ON regexp_matches(iv.description, k.kw, 'i')
  GROUP BY ALL)"""


def _stats(sparse: str, channel: str) -> str:
    return f"""
  SELECT g.patient_id, '{channel}' AS channel,
         round(avg(coalesce(s.value, 0)), 6) AS mean,
         round(stddev_pop(coalesce(s.value, 0)), 6) AS std,
         round(max(coalesce(s.value, 0)), 6) AS max,
         round(regr_slope(coalesce(s.value, 0), g.hour_idx), 6) AS trend
  FROM grid g LEFT JOIN {sparse} s ON s.patient_id = g.patient_id AND s.hour_idx = g.hour_idx
  GROUP BY g.patient_id"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


ORACLE: dict[str, str] = {}

ORACLE["channel_stats"] = _with(
    _EVENT_BASE, _VITAL_KW, _LAB_KW, _OTHER_KW, _valued("vkw", "vit"), _valued("lkw", "lab"), _PROC,
    _active("mkw", "med_counts"), _active("dkw", "dev_counts")) + "\n" + "\nUNION ALL".join([
        _stats("vit_collapsed", "vital_signs"), _stats("lab_collapsed", "laboratory_values"),
        _stats("med_counts", "medications"), _stats("proc_counts", "procedures"),
        _stats("dev_counts", "devices")])

ORACLE["timeline_extent"] = _with(_EVENT_BASE) + """
SELECT patient_id, min(ts) AS timeline_start,
       least(min(ts) + INTERVAL 720 HOUR, max(ts)) AS timeline_end,
       count(*) AS n_timestamps,
       ((epoch_us(least(min(ts) + INTERVAL 720 HOUR, max(ts)) - min(ts)) + 1800) // 3600) / 1000000.0
         AS observed_hours
FROM stamps WHERE ts IS NOT NULL GROUP BY patient_id"""

ORACLE["hourly_vitals_by_type"] = _with(_EVENT_BASE, _VITAL_KW, _valued("vkw", "vit")) + """
SELECT patient_id, hour_idx, type, round(value, 6) AS value FROM vit_type"""

ORACLE["hourly_vitals_collapsed"] = _with(_EVENT_BASE, _VITAL_KW, _valued("vkw", "vit")) + """
SELECT patient_id, hour_idx, round(value, 6) AS value FROM vit_collapsed"""

ORACLE["hourly_labs_collapsed"] = _with(_EVENT_BASE, _LAB_KW, _valued("lkw", "lab")) + """
SELECT patient_id, hour_idx, round(value, 6) AS value FROM lab_collapsed"""

ORACLE["hourly_procedures"] = _with(_EVENT_BASE, _OTHER_KW, _PROC) + """
SELECT * FROM proc_counts"""

ORACLE["hourly_active_meds"] = _with(_EVENT_BASE, _OTHER_KW, _active("mkw", "med_counts")) + """
SELECT * FROM med_counts"""

ORACLE["hourly_active_devices"] = _with(_EVENT_BASE, _OTHER_KW, _active("dkw", "dev_counts")) + """
SELECT * FROM dev_counts"""

ORACLE["hourly_event_counts"] = _with(_EVENT_BASE, """
kinds AS (
  SELECT user_id AS patient_id, ts, 'conditions' AS kind FROM events WHERE event_type = 'error'
  UNION ALL SELECT user_id, ts, 'encounters' FROM events WHERE event_type = 'signup'
  UNION ALL SELECT patient_id, start, 'medications' FROM iv
  UNION ALL SELECT user_id, ts, 'procedures' FROM events WHERE event_type IN ('purchase', 'error'))""") + """
SELECT g.patient_id, g.hour_idx, k.kind, count(*) AS n_events, min(k.ts) AS first_ts
FROM grid g JOIN kinds k
  ON k.patient_id = g.patient_id AND k.ts >= g.t - INTERVAL 1 HOUR AND k.ts < g.t + INTERVAL 1 HOUR
GROUP BY ALL"""

ORACLE["hourly_event_lists"] = ORACLE["hourly_event_counts"].replace("AS kind FROM events", "AS kind, event_type AS description FROM events").replace(
    "ts, 'encounters' FROM", "ts, 'encounters', event_type FROM").replace("'medications' FROM", "'medications', description FROM").replace(
    "ts, 'procedures' FROM", "ts, 'procedures', event_type FROM").replace(
    "SELECT g.patient_id, g.hour_idx, k.kind, count(*) AS n_events, min(k.ts) AS first_ts",
    "SELECT g.patient_id, g.hour_idx, k.kind, k.ts, k.description").replace("GROUP BY ALL", "")

ORACLE["event_time_records"] = _with(_EVENT_BASE, """
recs AS (
  SELECT user_id AS patient_id, ts, 'observations' AS kind, event_type AS description FROM events
  UNION ALL SELECT user_id, ts, 'conditions', event_type FROM events WHERE event_type = 'error'
  UNION ALL SELECT patient_id, start, 'medications', description FROM iv
  UNION ALL SELECT user_id, ts, 'procedures', event_type FROM events WHERE event_type IN ('purchase', 'error')
  UNION ALL SELECT user_id, ts, 'encounters', event_type FROM events WHERE event_type = 'signup')""") + """
SELECT patient_id, CAST(dense_rank() OVER (PARTITION BY patient_id ORDER BY ts) AS BIGINT) AS pos, ts, kind, description
FROM recs WHERE ts IS NOT NULL"""

_TEXT_VALUE = """CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN ' ' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END"""
ORACLE["hourly_vitals_text"] = _with(
    _EVENT_BASE, _VITAL_KW, "events2 AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value) FROM events)",
    _valued("vkw", "vit").replace("JOIN events e", "JOIN events2 e")) + """
SELECT patient_id, hour_idx, round(value, 6) AS value FROM vit_collapsed"""

ORACLE["dense_grid_zero_fill"] = _with(_EVENT_BASE, _VITAL_KW, _valued("vkw", "vit")) + """
SELECT g.patient_id, g.hour_idx, round(coalesce(v.value, 0), 6) AS value
FROM grid g LEFT JOIN vit_collapsed v ON v.patient_id = g.patient_id AND v.hour_idx = g.hour_idx"""

ORACLE["relative_time"] = _with(_EVENT_BASE) + """
SELECT e.event_id, e.user_id AS patient_id, ((epoch_us(e.ts - a.t0) + 1800) // 3600) / 1000000.0 AS rel_hours
FROM events e JOIN anchors a ON a.patient_id = e.user_id"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# Cohort / static ------------------------------------------------------------

_COHORT = """
cohort AS (
  SELECT user_id AS patient_id FROM events WHERE regexp_matches(event_type, 'err|purch', 'i')
  UNION
  SELECT o_custkey FROM orders WHERE regexp_matches(o_orderpriority, 'urgent', 'i'))"""

ORACLE["cohort_keyword"] = _with(_COHORT) + "\nSELECT patient_id FROM cohort"

ORACLE["cohort_tables_semijoin"] = _with(_COHORT) + """
SELECT event_id, user_id AS patient_id, ts, event_type, value FROM events
WHERE user_id IN (SELECT patient_id FROM cohort)"""

ORACLE["cohort_sample"] = _with(_COHORT) + "\nSELECT patient_id FROM cohort ORDER BY patient_id LIMIT 50 OFFSET 10"

_PATIENTS = """
pat AS (
  SELECT c.c_custkey AS patient_id,
         CASE WHEN c.c_custkey % 37 <> 0
              THEN CAST(CAST(f.first_order AS DATE) - (c.c_custkey % 80) * INTERVAL 1 YEAR AS DATE) END AS birthdate,
         CASE WHEN c.c_acctbal < 0 THEN CAST(f.first_order AS DATE) + INTERVAL 30 DAY END AS deathdate,
         CASE c.c_mktsegment WHEN 'BUILDING' THEN 'F' WHEN 'AUTOMOBILE' THEN 'M'
              WHEN 'HOUSEHOLD' THEN 'F' WHEN 'FURNITURE' THEN 'X' END AS gender,
         CASE c.c_nationkey % 7 WHEN 0 THEN 'white' WHEN 1 THEN 'black' WHEN 2 THEN 'asian'
              WHEN 3 THEN 'native' WHEN 4 THEN 'other' WHEN 5 THEN 'martian' END AS race,
         CASE c.c_nationkey % 3 WHEN 0 THEN 'nonhispanic' WHEN 1 THEN 'hispanic' END AS ethnicity
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) f
    ON f.o_custkey = c.c_custkey),
demo AS (
  SELECT patient_id,
         coalesce(datediff('day', birthdate, DATE '2025-01-01') / 365.25, 0.0) AS age,
         CASE gender WHEN 'F' THEN 0.0 WHEN 'M' THEN 1.0 ELSE 2.0 END AS gender,
         CASE race WHEN 'asian' THEN 1.0 WHEN 'black' THEN 2.0 WHEN 'native' THEN 3.0
                   WHEN 'other' THEN 4.0 WHEN 'white' THEN 5.0 ELSE 0.0 END AS race,
         CASE ethnicity WHEN 'hispanic' THEN 1.0 WHEN 'nonhispanic' THEN 2.0 ELSE 0.0 END AS ethnicity
  FROM pat),
com AS (
  SELECT p.patient_id,
    CAST(coalesce(bool_or(regexp_matches(o.o_orderpriority || ' ' || o.o_orderstatus, '1-urgent p', 'i')), false) AS DOUBLE) AS diabetes,
    CAST(coalesce(bool_or(regexp_matches(o.o_orderpriority || ' ' || o.o_orderstatus, '2-high p', 'i')), false) AS DOUBLE) AS hypertension,
    CAST(coalesce(bool_or(regexp_matches(o.o_orderpriority || ' ' || o.o_orderstatus, '3-medium p', 'i')), false) AS DOUBLE) AS obesity,
    CAST(coalesce(bool_or(regexp_matches(o.o_orderpriority || ' ' || o.o_orderstatus, 'not specified p', 'i')), false) AS DOUBLE) AS copd,
    CAST(coalesce(bool_or(regexp_matches(o.o_orderpriority || ' ' || o.o_orderstatus, '5-low p', 'i')), false) AS DOUBLE) AS heart_disease
  FROM pat p LEFT JOIN orders o ON o.o_custkey = p.patient_id GROUP BY p.patient_id),
stat AS (
  SELECT d.patient_id, d.age, d.gender, d.race, d.ethnicity,
         c.diabetes, c.hypertension, c.obesity, c.copd, c.heart_disease,
         1.0 AS healthcare_coverage, 0.5 AS income_level,
         CASE WHEN d.age > 65 THEN 1.0 ELSE 0.0 END AS age_risk,
         CASE WHEN d.age < 18 THEN 0.0 WHEN d.age < 50 THEN 1.0 WHEN d.age < 65 THEN 2.0 ELSE 3.0 END AS age_group,
         c.diabetes + c.hypertension + c.obesity + c.copd + c.heart_disease AS comorbidity_count,
         CASE WHEN c.diabetes + c.hypertension + c.obesity + c.copd + c.heart_disease >= 2 THEN 1.0 ELSE 0.0 END
           AS high_comorbidity
  FROM demo d JOIN com c USING (patient_id))"""

ORACLE["static_demographics"] = _with(_PATIENTS) + """
SELECT patient_id, round(age, 6) AS age, gender, race, ethnicity FROM demo"""

ORACLE["comorbidity_flags"] = _with(_PATIENTS) + "\nSELECT * FROM com"

ORACLE["static_features"] = _with(_PATIENTS) + """
SELECT * REPLACE (round(age, 6) AS age) FROM stat"""

ORACLE["derived_static"] = _with(_PATIENTS) + """
SELECT patient_id, age_risk, age_group, comorbidity_count, high_comorbidity FROM stat"""

ORACLE["targets"] = _with(_EVENT_BASE, """
listed AS (
  SELECT g.patient_id,
    count(*) FILTER (WHERE e.event_type = 'error' AND e.kind = 'c' AND contains(lower(e.event_type), 'error')) AS sev_l,
    count(DISTINCT e.event_id) FILTER (WHERE e.kind = 'c' AND contains(lower(e.event_type), 'error')) AS sev_d,
    count(*) FILTER (WHERE e.kind = 'p' AND contains(lower(e.event_type), 'purchase')) AS crit_l,
    count(DISTINCT e.event_id) FILTER (WHERE e.kind = 'p' AND contains(lower(e.event_type), 'purchase')) AS crit_d,
    bool_or(e.kind = 'p' AND contains(lower(e.event_type), 'error')) AS icu_p,
    bool_or(e.kind = 'e' AND contains(lower(e.event_type), 'signup')) AS icu_e,
    bool_or(e.kind = 'p' AND contains(lower(e.event_type), 'purch')) AS vent_p
  FROM grid g JOIN (
      SELECT event_id, user_id, ts, event_type, 'c' AS kind FROM events WHERE event_type = 'error'
      UNION ALL SELECT event_id, user_id, ts, event_type, 'e' FROM events WHERE event_type = 'signup'
      UNION ALL SELECT event_id, user_id, ts, event_type, 'p' FROM events WHERE event_type IN ('purchase', 'error')) e
    ON e.user_id = g.patient_id AND e.ts >= g.t - INTERVAL 1 HOUR AND e.ts < g.t + INTERVAL 1 HOUR
  GROUP BY g.patient_id)""") + """
SELECT a.patient_id,
  round(least(0.3 * coalesce(l.sev_l, 0) + 0.4 * coalesce(l.crit_l, 0), 1.0), 6) AS mortality_risk,
  round(least(0.3 * coalesce(l.sev_d, 0) + 0.4 * coalesce(l.crit_d, 0), 1.0), 6) AS mortality_risk_distinct,
  CASE WHEN coalesce(l.icu_e, false) OR coalesce(l.icu_p, false) THEN 1.0 ELSE 0.0 END AS icu_admission,
  CASE WHEN coalesce(l.vent_p, false) THEN 1.0 ELSE 0.0 END AS ventilator_need,
  719.0 AS length_of_stay,
  ((epoch_us(least(a.t0 + INTERVAL 720 HOUR, m.mx) - a.t0) + 1800) // 3600) / 1000000.0 AS los_observed_hours
FROM anchors a
JOIN (SELECT patient_id, max(ts) AS mx FROM stamps GROUP BY 1) m USING (patient_id)
LEFT JOIN listed l USING (patient_id)"""

ORACLE["label_flags"] = _with(_PATIENTS) + """
SELECT p.patient_id,
  CAST(p.deathdate IS NOT NULL AS INTEGER) AS mortality,
  CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.patient_id
               AND e.event_type IN ('signup', 'purchase', 'error') AND regexp_matches(e.event_type, 'signup', 'i'))
       AS INTEGER) AS icu,
  CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.patient_id
               AND regexp_matches(e.event_type, 'error|purchase', 'i')) AS INTEGER) AS ventilator
FROM pat p"""

ORACLE["event_time_timeline"] = """
WITH recs AS (
  SELECT o_custkey AS patient_id, o_orderdate AS ts, 'encounters' AS kind FROM orders
  UNION ALL
  SELECT o.o_custkey, l.l_shipdate, 'procedures' FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
per_ts AS (
  SELECT patient_id, ts, count(*) AS n_records,
         count(*) FILTER (WHERE kind = 'encounters') AS n_encounters,
         count(*) FILTER (WHERE kind = 'procedures') AS n_procedures
  FROM recs WHERE ts IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ts) AS pos FROM per_ts"""

ORACLE["padded_sequences"] = """
WITH o AS (
  SELECT o_custkey AS patient_id, o_totalprice AS value,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rd
  FROM orders),
top AS (SELECT * FROM o WHERE rd <= 12),
kept AS (SELECT c.c_custkey AS patient_id, count(t.rd) AS k
         FROM customer c LEFT JOIN top t ON t.patient_id = c.c_custkey GROUP BY 1)
SELECT t.patient_id, k.k - t.rd + 1 AS pos, round(t.value, 6) AS value, 0 AS is_pad, k.k AS sequence_length
FROM top t JOIN kept k USING (patient_id)
UNION ALL
SELECT k.patient_id, r.pos, 0.0, 1, k.k
FROM kept k JOIN range(1, 13) AS r(pos) ON r.pos > k.k"""


ORACLE["derived_features"] = ORACLE["channel_stats"].replace("WITH ", _with(_PATIENTS) + ",\n", 1).replace(
    "\n  SELECT g.patient_id, 'vital_signs'", ", cs AS (\n  SELECT g.patient_id, 'vital_signs'", 1) + """)
SELECT s.patient_id, s.age_risk, s.age_group, s.comorbidity_count, s.high_comorbidity, c.channel, c.mean, c.std, c.max, c.trend
FROM stat s JOIN cs c USING (patient_id)"""

# Quality ------------------------------------------------------------------

_ORDER_ROLES = _PATIENTS + """,
obs AS (SELECT o_custkey AS patient_id, o_orderdate AS ts, NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS description,
               o_totalprice AS value FROM orders),
cond AS (SELECT o_custkey AS patient_id, o_orderdate AS ts, o_orderpriority || ' ' || o_orderstatus AS description
         FROM orders)"""

_ROLE_COLS = {"patients": ["patient_id", "birthdate", "deathdate", "gender", "race", "ethnicity"],
              "observations": ["patient_id", "ts", "description", "value"],
              "conditions": ["patient_id", "ts", "description"]}
_ROLE_VIEW = {"patients": "pat", "observations": "obs", "conditions": "cond"}

ORACLE["missing_profile"] = _with(_ORDER_ROLES) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count "
    f"FROM {_ROLE_VIEW[t]}" for t, cols in _ROLE_COLS.items() for c in cols)


def _nullsum(cols):
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


_MISSING = _ORDER_ROLES + f""",
cells AS (
  SELECT patient_id, {_nullsum(_ROLE_COLS['patients'])} AS m, 6 AS t FROM pat
  UNION ALL SELECT patient_id, {_nullsum(_ROLE_COLS['observations'])}, 4 FROM obs
  UNION ALL SELECT patient_id, {_nullsum(_ROLE_COLS['conditions'])}, 3 FROM cond),
miss AS (
  SELECT p.patient_id, CAST(coalesce(sum(c.m), 0) AS BIGINT) AS missing_cells,
         CAST(coalesce(sum(c.t), 0) AS BIGINT) AS total_cells
  FROM pat p LEFT JOIN cells c USING (patient_id) GROUP BY p.patient_id),
missq AS (
  SELECT patient_id, missing_cells, total_cells,
         CASE WHEN total_cells > 0 THEN missing_cells / total_cells ELSE 0.0 END AS missing_share,
         CASE WHEN total_cells > 0 THEN (total_cells - missing_cells) / total_cells ELSE 0.0 END AS completeness
  FROM miss)"""

ORACLE["missing_by_entity"] = _with(_MISSING) + """
SELECT patient_id, missing_cells, total_cells, round(missing_share, 6) AS missing_share,
       round(completeness, 6) AS completeness, missing_share > 0.2 AS high_missing, missing_share <= 0.8 AS is_valid
FROM missq"""

ORACLE["missing_by_table"] = _with(_MISSING.replace("AS m, 6 AS t FROM pat", "AS m, 6 AS t, 'patients' AS table_name FROM pat")
    .replace(", 4 FROM obs", ", 4, 'observations' FROM obs").replace(", 3 FROM cond", ", 3, 'conditions' FROM cond")) + """
SELECT patient_id, table_name, CAST(sum(m) AS BIGINT) AS missing_cells, CAST(sum(t) AS BIGINT) AS total_cells
FROM cells GROUP BY 1, 2"""

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
           "l_tax"]
ORACLE["iqr_outliers"] = "WITH long AS (\n" + "\n  UNION ALL ".join(
    f"SELECT l_suppkey AS patient_id, '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM lineitem"
    for c in _LI_NUM) + """),
b AS (SELECT patient_id, column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM long WHERE v IS NOT NULL GROUP BY ALL)
SELECT b.patient_id, b.column_name, round(b.q1, 6) AS q1, round(b.q3, 6) AS q3,
       count(*) FILTER (WHERE l.v < b.q1 - 1.5 * (b.q3 - b.q1) OR l.v > b.q3 + 1.5 * (b.q3 - b.q1)) AS n_outliers
FROM b JOIN long l USING (patient_id, column_name)
GROUP BY b.patient_id, b.column_name, b.q1, b.q3"""

_CONSIST = _ORDER_ROLES + """,
cons AS (
  SELECT p.patient_id, count(o.ts) AS n_valid,
         count(*) FILTER (WHERE o.ts > TIMESTAMP '1999-01-01 00:00:00') AS n_future,
         coalesce(epoch_us(max(o.ts) - min(o.ts)) > 730 * 86400000000, false) AS long_period
  FROM pat p LEFT JOIN obs o USING (patient_id) GROUP BY p.patient_id)"""

ORACLE["temporal_consistency"] = _with(_CONSIST) + """
SELECT patient_id, n_valid, n_future, long_period,
       round(CASE WHEN n_valid > 0 THEN (n_valid - n_future) / n_valid ELSE 1.0 END, 6) AS consistency_score
FROM cons"""

_COVER = """,
cover AS (
  SELECT p.patient_id,
         CASE WHEN count(o.ts) = 0 THEN 0.0
              ELSE least((floor(epoch(max(o.ts) - min(o.ts)) / 86400) + 1) / 30.0, 1.0) END AS temporal_coverage
  FROM pat p LEFT JOIN obs o ON o.patient_id = p.patient_id AND o.ts IS NOT NULL GROUP BY p.patient_id)"""

ORACLE["temporal_coverage"] = _with(_ORDER_ROLES + _COVER) + """
SELECT patient_id, round(temporal_coverage, 6) AS temporal_coverage FROM cover"""

_SUMMARY = _MISSING + _COVER + """,
per AS (
  SELECT m.patient_id, m.missing_share <= 0.8 AS is_valid, m.completeness, c.temporal_coverage,
         (SELECT count(*) FROM obs o WHERE o.patient_id = m.patient_id) AS n_obs,
         (SELECT count(*) FROM orders o WHERE o.o_custkey = m.patient_id) AS n_enc,
         (SELECT count(*) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
          WHERE o.o_custkey = m.patient_id) AS n_med
  FROM missq m JOIN cover c USING (patient_id)),
summ AS (
  SELECT count(*) AS total_patients, count(*) FILTER (WHERE is_valid) AS valid_patients,
         count(*) FILTER (WHERE NOT is_valid) AS invalid_patients,
         sum(n_obs) FILTER (WHERE is_valid) / count(*) FILTER (WHERE is_valid) AS avg_observations_per_patient,
         sum(n_enc) FILTER (WHERE is_valid) / count(*) FILTER (WHERE is_valid) AS avg_encounters_per_patient,
         sum(n_med) FILTER (WHERE is_valid) / count(*) FILTER (WHERE is_valid) AS avg_medications_per_patient,
         sum(completeness) FILTER (WHERE is_valid) / count(*) FILTER (WHERE is_valid) AS data_completeness,
         sum(temporal_coverage) FILTER (WHERE is_valid) / count(*) FILTER (WHERE is_valid) AS temporal_coverage
  FROM per)"""

ORACLE["quality_summary"] = _with(_SUMMARY) + """
SELECT total_patients, valid_patients, invalid_patients,
       round(avg_observations_per_patient, 6) AS avg_observations_per_patient,
       round(avg_encounters_per_patient, 6) AS avg_encounters_per_patient,
       round(avg_medications_per_patient, 6) AS avg_medications_per_patient,
       round(data_completeness, 6) AS data_completeness, round(temporal_coverage, 6) AS temporal_coverage
FROM summ"""

_RECS = """
r AS (
  SELECT 0 AS o, 'Review and clean data for ' || invalid_patients || ' invalid patients' AS t FROM summ
    WHERE invalid_patients > 0
  UNION ALL SELECT 1, 'Consider collecting more patient data for robust model training' FROM summ
    WHERE valid_patients < {patients}
  UNION ALL SELECT 2, 'Implement data imputation strategies for missing values' FROM summ
    WHERE coalesce(data_completeness, 1.0) < {completeness}
  UNION ALL SELECT 3, 'Ensure adequate temporal coverage for all patients' FROM summ
    WHERE coalesce(temporal_coverage, 1.0) < {coverage})"""
_RECS_SELECT = """
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS rank, t AS recommendation FROM r"""
ORACLE["recommendations"] = _with(_SUMMARY.replace("m.missing_share <= 0.8", "m.missing_share <= 0.02"), _RECS.format(
    patients=100_000_000, completeness=0.999, coverage=1.01)) + _RECS_SELECT

ORACLE["patient_issues"] = _with(_MISSING + "," + _CONSIST.split(",\ncons AS", 1)[0].split(_ORDER_ROLES, 1)[1]
                                 + "cons AS" + _CONSIST.split(",\ncons AS", 1)[1], """
nobs AS (SELECT p.patient_id, count(o.patient_id) AS n_obs FROM pat p LEFT JOIN obs o USING (patient_id)
         GROUP BY p.patient_id)""") + """
SELECT patient_id, 'no_observations' AS code, 'No observations data' AS detail, false AS fatal
  FROM nobs WHERE n_obs = 0
UNION ALL SELECT c.patient_id, 'no_valid_dates', 'No valid dates found', false
  FROM cons c JOIN nobs n USING (patient_id) WHERE c.n_valid = 0 AND n.n_obs > 0
UNION ALL SELECT patient_id, 'future_dates', 'Future dates detected: ' || n_future || ' observations', false
  FROM cons WHERE n_future > 0
UNION ALL SELECT patient_id, 'long_period', 'Unusually long observation period', false FROM cons WHERE long_period
UNION ALL SELECT patient_id, 'high_missing', printf('Very high missing values: %.2f%%', missing_share * 100), true
  FROM missq WHERE missing_share > 0.8
UNION ALL SELECT patient_id, 'missing_patients_row', 'Missing required tables: [''patients'']', false
  FROM (SELECT patient_id FROM obs UNION SELECT patient_id FROM cond) s
  WHERE patient_id NOT IN (SELECT patient_id FROM pat)
UNION ALL SELECT q.patient_id, 'outliers', 'Outliers detected: ' || count(*) || ' values', false
  FROM (SELECT patient_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM obs
        WHERE value IS NOT NULL GROUP BY patient_id) q
  JOIN obs o ON o.patient_id = q.patient_id
  WHERE o.value < q.q1 - 1.5 * (q.q3 - q.q1) OR o.value > q.q3 + 1.5 * (q.q3 - q.q1)
  GROUP BY q.patient_id"""

# The text forms of ``timestamp_text_forms`` and what each must parse to.
ORACLE["timestamp_text_forms"] = """
SELECT event_id, CAST(event_id % 8 AS INTEGER) AS form,
       CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN ts
            WHEN event_id % 8 IN (4, 5) THEN date_trunc('second', ts)
            WHEN event_id % 8 = 6 THEN date_trunc('minute', ts)
            ELSE date_trunc('day', ts) END AS parsed
FROM events"""

#: Columns of the given tables and their types.
_COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz "
              "o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double "
                "l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string "
                "l_shipdate:timestamp_ntz",
    "events": "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array<float> label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}


def _dtype_sql() -> str:
    def column(table: str, name: str, kind: str) -> str:
        text = f"CAST({name} AS VARCHAR)" if kind == "string" else "NULL::VARCHAR"
        return f"""SELECT '{table}' AS table_name, '{name}' AS column_name, '{kind}' AS data_type, count(*) AS rows,
  count({name}) AS n, count(*) FILTER (WHERE regexp_full_match({text}, '[+-]?[0-9]{{1,18}}')) AS ints,
  count(*) FILTER (WHERE regexp_full_match({text}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')) AS numbers,
  count(*) FILTER (WHERE {text} IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false')) AS booleans FROM {table}"""
    parts = [column(t, *c.split(":")) for t, cs in _COLUMNS.items() for c in cs.split()]
    return "WITH c AS (" + " UNION ALL ".join(parts) + """)
SELECT table_name, column_name, data_type, n AS n_values,
  CASE WHEN n = 0 THEN CASE WHEN rows = 0 THEN 'object' ELSE 'float64' END
       WHEN data_type IN ('int', 'bigint') OR ints = n THEN CASE WHEN n = rows THEN 'int64' ELSE 'float64' END
       WHEN data_type = 'double' OR numbers = n THEN 'float64'
       WHEN booleans = n THEN CASE WHEN n = rows THEN 'bool' ELSE 'object' END
       WHEN data_type = 'timestamp_ntz' THEN 'datetime64' ELSE 'object' END AS inferred_type FROM c"""


ORACLE["dtype_profile"] = _dtype_sql()

ORACLE["undated_patients"] = """
SELECT c_custkey AS patient_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE ts IS NOT NULL)"""

ORACLE["predictions_with_targets"] = """
SELECT d.doc_id AS patient_id, t.task, round(d.n_chars / 20000.0, 6) AS prediction,
       CAST(CASE t.task WHEN 'mortality_risk' THEN l.quality ELSE l.toxic END AS DOUBLE) AS target
FROM documents d, (VALUES ('mortality_risk'), ('icu_admission')) AS t(task), labels l WHERE l.doc_id = d.doc_id"""

ORACLE["patient_metadata"] = _with(_PATIENTS) + """
SELECT patient_id, CAST(birthdate AS VARCHAR) AS birthdate, gender, race, ethnicity FROM pat"""

ORACLE["dataset_coverage"] = """
WITH enc AS (
  SELECT o.o_orderdate AS start, l.stop FROM orders o
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS stop FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey)
SELECT min(start) AS start_date, max(stop) AS end_date,
       CAST(floor(epoch(max(stop) - min(start)) / 86400) AS BIGINT) AS date_range_days
FROM enc"""

_PATIENT_KEY = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}
ORACLE["dataset_summary"] = _with(_COHORT) + "\nUNION ALL\n".join(
    f"\nSELECT '{t}' AS table_name, count(*) AS rows, (SELECT count(*) FROM information_schema.columns "
    f"WHERE table_name = '{t}') AS columns, "
    + (f"count(DISTINCT {_PATIENT_KEY[t]})" if t in _PATIENT_KEY else "CAST(0 AS BIGINT)")
    + f" AS patients, (SELECT count(*) FROM cohort) AS cohort_patients FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"))

_COHORT_PAT = _COHORT + "," + _PATIENTS + """,
cpat AS (SELECT * FROM pat WHERE patient_id IN (SELECT patient_id FROM cohort))"""

ORACLE["value_counts"] = _with(_COHORT_PAT) + """
SELECT 'gender' AS attribute, gender AS value, count(*) AS n FROM cpat WHERE gender IS NOT NULL GROUP BY gender
UNION ALL
SELECT 'race', race, count(*) FROM cpat WHERE race IS NOT NULL GROUP BY race"""

ORACLE["date_describe"] = _with(_COHORT_PAT, """
f AS (SELECT CAST(birthdate AS VARCHAR) AS s, count(*) AS f FROM cpat WHERE birthdate IS NOT NULL GROUP BY 1)""") + """
SELECT (SELECT sum(f) FROM f)::BIGINT AS count, (SELECT count(*) FROM f)::BIGINT AS unique,
       (SELECT s FROM f ORDER BY f DESC, s LIMIT 1) AS top, (SELECT max(f) FROM f)::BIGINT AS freq"""


# Splits --------------------------------------------------------------------

_TSPLIT = """
first AS (SELECT o_custkey AS patient_id, min(o_orderdate) AS first_ts FROM orders
          WHERE o_orderdate IS NOT NULL GROUP BY 1),
cuts AS (SELECT CAST(floor(count(*) * (1 - CAST(0.1 AS DOUBLE))) AS BIGINT) AS test_end FROM first),
cuts2 AS (SELECT test_end,
                 CAST(floor(test_end * (1 - CAST(0.15 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE)))) AS BIGINT) AS val_end
          FROM cuts),
ranked AS (SELECT patient_id, row_number() OVER (ORDER BY first_ts, patient_id) AS rn FROM first),
tsplit AS (
  SELECT r.patient_id, CASE WHEN r.rn <= c.val_end THEN 'train' WHEN r.rn <= c.test_end THEN 'validation'
                            ELSE 'test' END AS split
  FROM ranked r, cuts2 c)"""

ORACLE["temporal_split"] = _with(_TSPLIT) + "\nSELECT patient_id, split FROM tsplit"

_FLAGS = _PATIENTS + """,
flags AS (
  SELECT p.patient_id, CAST(p.deathdate IS NOT NULL AS INTEGER) AS mortality,
    CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.patient_id AND e.event_type = 'signup') AS INTEGER) AS icu,
    CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.patient_id
                 AND e.event_type IN ('error', 'purchase')) AS INTEGER) AS ventilator
  FROM pat p)"""

ORACLE["split_counts"] = _with(_TSPLIT, _FLAGS) + """
SELECT s.split, count(*) AS n_patients, CAST(sum(f.mortality) AS BIGINT) AS mortality_pos,
       CAST(sum(f.icu) AS BIGINT) AS icu_pos, CAST(sum(f.ventilator) AS BIGINT) AS ventilator_pos
FROM tsplit s LEFT JOIN flags f USING (patient_id) GROUP BY s.split"""

_HASHED = _with(_FLAGS, """
h AS (SELECT *, md5(patient_id || ':42') AS h FROM flags),
a1 AS (SELECT patient_id, row_number() OVER (ORDER BY h, patient_id) AS r FROM h WHERE mortality = 1),
p1 AS (SELECT patient_id, r FROM a1 WHERE r <= 9),
a2 AS (SELECT patient_id, row_number() OVER (ORDER BY h, patient_id) AS r FROM h
       WHERE icu = 1 AND patient_id NOT IN (SELECT patient_id FROM p1)),
p2 AS (SELECT patient_id, r FROM a2 WHERE r <= 9),
a3 AS (SELECT patient_id, row_number() OVER (ORDER BY h, patient_id) AS r FROM h WHERE ventilator = 1
         AND patient_id NOT IN (SELECT patient_id FROM p1) AND patient_id NOT IN (SELECT patient_id FROM p2)),
p3 AS (SELECT patient_id, r FROM a3 WHERE r <= 9),
pre AS (SELECT patient_id, CASE WHEN r <= 3 THEN 'test' WHEN r <= 6 THEN 'validation' ELSE 'train' END AS split
        FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
need AS (SELECT greatest(0, greatest(1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT))
                            - (SELECT count(*) FROM pre WHERE split = 'test')) AS t,
                greatest(0, greatest(1, CAST(round_even(n * CAST(0.15 AS DOUBLE), 0) AS BIGINT))
                            - (SELECT count(*) FROM pre WHERE split = 'validation')) AS v
         FROM (SELECT count(*) AS n FROM flags)),
rest AS (SELECT patient_id, row_number() OVER (ORDER BY h, patient_id) AS r FROM h
         WHERE patient_id NOT IN (SELECT patient_id FROM pre)),
strat AS (SELECT * FROM pre UNION ALL
          SELECT patient_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' ELSE 'train' END FROM rest, need)""")

ORACLE["stratified_split"] = _HASHED + "\nSELECT patient_id, split FROM strat"
ORACLE["stratified_split_sizes"] = _HASHED + "\nSELECT split, count(*) AS n_patients FROM strat GROUP BY split"

_RANDOM = """
WITH n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT n, CAST(ceil(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS t FROM n),
s2 AS (SELECT n, t, CAST(ceil((n - t) * (CAST(0.15 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE)))) AS BIGINT) AS v FROM s),
r AS (SELECT c_custkey AS patient_id, row_number() OVER (ORDER BY md5(c_custkey || ':42'), c_custkey) AS r FROM customer),
rnd AS (SELECT patient_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' ELSE 'train' END AS split
        FROM r, s2)"""
ORACLE["random_split"] = _RANDOM + "\nSELECT patient_id, split FROM rnd"
ORACLE["random_split_sizes"] = _RANDOM + "\nSELECT split, count(*) AS n_patients FROM rnd GROUP BY split"

_SCALED_COLS = ["age", "diabetes", "hypertension", "obesity", "copd", "heart_disease", "healthcare_coverage",
                "income_level"]
_ALL_STATIC = ["age", "gender", "race", "ethnicity", "diabetes", "hypertension", "obesity", "copd", "heart_disease",
               "healthcare_coverage", "income_level", "age_risk", "age_group", "comorbidity_count", "high_comorbidity"]

ORACLE["scaled_static"] = _with(_PATIENTS, _TSPLIT, """
fit AS (SELECT """ + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
    for c in _SCALED_COLS) + """
        FROM stat WHERE patient_id IN (SELECT patient_id FROM tsplit WHERE split = 'train'))""") + """
SELECT st.patient_id, """ + ", ".join(
    (f"round(coalesce((st.{c} - fit.{c}_m) / fit.{c}_s, 0.0), 6) AS {c}" if c in _SCALED_COLS
     else f"round(st.{c}, 6) AS {c}") for c in _ALL_STATIC) + "\nFROM stat st, fit"


# Metrics -------------------------------------------------------------------

_PREDS = """
lab AS (SELECT l.doc_id, CASE WHEN l.doc_id % 29 <> 0 THEN CAST(d.n_chars AS DOUBLE) / 20000.0 END AS s,
               CAST(l.quality AS DOUBLE) AS quality, CASE WHEN l.doc_id % 37 <> 0 THEN CAST(l.toxic AS DOUBLE) END AS toxic
        FROM labels l JOIN documents d USING (doc_id)),
every AS (
  SELECT doc_id AS patient_id, 'mortality_risk' AS task, s AS prediction, quality AS target FROM lab
  UNION ALL SELECT doc_id, 'icu_admission', s, toxic FROM lab
  UNION ALL SELECT doc_id, 'ventilator_need', (s - 0.5) * 4.0, quality FROM lab
  UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'length_of_stay',
                   CASE WHEN l_orderkey % 31 <> 0 THEN l_quantity * p_retailprice / 1000.0 END, l_extendedprice / 1000.0
            FROM lineitem JOIN part ON p_partkey = l_partkey),
preds AS (SELECT * FROM every WHERE prediction IS NOT NULL AND target IS NOT NULL),
bp AS (
  SELECT p.patient_id, p.task,
         CASE WHEN b.logit THEN 1.0 / (1.0 + exp(-p.prediction)) ELSE p.prediction END AS prediction, p.target
  FROM preds p JOIN (SELECT task, min(prediction) < 0 OR max(prediction) > 1 AS logit FROM preds
                     WHERE task <> 'length_of_stay' GROUP BY task) b USING (task)),
sg AS (SELECT task, prediction AS score, sum(CASE WHEN target > 0.5 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN target > 0.5 THEN 0 ELSE 1 END) AS neg FROM bp GROUP BY ALL),
cum AS (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY task ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg,
         sum(pos) OVER (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos + neg) OVER (PARTITION BY task ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pp
  FROM sg),
rank_m AS (
  SELECT task,
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below_neg + neg / 2.0)) / (sum(pos) * sum(neg)) END
           AS auroc,
         CASE WHEN sum(pos) > 0 THEN sum(pos * tp / pp) / sum(pos) END AS auprc
  FROM cum GROUP BY task),
cm AS (
  SELECT task, count(*) FILTER (WHERE target > 0.5 AND prediction > 0.5) AS tp,
         count(*) FILTER (WHERE target <= 0.5 AND prediction > 0.5) AS fp,
         count(*) FILTER (WHERE target <= 0.5 AND prediction <= 0.5) AS tn,
         count(*) FILTER (WHERE target > 0.5 AND prediction <= 0.5) AS fn, count(*) AS n
  FROM bp GROUP BY task),
bin AS (
  SELECT cm.task, n, tp, fp, tn, fn,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
    CASE WHEN tp + fn + fp = 0 OR tn + fp + fn = 0 THEN 1.0 WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END
      AS specificity,
    CASE WHEN tp + fn + fp = 0 OR tn + fp + fn = 0 THEN 0.0 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END
      AS sensitivity,
    CASE WHEN tp + fn + fp = 0 OR tn + fp + fn = 0 THEN 0.0 WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END
      AS positive_predictive_value,
    CASE WHEN tp + fn + fp = 0 OR tn + fp + fn = 0 THEN 1.0 WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0 END
      AS negative_predictive_value,
    r.auroc, r.auprc
  FROM cm LEFT JOIN rank_m r USING (task)),
reg AS (
  SELECT task, count(*) AS n, avg(abs(target - prediction)) AS mae,
         sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
         avg(abs((target - prediction) / (target + 1e-8))) * 100 AS mape,
         CASE WHEN var_pop(target) * count(*) > 0
              THEN 1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*))
              ELSE 0.0 END AS r2,
         avg(CASE WHEN abs(target - prediction) <= 24 THEN 1.0 ELSE 0.0 END) AS within_24h,
         avg(CASE WHEN abs(target - prediction) <= 48 THEN 1.0 ELSE 0.0 END) AS within_48h
  FROM preds WHERE task = 'length_of_stay' GROUP BY task),
ovr AS (
  SELECT avg(auroc) AS average_auroc, stddev_pop(auroc) AS auroc_std,
         avg(auroc) FILTER (WHERE task IN ('mortality_risk', 'icu_admission')) AS clinical_composite_score
  FROM bin WHERE auroc IS NOT NULL)"""

ORACLE["binary_metrics"] = _with(_PREDS) + """
SELECT task, n, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(specificity, 6) AS specificity, round(sensitivity, 6) AS sensitivity,
       round(positive_predictive_value, 6) AS positive_predictive_value,
       round(negative_predictive_value, 6) AS negative_predictive_value,
       round(auroc, 6) AS auroc, round(auprc, 6) AS auprc
FROM bin"""

ORACLE["regression_metrics"] = _with(_PREDS) + """
SELECT task, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(r2, 6) AS r2,
       round(within_24h, 6) AS within_24h, round(within_48h, 6) AS within_48h FROM reg"""

ORACLE["overall_metrics"] = _with(_PREDS) + """
SELECT round(average_auroc, 6) AS average_auroc, round(auroc_std, 6) AS auroc_std,
       round(clinical_composite_score, 6) AS clinical_composite_score FROM ovr"""

ORACLE["interpretation"] = _with(_PREDS) + """
SELECT task, CASE WHEN auroc >= 0.9 THEN 'Excellent' WHEN auroc >= 0.8 THEN 'Good' WHEN auroc >= 0.7 THEN 'Fair'
                  ELSE 'Poor' END || ' discrimination for mortality risk prediction' AS interpretation
FROM bin WHERE task = 'mortality_risk'
UNION ALL
SELECT task, CASE WHEN auroc >= 0.85 THEN 'Excellent' WHEN auroc >= 0.75 THEN 'Good' ELSE 'Fair' END
             || ' discrimination for ICU admission prediction' FROM bin WHERE task = 'icu_admission'
UNION ALL
SELECT task, CASE WHEN mae <= 24 AND within_24h >= 0.8 THEN 'Excellent' WHEN mae <= 48 AND within_24h >= 0.6
                  THEN 'Good' ELSE 'Fair' END || ' length of stay prediction accuracy' FROM reg"""

ORACLE["metric_summary"] = _with(_PREDS) + """
SELECT 'overall_performance' AS section, 'overall' AS task, m.metric, round(m.value, 6) AS value
FROM ovr, (VALUES ('average_auroc'), ('clinical_composite_score')) AS k(metric),
     LATERAL (SELECT k.metric AS metric,
                     CASE k.metric WHEN 'average_auroc' THEN average_auroc ELSE clinical_composite_score END AS value) m
UNION ALL
SELECT 'binary_classification', task, metric, round(value, 6)
FROM (UNPIVOT (SELECT task, auroc, precision, recall, f1 AS f1_score FROM bin) ON auroc, precision, recall, f1_score
      INTO NAME metric VALUE value)
UNION ALL
SELECT 'regression', task, metric, round(value, 6)
FROM (UNPIVOT (SELECT task, mae, rmse, r2, within_24h, within_48h FROM reg) ON mae, rmse, r2, within_24h, within_48h
      INTO NAME metric VALUE value)"""

ORACLE["roc_points"] = _with(_PREDS) + """
SELECT c.task, round(c.score, 6) AS threshold,
       round(c.fp / nullif(t.nn, 0), 6) AS fpr, round(c.tp / nullif(t.pp_, 0), 6) AS tpr
FROM cum c JOIN (SELECT task, sum(pos) AS pp_, sum(neg) AS nn FROM sg GROUP BY task) t USING (task)
UNION ALL
SELECT task, NULL, CASE WHEN sum(neg) > 0 THEN 0.0 END, CASE WHEN sum(pos) > 0 THEN 0.0 END FROM sg GROUP BY task"""

ORACLE["residual_histogram"] = _with(_PREDS, """
r AS (SELECT prediction - target AS r FROM preds WHERE task = 'length_of_stay'),
st AS (SELECT CASE WHEN max(r) > min(r) THEN min(r) ELSE min(r) - 0.5 END AS lo,
              CASE WHEN max(r) > min(r) THEN (max(r) - min(r)) / 30 ELSE 1.0 / 30 END AS w FROM r),
c AS (SELECT CAST(least(floor((r.r - st.lo) / st.w), 29) AS INTEGER) + 1 AS bin, count(*) AS n FROM r, st GROUP BY 1)""") + """
SELECT CAST(b.bin AS INTEGER) AS bin, round(st.lo + (b.bin - 1) * st.w, 6) AS bin_start,
       round(st.lo + b.bin * st.w, 6) AS bin_end, coalesce(c.n, 0) AS n
FROM range(1, 31) AS b(bin) CROSS JOIN st LEFT JOIN c ON c.bin = b.bin"""


# Temporal channels -----------------------------------------------------------

ORACLE["temporal_channels"] = _with(_EVENT_BASE, _VITAL_KW, _LAB_KW, _valued("vkw", "vit"), _valued("lkw", "lab"), """
mk(type_ord, kw) AS (VALUES (0, 'view'), (1, 'click'), (2, 'purchase')),
pk(type_ord, kw) AS (VALUES (0, 'purchase'), (1, 'error')),
dk(type_ord, kw) AS (VALUES (0, 'signup'), (0, 'view'), (1, 'error')),
med_t AS (
  SELECT DISTINCT g.patient_id, g.hour_idx, k.type_ord FROM grid g
  JOIN iv ON iv.patient_id = g.patient_id AND iv.start <= g.t AND (iv.stop IS NULL OR iv.stop > g.t)
  JOIN mk k ON regexp_matches(iv.description, k.kw, 'i')),
dev_t AS (
  SELECT DISTINCT g.patient_id, g.hour_idx, k.type_ord FROM grid g
  JOIN iv ON iv.patient_id = g.patient_id AND iv.start <= g.t AND (iv.stop IS NULL OR iv.stop > g.t)
  JOIN dk k ON regexp_matches(iv.description, k.kw, 'i')),
proc_t AS (
  SELECT DISTINCT g.patient_id, g.hour_idx, k.type_ord FROM grid g
  JOIN events e ON e.user_id = g.patient_id AND e.event_type IN ('purchase', 'error')
   AND e.ts >= g.t - INTERVAL 1 HOUR AND e.ts < g.t + INTERVAL 1 HOUR
  JOIN pk k ON regexp_matches(e.event_type, k.kw, 'i'))""") + """
SELECT patient_id, hour_idx, type_ord AS ch, round(value, 6) AS value FROM vit_type
UNION ALL SELECT patient_id, hour_idx, 3 + type_ord, round(value, 6) FROM lab_type
UNION ALL SELECT patient_id, hour_idx, 11 + type_ord, 1.0 FROM med_t
UNION ALL SELECT patient_id, hour_idx, 14 + type_ord, 1.0 FROM proc_t
UNION ALL SELECT patient_id, hour_idx, 16 + type_ord, 1.0 FROM dev_t"""


# Model-ready export ------------------------------------------------------------

_ESPLIT = _TSPLIT.replace("o_custkey", "user_id").replace("o_orderdate", "ts").replace("FROM orders", "FROM events")

ORACLE["model_ready_fields"] = _with(_PATIENTS, _ESPLIT, """
tg AS (""" + ORACLE["targets"] + """),
mine AS (SELECT * FROM stat WHERE patient_id IN (SELECT patient_id FROM tsplit)),
fit AS (SELECT """ + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
    for c in _SCALED_COLS) + """
        FROM mine WHERE patient_id IN (SELECT patient_id FROM tsplit WHERE split = 'train'))""") + "\n" + "\nUNION ALL ".join(
    f"SELECT t.patient_id, t.split, 'static' AS field, {i} AS position, round(CAST(CAST("
    + (f"coalesce((m.{c} - fit.{c}_m) / fit.{c}_s, 0.0)" if c in _SCALED_COLS else f"m.{c}")
    + " AS FLOAT) AS DOUBLE), 4) AS value FROM tsplit t JOIN mine m USING (patient_id), fit" for i, c in enumerate(_ALL_STATIC)) + """
UNION ALL SELECT patient_id, split, 'time_index', h, CAST(h AS DOUBLE) FROM tsplit, range(0, 720) AS r(h)
UNION ALL SELECT patient_id, split, 'sequence_length', 0, 720.0 FROM tsplit
""" + "\n".join(f"UNION ALL SELECT t.patient_id, t.split, '{c}', 0, round(CAST(CAST(tg.{c} AS FLOAT) AS DOUBLE), 4) FROM tsplit t "
                f"JOIN tg USING (patient_id)" for c in ("mortality_risk", "icu_admission", "ventilator_need", "length_of_stay"))

_SCALED_CELLS = """
raw AS (""" + ORACLE["temporal_channels"] + """),
n AS (SELECT count(*) * 720.0 AS n FROM tsplit WHERE split = 'train'),
fit AS (SELECT c.ch, coalesce(sum(r.value), 0) / max(n.n) AS m,
               sqrt(greatest(coalesce(sum(r.value * r.value), 0) / max(n.n)
                             - (coalesce(sum(r.value), 0) / max(n.n)) ** 2, 0)) AS s
        FROM n, range(0, 18) AS c(ch) LEFT JOIN (SELECT * FROM raw WHERE patient_id IN (
          SELECT patient_id FROM tsplit WHERE split = 'train')) r ON r.ch = c.ch GROUP BY c.ch),
z0 AS (SELECT ch, m, CASE WHEN s > 0 THEN s ELSE 1 END AS s, -m / CASE WHEN s > 0 THEN s ELSE 1 END AS z0 FROM fit),
z AS (SELECT raw.*, (value - m) / s AS z, z0 FROM raw JOIN z0 USING (ch)),
k AS (SELECT *, CAST(round(CAST(CAST(z AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS k,
             CAST(round(CAST(CAST(z0 AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS k0 FROM z)"""

ORACLE["model_ready_cells"] = _with(_ESPLIT, _SCALED_CELLS, """
base AS (SELECT ch, sum((h * 7919 + 13) % 10007) * CAST(round(CAST(CAST(z0 AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS d
         FROM z0, range(0, 720) AS r(h) GROUP BY ch, z0),
more AS (SELECT patient_id, ch, count(*) FILTER (WHERE abs(z - z0) > 1e-5) AS filled,
                sum((hour_idx * 7919 + 13) % 10007 * (k - k0)) AS d FROM k GROUP BY 1, 2)""") + """
SELECT t.patient_id, CAST(b.ch AS INTEGER) AS ch, 720 AS hours, 18 AS channels, coalesce(m.filled, 0) AS filled,
       CAST(b.d + coalesce(m.d, 0) AS BIGINT) AS digest
FROM tsplit t, base b LEFT JOIN more m ON m.patient_id = t.patient_id AND m.ch = b.ch"""

_TARGET_COLUMNS = ("mortality_risk", "icu_admission", "ventilator_need", "length_of_stay")

ORACLE["batch_members"] = _with(_PATIENTS, _ESPLIT, _SCALED_CELLS, """
tg AS (""" + ORACLE["targets"] + """),
mine AS (SELECT * FROM stat WHERE patient_id IN (SELECT patient_id FROM tsplit)),
sfit AS (SELECT """ + ", ".join(
    f"avg({c}) AS {c}_m, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS {c}_s"
    for c in _SCALED_COLS) + """
        FROM mine WHERE patient_id IN (SELECT patient_id FROM tsplit WHERE split = 'train')),
st AS (SELECT m.patient_id, """ + " + ".join(
    f"{(i * 7919 + 13) % 10007} * CAST(round(CAST(CAST("
    + (f"coalesce((m.{c} - sfit.{c}_m) / sfit.{c}_s, 0.0)" if c in _SCALED_COLS else f"m.{c}")
    + " AS FLOAT) AS DOUBLE) * 1000) AS BIGINT)" for i, c in enumerate(_ALL_STATIC)) + """ AS static_digest FROM mine m, sfit),
base AS (SELECT sum(((h * 18 + ch) * 7919 + 13) % 10007 * CAST(round(CAST(CAST(z0 AS FLOAT) AS DOUBLE) * 1000) AS BIGINT)) AS d
         FROM z0, range(0, 720) AS r(h)),
more AS (SELECT patient_id, sum(((hour_idx * 18 + ch) * 7919 + 13) % 10007 * (k - k0)) AS d FROM k GROUP BY 1),
ti AS (SELECT sum((h * 7919 + 13) % 10007 * h * 1000) AS d FROM range(0, 720) AS r(h)),
r AS (SELECT patient_id, split, row_number() OVER (PARTITION BY split ORDER BY
             CASE WHEN split = 'train' THEN md5(patient_id || ':42') ELSE '' END, patient_id) - 1 AS rn FROM tsplit)""") + """
SELECT split, rn // 32 AS batch_id, CAST(count(*) OVER (PARTITION BY split, rn // 32) AS INTEGER) AS batch_len,
       CAST(rn % 32 AS INTEGER) AS position, r.patient_id, CAST(720 AS BIGINT) AS sequence_length,
       """ + ", ".join(f"round(CAST(CAST(tg.{c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in _TARGET_COLUMNS) + """,
       15 AS static_size, 720 AS temporal_size, 720 AS time_index_size, CAST(st.static_digest AS BIGINT) AS static_digest,
       CAST(base.d + coalesce(more.d, 0) AS BIGINT) AS temporal_digest, CAST(ti.d AS BIGINT) AS time_index_digest
FROM r JOIN tg USING (patient_id) JOIN st USING (patient_id) LEFT JOIN more USING (patient_id), base, ti"""

ORACLE["feature_catalogue"] = _with(_PATIENTS) + """
SELECT k.kind, CAST(k.position AS INTEGER) AS position, k.name, round(CASE k.name """ + " ".join(
    f"WHEN '{c}' THEN (SELECT avg({c}) FROM stat)" for c in _ALL_STATIC) + """ ELSE 0.0 END, 6) AS mean
FROM (VALUES """ + ", ".join([f"('static', {i}, '{c}')" for i, c in enumerate(_ALL_STATIC)] + [
    f"('temporal', {i}, '{c}')" for i, c in enumerate(
        ["vital_signs:" + t for t in ("temperature", "heart_rate", "blood_pressure_systolic", "blood_pressure_diastolic",
                                      "oxygen_saturation", "respiratory_rate")]
        + ["laboratory_values:" + t for t in ("crp", "d_dimer", "white_blood_cells", "platelets", "lymphocytes", "neutrophils",
                                              "creatinine", "troponin")]
        + ["medications:" + t for t in ("remdesivir", "dexamethasone", "tocilizumab", "supportive_care", "anticoagulants")]
        + ["procedures:" + t for t in ("intubation", "mechanical_ventilation", "diagnostic_tests", "imaging_studies")]
        + ["devices:" + t for t in ("ventilator_settings", "monitoring_equipment", "life_support")])] + [
    f"('target', {i}, '{c}')" for i, c in enumerate(("mortality_risk", "icu_admission", "ventilator_need", "length_of_stay"))]) + """
) AS k(kind, position, name)"""
