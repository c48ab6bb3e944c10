"""Data-quality operators.

Everything is a grouped aggregate over role frames keyed by ``patient_id``;
per-patient results are joined on that key, never gathered per patient.
Thresholds and the reference date are parameters (no wall clock).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import checkpointed, join_null_safe, running_sums

FLAG_LIMIT = 0.2     # configured "high missing" flag
REJECT_LIMIT = 0.8   # literal cut-off that invalidates a patient
LONG_PERIOD_DAYS = 730
EXPECTED_DAYS = 30


def _nulls(cols) -> F.Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in cols])


def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Q9: ``(table_name, column_name, null_count)``, one aggregate per table."""
    parts = []
    for name, df in tables.items():
        cols = [c for c in df.columns if c != "_corrupt_record"]
        agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("null_count"))
                          for c in cols])
        parts.append(agg.select(F.lit(name).alias("table_name"), F.inline(cells)))
    return reduce(DataFrame.unionByName, parts)


#: What a text column may hold throughout, as the reference's reader infers column types.
INTEGER_TEXT, NUMBER_TEXT = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_TEXT = ("True", "TRUE", "true", "False", "FALSE", "false")


def dtype_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Q10: ``(table_name, column_name, data_type, n_values, inferred_type)``, one aggregate per table.

    ``inferred_type`` is the type that a reader of untyped files finds from a column's values: integers with
    missing values are floats, a column of missing values too, text is integer, number or boolean only if
    every value is.
    """
    def counts(f: T.StructField) -> F.Column:
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, T.StringType)
        holds = [F.count_if(c.rlike(INTEGER_TEXT)), F.count_if(c.rlike(NUMBER_TEXT)), F.count_if(c.isin(*BOOLEAN_TEXT))] if text \
            else [F.lit(0).cast("long")] * 3
        return F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                        F.count(c).alias("n"), *[h.alias(a) for h, a in zip(holds, ("ints", "numbers", "booleans"))])

    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if f.name != "_corrupt_record"]
        agg = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[counts(f) for f in fields]).alias("cells"))
        parts.append(agg.select(F.lit(name).alias("table_name"), "rows", F.inline("cells")))
    x = reduce(DataFrame.unionByName, parts)
    kind, n, full = F.col("data_type"), F.col("n"), F.col("n") == F.col("rows")
    whole = F.when(full, "int64").otherwise("float64")
    truth = F.when(full, "bool").otherwise("object")
    inferred = (F.when(n == 0, F.when(F.col("rows") == 0, "object").otherwise("float64"))
                .when(kind.isin("tinyint", "smallint", "int", "bigint") | (F.col("ints") == n), whole)
                .when(kind.isin("float", "double") | (F.col("numbers") == n), "float64")
                .when((kind == "boolean") | (F.col("booleans") == n), truth)
                .when(kind.isin("date", "timestamp", "timestamp_ntz"), "datetime64").otherwise("object"))
    return x.select("table_name", "column_name", "data_type", n.alias("n_values"), inferred.alias("inferred_type"))


def missing_by_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1 per table: null cells and cells of each patient's slice of each table."""
    return reduce(DataFrame.unionByName, [
        df.groupBy("patient_id").agg(F.sum(_nulls(df.columns)).cast("long").alias("missing_cells"),
                                     (F.count(F.lit(1)) * F.lit(len(df.columns))).cast("long").alias("total_cells"))
        .select("patient_id", F.lit(name).alias("table_name"), "missing_cells", "total_cells")
        for name, df in tables.items()])


def missing_by_patient(tables: dict[str, DataFrame], patients: DataFrame | None = None,
                       flag_limit: float = FLAG_LIMIT, reject_limit: float = REJECT_LIMIT) -> DataFrame:
    """Q1 + Q6 + P8: per patient, null cells / all cells over the patient's
    non-empty table slices (every column counts, the id included)."""
    cells = missing_by_table(tables).groupBy("patient_id").agg(
        F.sum("missing_cells").alias("missing_cells"), F.sum("total_cells").alias("total_cells"))
    if patients is not None:
        cells = patients.select("patient_id").join(cells, "patient_id", "left")
    m = F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long")
    t = F.coalesce(F.col("total_cells"), F.lit(0)).cast("long")
    share = F.when(t > 0, m / t).otherwise(F.lit(0.0))
    return cells.select(
        "patient_id", m.alias("missing_cells"), t.alias("total_cells"), share.alias("missing_share"),
        F.when(t > 0, (t - m) / t).otherwise(F.lit(0.0)).alias("completeness"),
        (share > flag_limit).alias("high_missing"), (share <= reject_limit).alias("is_valid"))


#: Values of a group up to which one task orders them as an array (0.8 MB of numbers).
ARRAY_VALUES = 100_000


def iqr_outliers(long: DataFrame, group: list[str], value: str = "v", array_values: int = ARRAY_VALUES) -> DataFrame:
    """Q2: per group, linear-interpolated quartiles (as pandas ``quantile``)
    and the number of values strictly outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR].

    Exact and skew-safe. Groups are counted first. Those of up to ``array_values`` values are gathered by one shuffle,
    each ordered as an array that gives its quartiles and outliers; larger ones go through ``_iqr_by_ranks``.
    Rows whose keys are NULL are a group like any other.
    """
    vals = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    hot = checkpointed(vals.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > array_values).select(*group))
    if hot.isEmpty():
        return _iqr_by_arrays(vals, group, value)
    keys = F.broadcast(hot.select(*[F.col(g).alias(f"_h_{g}") for g in group]))  # one row for each ``array_values`` rows at most
    same = [F.col(g).eqNullSafe(F.col(f"_h_{g}")) for g in group]
    return _iqr_by_arrays(vals.join(keys, same, "left_anti"), group, value).unionByName(
        _iqr_by_ranks(vals.join(keys, same, "left_semi"), group, value))


def _iqr_by_arrays(vals: DataFrame, group: list[str], value: str) -> DataFrame:
    """``iqr_outliers`` of groups that one task can hold."""
    x = vals.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias("_vs"))

    def quantile(q: float) -> F.Column:
        pos = (F.size("_vs") - 1) * F.lit(q)
        lo, hi = (F.get("_vs", e(pos).cast("int")) for e in (F.floor, F.ceil))
        return lo + (hi - lo) * (pos - F.floor(pos))
    x = x.select(*group, "_vs", quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    x = x.select(*group, "_vs", "q1", "q3", (F.col("q1") - reach).alias("_lo"), (F.col("q3") + reach).alias("_hi"))
    out = F.size(F.filter("_vs", lambda v: (v < F.col("_lo")) | (v > F.col("_hi")))).cast("long")
    return x.select(*group, "q1", "q3", out.alias("n_outliers"))


def _iqr_by_ranks(vals: DataFrame, group: list[str], value: str) -> DataFrame:
    """``iqr_outliers`` of groups of any size: values are first
    collapsed to (group, value, count) by a map-side-combined aggregation, and
    everything after reads the materialised running counts;
    running counts over the distinct values (``running_sums``: range
    partitioned, so a hot group spans many tasks) locate the four order
    statistics each group needs; outliers are counted on the collapsed rows.
    """
    cnt = vals.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = checkpointed(running_sums(cnt, group, value, ["_c"], prefix="_cum"))
    n = cum.groupBy(*group).agg(F.sum("_c").alias("_n"))
    # one row per group with the four 1-based ranks it needs
    cols = []
    for q, tag in ((0.25, "q1"), (0.75, "q3")):
        pos = (F.col("_n") - 1) * F.lit(q)
        cols += [(F.floor(pos) + 1).alias(f"_{tag}lo"), (F.ceil(pos) + 1).alias(f"_{tag}hi"),
                 (pos - F.floor(pos)).alias(f"_{tag}f")]
    need = n.select(*group, *cols)
    # the value at rank r is the distinct value whose count range (cum - c, cum] holds r
    holds = lambda r: (F.col("_cum_c") - F.col("_c") < F.col(r)) & (F.col(r) <= F.col("_cum_c"))
    picked = join_null_safe(cum, need, group).groupBy(*group).agg(
        *[F.max(F.when(holds(f"_{t}{e}"), F.col(value))).alias(f"_v{t}{e}") for t in ("q1", "q3") for e in ("lo", "hi")],
        F.max("_q1f").alias("_q1f"), F.max("_q3f").alias("_q3f"))
    interp = lambda t: F.col(f"_v{t}lo") + (F.col(f"_v{t}hi") - F.col(f"_v{t}lo")) * F.col(f"_{t}f")
    bounds = picked.select(*group, interp("q1").alias("q1"), interp("q3").alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    out = join_null_safe(cum, bounds, group).groupBy(*group).agg(
        F.sum(F.when((F.col(value) < lo) | (F.col(value) > hi), F.col("_c")).otherwise(0)).alias("n_outliers"))
    return join_null_safe(bounds, out, group)


def numeric_columns(df: DataFrame) -> list[str]:
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("(")[0] in numeric]


def unpivot_numeric(df: DataFrame, entity: str, columns: list[str] | None = None) -> DataFrame:
    """Long ``(patient_id, column_name, v)`` over the numeric columns (D17:
    default every numeric column, codes included)."""
    cols = columns or numeric_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.col(entity).alias("patient_id"), F.inline(cells))


def temporal_consistency(observations: DataFrame, patients: DataFrame, as_of: dt.datetime,
                         long_days: int = LONG_PERIOD_DAYS) -> DataFrame:
    """Q3 + P4 + P9: valid dates, dates after ``as_of``, span over
    ``long_days``, score = (valid - future) / valid (1.0 without dates)."""
    agg = observations.groupBy("patient_id").agg(
        F.count("ts").alias("n_valid"),
        F.count_if(F.col("ts") > F.lit(as_of)).alias("n_future"),
        F.min("ts").alias("_mn"), F.max("ts").alias("_mx"))
    x = patients.select("patient_id").join(agg, "patient_id", "left")
    nv = F.coalesce(F.col("n_valid"), F.lit(0))
    nf = F.coalesce(F.col("n_future"), F.lit(0))
    span_us = F.timestamp_diff("MICROSECOND", F.col("_mn"), F.col("_mx"))
    return x.select(
        "patient_id", nv.alias("n_valid"), nf.alias("n_future"),
        F.coalesce(span_us > F.lit(long_days * 86_400_000_000), F.lit(False)).alias("long_period"),
        F.when(nv > 0, (nv - nf) / nv).otherwise(F.lit(1.0)).alias("consistency_score"))


def temporal_coverage(observations: DataFrame, patients: DataFrame, expected_days: int = EXPECTED_DAYS) -> DataFrame:
    """Q7: min((whole days of the observation span + 1) / expected, 1); 0 without observations."""
    agg = observations.where(F.col("ts").isNotNull()).groupBy("patient_id").agg(
        F.min("ts").alias("_mn"), F.max("ts").alias("_mx"))
    days = F.floor(F.timestamp_diff("SECOND", F.col("_mn"), F.col("_mx")) / F.lit(86400))
    # least() skips NULLs, so guard the no-observation case explicitly
    cov = F.when(days.isNotNull(), F.least((days + 1) / F.lit(float(expected_days)), F.lit(1.0)))
    return patients.select("patient_id").join(agg, "patient_id", "left").select(
        "patient_id", F.coalesce(cov, F.lit(0.0)).alias("temporal_coverage"))


def outliers_by_patient(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2 per patient, as the validator runs it: IQR outliers of every numeric
    column of every table slice of the patient, summed per patient."""
    parts = [unpivot_numeric(df, "patient_id").select(
                 "patient_id", F.concat(F.lit(f"{name}."), F.col("column_name")).alias("column_name"), "v")
             for name, df in tables.items() if numeric_columns(df)]
    if not parts:
        any_df = next(iter(tables.values()))
        return any_df.select("patient_id", F.lit(0).cast("long").alias("n_outliers")).where(F.lit(False))
    per = iqr_outliers(reduce(DataFrame.unionByName, parts), ["patient_id", "column_name"])
    return per.groupBy("patient_id").agg(F.sum("n_outliers").alias("n_outliers"))


def patient_issues(missing: DataFrame, consistency: DataFrame, outliers_per_patient: DataFrame | None,
                   n_observations: DataFrame, patients: DataFrame | None = None,
                   seen_ids: DataFrame | None = None) -> DataFrame:
    """Q4: long ``(patient_id, code, detail, fatal)``; a patient is valid iff it
    has no fatal issue. Date warnings are emitted (D15). With ``patients`` and
    ``seen_ids`` (ids found in any table), ids without a patients row are
    reported too."""
    wide = n_observations.select("patient_id", "n_obs").join(
        consistency.select("patient_id", "n_valid", "n_future", "long_period", "n_obs_rows"), "patient_id", "full").join(
        missing.select("patient_id", "is_valid", "missing_share"), "patient_id", "full")
    lost = F.lit(False)
    if patients is not None and seen_ids is not None:
        wide = wide.join(seen_ids.select("patient_id").distinct().withColumn("_seen", F.lit(True)), "patient_id", "full").join(
            patients.select("patient_id").distinct().withColumn("_known", F.lit(True)), "patient_id", "full")
        lost = F.col("_seen").isNotNull() & F.col("_known").isNull()
    outliers = F.lit(None).cast("long")
    if outliers_per_patient is not None:
        wide = wide.join(outliers_per_patient.select("patient_id", "n_outliers"), "patient_id", "full")
        outliers = F.col("n_outliers")
    rules = [  # each input is read once: one wide row per patient, one issue per rule that holds
        ("no_observations", F.col("n_obs") == 0, F.lit("No observations data")),
        ("no_valid_dates", (F.col("n_valid") == 0) & (F.col("n_obs_rows") > 0), F.lit("No valid dates found")),
        ("future_dates", F.col("n_future") > 0,
         F.format_string("Future dates detected: %d observations", F.col("n_future"))),
        ("long_period", F.col("long_period"), F.lit("Unusually long observation period")),
        ("high_missing", ~F.col("is_valid"),
         F.format_string("Very high missing values: %.2f%%", F.col("missing_share") * 100)),
        ("missing_patients_row", lost, F.lit("Missing required tables: ['patients']")),
        ("outliers", outliers > 0, F.format_string("Outliers detected: %d values", outliers)),
    ]
    found = F.filter(F.array(*[F.when(holds, F.struct(F.lit(code).alias("code"), text.alias("detail")))
                               for code, holds, text in rules]), lambda x: x.isNotNull())
    out = wide.select("patient_id", F.inline(found))
    return out.withColumn("fatal", F.col("code") == "high_missing")


def quality_summary(per_patient: DataFrame) -> DataFrame:
    """Q5: one row over a per-patient frame with ``is_valid, n_obs, n_enc,
    n_med, completeness, temporal_coverage``; averages over valid patients."""
    v = F.col("is_valid")
    n_valid = F.count_if(v)
    avg_valid = lambda c: F.sum(F.when(v, F.col(c))) / n_valid
    return per_patient.agg(
        F.count(F.lit(1)).alias("total_patients"), n_valid.alias("valid_patients"),
        F.count_if(~v).alias("invalid_patients"),
        avg_valid("n_obs").alias("avg_observations_per_patient"),
        avg_valid("n_enc").alias("avg_encounters_per_patient"),
        avg_valid("n_med").alias("avg_medications_per_patient"),
        avg_valid("completeness").alias("data_completeness"),
        avg_valid("temporal_coverage").alias("temporal_coverage"))


# The reference's sentences, in the order of its rules.
RECOMMENDATIONS = ("Review and clean data for %d invalid patients",
                   "Consider collecting more patient data for robust model training",
                   "Implement data imputation strategies for missing values",
                   "Ensure adequate temporal coverage for all patients")


def recommendations(summary: DataFrame, min_patients: int = 100, min_completeness: float = 0.8,
                    min_coverage: float = 0.5) -> DataFrame:
    """Q8: threshold rules over the Q5 row, one recommendation per row."""
    recs = F.array(
        F.when(F.col("invalid_patients") > 0, F.format_string(RECOMMENDATIONS[0], F.col("invalid_patients"))),
        F.when(F.col("valid_patients") < min_patients, F.lit(RECOMMENDATIONS[1])),
        F.when(F.coalesce(F.col("data_completeness"), F.lit(1.0)) < min_completeness,
               F.lit(RECOMMENDATIONS[2])),
        F.when(F.coalesce(F.col("temporal_coverage"), F.lit(1.0)) < min_coverage,
               F.lit(RECOMMENDATIONS[3])))
    return summary.select(F.posexplode(F.filter(recs, lambda r: r.isNotNull())).alias("rank", "recommendation"))


def dataset_coverage(encounters: DataFrame) -> DataFrame:
    """Q11: first START, last STOP (D18: the end column is STOP) and whole days."""
    return encounters.agg(F.min("start").alias("start_date"), F.max("stop").alias("end_date")).select(
        "start_date", "end_date",
        F.floor(F.timestamp_diff("SECOND", F.col("start_date"), F.col("end_date")) / F.lit(86400)).cast("long")
        .alias("date_range_days"))


def table_summary(tables: dict[str, DataFrame], patient_key: dict[str, str] | None = None,
                  cohort: DataFrame | None = None) -> DataFrame:
    """Q12: rows, columns and distinct patients per table (0 without a patient
    column), and the size of the cohort; one aggregate per table."""
    keys = patient_key or {}
    size = F.lit(cohort.count() if cohort is not None else None).cast("long")
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), (F.countDistinct(keys[n]) if n in keys else F.lit(0).cast("long"))
                    .alias("patients")).select(
        F.lit(n).alias("table_name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), "patients",
        size.alias("cohort_patients")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Q13: counts per value of each attribute, nulls dropped."""
    parts = [df.where(F.col(a).isNotNull()).groupBy(F.col(a).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("attribute"), "value", "n") for a in attributes]
    return reduce(DataFrame.unionByName, parts)


def text_describe(df: DataFrame, column: str) -> DataFrame:
    """Q13: count / unique / top / freq of a column read as text (top = most
    frequent value, ties broken by the smaller value). Two aggregations, no
    join: top = min_by(value, (-freq, value))."""
    t = df.select(F.col(column).cast("string").alias("s")).where(F.col("s").isNotNull())
    freq = t.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    return freq.agg(F.sum("f").cast("long").alias("count"), F.count(F.lit(1)).cast("long").alias("unique"),
                    F.min_by("s", F.struct(-F.col("f"), F.col("s"))).alias("top"),
                    F.max("f").cast("long").alias("freq")).select(
        F.coalesce("count", F.lit(0)).alias("count"), "unique", "top", "freq")
