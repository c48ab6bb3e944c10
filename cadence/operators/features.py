"""Static, derived and scaled features.

Every feature is a named DOUBLE column of a one-row-per-patient frame; the
15-slot vector order is ``STATIC_FEATURES``. Label codes follow the sorted
class lists (F=0, M=1, Unknown=2; ...). Unseen or null categories map to
``Unknown`` instead of failing the run.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import (COMORBIDITIES, ETHNICITY_CLASSES, GENDER_CLASSES, HEALTHCARE_COVERAGE,
                               INCOME_LEVEL, RACE_CLASSES, SCALED_STATIC, STATIC_FEATURES, Vocab, any_keyword)

DEFAULT_AS_OF = dt.date(2025, 1, 1)


def encode(c, classes) -> F.Column:
    """Code of ``c`` in the sorted class list; unseen/null -> code of 'Unknown'."""
    unknown = classes.index("Unknown")
    expr = F.when(F.lit(False), F.lit(0.0))
    for i, k in enumerate(classes):
        expr = expr.when(c == F.lit(k), F.lit(float(i)))
    return expr.otherwise(F.lit(float(unknown)))


def age_years(birthdate, as_of: dt.date = DEFAULT_AS_OF) -> F.Column:
    """F1: whole days since birth / 365.25 at ``as_of``; unknown -> 0.0."""
    return F.coalesce(F.datediff(F.lit(as_of), birthdate) / F.lit(365.25), F.lit(0.0))


def demographics(patients: DataFrame, as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """F1 + F5 (+ F14 metadata columns)."""
    return patients.select(
        "patient_id",
        age_years(F.col("birthdate"), as_of).alias("age"),
        encode(F.col("gender"), GENDER_CLASSES).alias("gender"),
        encode(F.col("race"), RACE_CLASSES).alias("race"),
        encode(F.col("ethnicity"), ETHNICITY_CLASSES).alias("ethnicity"))


def patient_metadata(patients: DataFrame) -> DataFrame:
    """id, birth date, gender, race, ethnicity (the reference stores the
    birth date under the name "age"; here it keeps its own name)."""
    return patients.select("patient_id", "birthdate", "gender", "race", "ethnicity")


def encoding_issues(patients: DataFrame) -> DataFrame:
    """Quality side table for D21: rows whose category had to become Unknown."""
    parts = []
    for colname, classes in (("gender", GENDER_CLASSES), ("race", RACE_CLASSES), ("ethnicity", ETHNICITY_CLASSES)):
        bad = ~F.coalesce(F.col(colname).isin(*classes), F.lit(False))
        parts.append(patients.where(bad).select("patient_id", F.lit(colname).alias("attribute"),
                                                F.col(colname).alias("raw_value")))
    return reduce(DataFrame.unionByName, parts)


def comorbidity_flags(patients: DataFrame, conditions: DataFrame, vocab: Vocab = COMORBIDITIES) -> DataFrame:
    """1.0 when any condition text of the patient matches the type."""
    desc = F.col("description")
    flags = conditions.where(any_keyword(desc, vocab.all_keywords(), vocab.mode)).groupBy("patient_id").agg(
        *[F.max(any_keyword(desc, kws, vocab.mode).cast("double")).alias(t) for t, kws in vocab.types])
    out = patients.select("patient_id").join(flags.hint("merge"), "patient_id", "left")
    return out.select("patient_id", *[F.coalesce(F.col(t), F.lit(0.0)).alias(t) for t in vocab.type_names])


def age_group(age) -> F.Column:
    """<18 -> 0, <50 -> 1, <65 -> 2, else 3."""
    return (F.when(age < 18, 0.0).when(age < 50, 1.0).when(age < 65, 2.0).otherwise(3.0))


def _derived_columns(names) -> list[F.Column]:
    """F2-F4 from ``age`` and the comorbidity flag columns."""
    cnt = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return [F.when(F.col("age") > 65, 1.0).otherwise(0.0).alias("age_risk"), age_group(F.col("age")).alias("age_group"),
            cnt.alias("comorbidity_count"), F.when(cnt >= 2, 1.0).otherwise(0.0).alias("high_comorbidity")]


def derived(static: DataFrame, comorbidity_names=None) -> DataFrame:
    """F2-F4 on a frame with ``age`` and the comorbidity flag columns."""
    return static.select("patient_id", *_derived_columns(comorbidity_names or COMORBIDITIES.type_names))


def static_features(patients: DataFrame, conditions: DataFrame, vocab: Vocab = COMORBIDITIES,
                    as_of: dt.date = DEFAULT_AS_OF) -> DataFrame:
    """F18 + F17: the 15 static features, named, in vector order, with one
    join (patients x per-patient comorbidity flags). The comorbidity columns
    keep the fixed slot names whatever vocabulary is bound to them (slot i <-
    vocabulary type i)."""
    slot_names = COMORBIDITIES.type_names
    desc = F.col("description")
    flags = conditions.where(any_keyword(desc, vocab.all_keywords(), vocab.mode)).groupBy("patient_id").agg(
        *[F.max(any_keyword(desc, kws, vocab.mode).cast("double")).alias(s)
          for (_, kws), s in zip(vocab.types, slot_names)])
    base = patients.select(
        "patient_id", age_years(F.col("birthdate"), as_of).alias("age"),
        encode(F.col("gender"), GENDER_CLASSES).alias("gender"), encode(F.col("race"), RACE_CLASSES).alias("race"),
        encode(F.col("ethnicity"), ETHNICITY_CLASSES).alias("ethnicity"),
        F.lit(HEALTHCARE_COVERAGE).alias("healthcare_coverage"), F.lit(INCOME_LEVEL).alias("income_level"))
    x = base.join(flags.hint("merge"), "patient_id", "left").select(
        "patient_id", "age", "gender", "race", "ethnicity",
        *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in slot_names], "healthcare_coverage", "income_level")
    return x.select("*", *_derived_columns(slot_names)).select("patient_id", *STATIC_FEATURES)


def fit_standard_scaler(train: DataFrame, cols=SCALED_STATIC) -> DataFrame:
    """F7 fit: one row of per-column mean and population std (std 0 -> 1),
    computed on the training split only."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    fitted = train.agg(*aggs)
    return fitted.select(*[F.coalesce(F.col(f"{c}__mean"), F.lit(0.0)).alias(f"{c}__mean") for c in cols],
                         *[F.when(F.coalesce(F.col(f"{c}__std"), F.lit(0.0)) == 0, 1.0)
                            .otherwise(F.col(f"{c}__std")).alias(f"{c}__std") for c in cols])


def scaler_params(fitted: DataFrame, cols=SCALED_STATIC) -> dict[str, tuple[float, float]]:
    """Bring the one-row fitted state to the driver (2 numbers per column)."""
    row = fitted.first().asDict()
    return {c: (float(row[f"{c}__mean"]), float(row[f"{c}__std"])) for c in cols}


def apply_standard_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """F7 transform + F9: (x - mean) / std as literals, NaN/NULL -> 0."""
    for c, (mean, std) in params.items():
        z = (F.col(c) - F.lit(mean)) / F.lit(std)
        df = df.withColumn(c, F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(0.0)))
    return df
