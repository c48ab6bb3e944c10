"""Cohort selection (P1, U1), restriction of tables to a cohort
and the deterministic cohort sample (S4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import COHORT_KEYWORDS, any_keyword
from .ranking import ranked


def cohort_ids(sources: list, keywords=COHORT_KEYWORDS, desc: str = "description") -> DataFrame:
    """Distinct ``patient_id`` with any row whose text matches the keyword
    alternation (case-insensitive regex search; null text never matches).
    Each source contributes a partially aggregated distinct set before the
    union, so the final distinct shuffles at most one row per patient and
    source partition. A source may be ``(frame, keywords)`` to override the
    keyword list for that table."""
    parts = []
    for s in sources:
        df, kws = s if isinstance(s, tuple) else (s, keywords)
        parts.append(df.where(any_keyword(F.col(desc), kws, "regex")).select("patient_id").distinct())
    return reduce(DataFrame.union, parts).distinct()


def restrict(table: DataFrame, cohort: DataFrame) -> DataFrame:
    """Rows of ``table`` whose patient is in the cohort
    (left-semi join; AQE broadcasts the cohort only when its measured size is
    under the broadcast threshold, otherwise a shuffled semi-join)."""
    return table.join(cohort.select("patient_id"), "patient_id", "left_semi")


def cohort_sample(cohort: DataFrame, start: int = 0, size: int | None = None) -> DataFrame:
    """The ``[start, start + size)`` slice of the cohort in id order
    (deterministic, unlike slicing an unordered set). A bounded slice is an
    ordered top-k (each task sends at most ``start + size`` ids);
    ``size=None`` keeps everything from ``start`` on, by the distributed rank,
    so no task gets the whole cohort."""
    ids = cohort.select("patient_id")
    if size is not None:
        return ids.orderBy("patient_id").limit(start + size).offset(start)
    return ranked(ids, [], ["patient_id"], "_pos").where(F.col("_pos") > start).select("patient_id")
