"""Irregular (event-time) timelines and fixed-length sequences.

A8 / O2: per patient, the sorted distinct event timestamps with positions,
kept long ``(patient_id, pos, ts, per-kind counts)``; positions come from the
skew-safe ``ranked`` (no per-patient task).

F10 / O5 / F13: keep the most recent ``n`` values of each patient (tail
truncation), in time order, zero-padded at the end. The top-n per patient is
``row_number() <= n`` which Spark plans with a partial group limit before
the shuffle, so at most ``n`` rows per patient leave each map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def event_time_timeline(kinds: dict[str, DataFrame]) -> DataFrame:
    """``kinds``: name -> frame with ``patient_id, ts``. Returns one row per
    distinct (patient, ts) with its 1-based position and record counts."""
    parts = [df.select("patient_id", "ts", F.lit(k).alias("kind")) for k, df in kinds.items()]
    allrec = reduce(DataFrame.unionByName, parts).where(F.col("ts").isNotNull())
    counts = allrec.groupBy("patient_id", "ts").agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    return ranked(counts, ["patient_id"], ["ts"], "pos")


def event_time_records(kinds: dict[str, DataFrame]) -> DataFrame:
    """A8 with its records: ``kinds`` frames have ``patient_id, ts,
    description``; every dated record with the 1-based position of its
    timestamp among the patient's distinct timestamps."""
    rec = reduce(DataFrame.unionByName, [df.select("patient_id", "ts", F.lit(k).alias("kind"), "description")
                                         for k, df in kinds.items()]).where(F.col("ts").isNotNull())
    pos = ranked(rec.select("patient_id", "ts").distinct(), ["patient_id"], ["ts"], "pos").select(
        F.col("patient_id").alias("_p"), F.col("ts").alias("_t"), "pos")
    return rec.join(pos, rec.patient_id.eqNullSafe(pos["_p"]) & (rec.ts == pos["_t"])).select(
        "patient_id", "pos", "ts", "kind", "description")


def tail_sequences(values: DataFrame, patients: DataFrame, n: int, order: list[str], value: str = "value") -> DataFrame:
    """Most recent ``n`` values per patient as rows ``(patient_id, pos, value,
    is_pad, sequence_length)``: positions 1..n in time order, zeros after the
    real values; patients without values get ``n`` padding rows and
    ``sequence_length`` 0 (F13)."""
    w = Window.partitionBy("patient_id").orderBy(*[F.col(c).desc() for c in order])
    top = values.withColumn("_rd", F.row_number().over(w)).where(F.col("_rd") <= n)
    kept = top.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_kept"))
    real = top.join(kept, "patient_id").select(
        "patient_id", (F.col("_kept") - F.col("_rd") + 1).alias("pos"), F.col(value).cast("double").alias("value"),
        F.lit(0).alias("is_pad"), F.col("_kept").alias("sequence_length"))
    base = patients.select("patient_id").join(kept, "patient_id", "left").select(
        "patient_id", F.coalesce(F.col("_kept"), F.lit(0)).alias("_kept"))
    pads = base.where(F.col("_kept") < n).select(
        "patient_id", F.explode(F.sequence(F.col("_kept") + 1, F.lit(n))).alias("pos"), F.lit(0.0).alias("value"),
        F.lit(1).alias("is_pad"), F.col("_kept").alias("sequence_length"))
    return real.unionByName(pads)
