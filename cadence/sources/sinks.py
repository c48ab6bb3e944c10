"""Sinks: reports as JSON (S5, S6, S7) and fitted state as Parquet.

Reports are DataFrames written by the executors (``df.write.json``): dates
become ISO strings and numbers stay numbers without a driver-side
serialisation pass. Fitted state is small (a few numbers per feature) and
round-trips through a one-partition Parquet table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def write_report(tables: dict[str, DataFrame], directory: str) -> dict[str, str]:
    """One JSON-lines folder per report table; returns the paths."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(directory, name)
        df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
        out[name] = path
    return out


def save_state(spark: SparkSession, state: dict[str, dict], path: str) -> None:
    """S8 save: ``{group: {key: (mean, std)}}`` -> rows (group, key, mean, std)."""
    rows = [(g, str(k), float(m), float(s)) for g, d in state.items() for k, (m, s) in d.items()]
    spark.createDataFrame(rows, "grp string, key string, mean double, std double") \
         .coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> dict[str, dict]:
    """S8 load: inverse of ``save_state`` (integer-looking keys come back as int)."""
    out: dict[str, dict] = {}
    for r in spark.read.parquet(path).collect():  # bounded: a few rows per feature
        k = int(r["key"]) if r["key"].isdigit() else r["key"]
        out.setdefault(r["grp"], {})[k] = (r["mean"], r["std"])
    return out
