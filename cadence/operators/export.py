"""Model-ready export (F8, F10, F13, F15, S9, S10, W7, P11) and batch scoring.

The hourly channels stay sparse and long until the very end; the dense
``grid_len x 26`` matrix is built once per patient at export. Per-patient
collection is bounded by ``grid_len`` rows (the grid), never by the number
of raw events, so a patient with a third of all events still produces one
fixed-size row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocab import STATIC_FEATURES, TEMPORAL_CATEGORIES, Vocab, any_keyword
from . import timeline as tl

TARGETS = ("mortality_risk", "icu_admission", "ventilator_need", "length_of_stay")


def hourly_type_flags(points: DataFrame, anchors: DataFrame, vocab: Vocab, grid_len: int = tl.GRID_LEN,
                      step_hours: float = 1.0) -> DataFrame:
    """Per (patient, hour, type): 1.0 when a point event of the type lies within
    +/- 1 step of the hour. Long ``(patient_id, hour_idx, type_ord, value)``."""
    desc = F.col("description")
    flags = F.array(*[F.when(any_keyword(desc, kws, vocab.mode), F.lit(i)) for i, (_, kws) in enumerate(vocab.types)])
    pre = points.where(any_keyword(desc, vocab.all_keywords(), vocab.mode)).select(
        "patient_id", "ts", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("type_ord"))
    binned = tl.bin_points(pre, anchors, "ts", grid_len, step_hours)
    return binned.select("patient_id", "hour_idx", "type_ord").distinct().withColumn("value", F.lit(1.0))


def temporal_segments(roles, anchors: DataFrame, categories=TEMPORAL_CATEGORIES, grid_len: int = tl.GRID_LEN,
                      step_hours: float = 1.0) -> tuple[DataFrame, list[str]]:
    """the 26 temporal channels (feature vocabularies, category order) as
    sparse run-length segments ``(patient_id, ch, h_start, h_end, value)``:
    vitals / labs -> per-type hourly value (A1 rule), medications / devices ->
    1.0 while a type is active, procedures -> 1.0 when a type is within the
    hour's window. An interval stays one row, however long it lasts."""
    cats = dict(categories)
    names: list[str] = []
    offset = {}
    for cat, voc in categories:
        offset[cat] = len(names)
        names += [f"{cat}:{t}" for t in voc.type_names]
    parts = []
    valued = tl.hourly_values_multi(roles.observations, anchors,
                                    {"vital_signs": cats["vital_signs"], "laboratory_values": cats["laboratory_values"]},
                                    roles.value_is_numeric, grid_len, step_hours)
    point = lambda df: df.select("patient_id", "ch", F.col("hour_idx").alias("h_start"),
                                 F.col("hour_idx").alias("h_end"), "value")
    for cat in ("vital_signs", "laboratory_values"):
        voc = cats[cat]
        cells = F.array(*[F.struct(F.lit(offset[cat] + i).alias("ch"), F.col(f"{cat}__{t}").alias("value"))
                          for i, t in enumerate(voc.type_names)])
        parts.append(point(valued.select("patient_id", "hour_idx", F.inline(cells)).where(F.col("value").isNotNull())))
    for cat, frame in (("medications", roles.medications), ("devices", roles.devices)):
        voc = cats[cat]
        per_type = {f"{cat}:{i}": Vocab(f"{cat}:{t}", ((t, kws),), voc.mode) for i, (t, kws) in enumerate(voc.types)}
        seg = tl.active_segments_multi(frame, anchors, per_type, grid_len, step_hours)
        parts.append(seg.select("patient_id", (F.lit(offset[cat]) + F.split(F.col("channel"), ":").getItem(1).cast("int"))
                                .alias("ch"), "h_start", "h_end", F.lit(1.0).alias("value")))
    pr = hourly_type_flags(roles.procedures, anchors, cats["procedures"], grid_len, step_hours)
    parts.append(point(pr.select("patient_id", "hour_idx", (F.col("type_ord") + offset["procedures"]).alias("ch"), "value")))
    return reduce(DataFrame.unionByName, parts), names


def temporal_channels(roles, anchors: DataFrame, categories=TEMPORAL_CATEGORIES, grid_len: int = tl.GRID_LEN,
                      step_hours: float = 1.0) -> tuple[DataFrame, list[str]]:
    """F15 with one row per hour: ``(patient_id, hour_idx, ch, value)``."""
    seg, names = temporal_segments(roles, anchors, categories, grid_len, step_hours)
    return tl.expand_segments(seg).select("patient_id", "hour_idx", "ch", "value"), names


def fit_channel_scaler(segments: DataFrame, train_anchors: DataFrame, n_channels: int,
                       grid_len: int = tl.GRID_LEN) -> dict[int, tuple[float, float]]:
    """F8 fit on the training patients' zero-filled grids, from sums over
    segments: per channel mean and population std (std 0 -> 1). Returns the
    fitted state (2 numbers per channel) to the driver."""
    n = float(train_anchors.count() * grid_len)
    hours = (F.col("h_end") - F.col("h_start") + 1).cast("double")
    s = segments.join(train_anchors.select("patient_id"), "patient_id", "left_semi").groupBy("ch").agg(
        F.sum(F.col("value") * hours).alias("s1"), F.sum(F.col("value") * F.col("value") * hours).alias("s2"))
    got = {r["ch"]: (r["s1"] or 0.0, r["s2"] or 0.0) for r in s.collect()}  # <= n_channels rows
    out = {}
    for c in range(n_channels):
        s1, s2 = got.get(c, (0.0, 0.0))
        mean = s1 / n if n else 0.0
        var = max(s2 / n - mean * mean, 0.0) if n else 0.0
        std = var ** 0.5
        out[c] = (mean, std if std > 0 else 1.0)
    return out


#: Patients whose grids a task holds at once (75 KB each at 720 x 26).
GRID_PATIENTS = 64


def dense_matrix(segments: DataFrame, anchors: DataFrame, n_channels: int, grid_len: int = tl.GRID_LEN,
                 scaler: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Per patient ``temporal ARRAY<ARRAY<FLOAT>>[grid_len][n_channels]``,
    zero-filled (J5), optionally standard-scaled per channel (F8) with the
    scaled value of 0 used for empty cells; NaN/NULL -> 0 (F9).

    One shuffle by patient gathers its run-length segments (at most
    ``grid_len * n_channels``, however many events it has); tasks lay them over
    blank grids, a few patients at a time in Arrow batches. Neither hours nor cells
    are ever rows."""
    mean, std = (np.array([(scaler or {}).get(c, (0.0, 1.0))[i] for c in range(n_channels)]) for i in (0, 1))
    id_type = anchors.schema["patient_id"].dataType
    schema = T.StructType([T.StructField("patient_id", id_type), T.StructField("temporal", T.ArrayType(T.ArrayType(T.FloatType())))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), GRID_PATIENTS):
                part = batch.slice(at, GRID_PATIENTS)
                lists = part.column("segments")
                seg = lists.flatten()
                ch, start, end, value = (seg.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                counts = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                hours = (end - start + 1).astype(np.int64)
                first = np.repeat(np.cumsum(hours) - hours, hours)
                grid = np.zeros((len(part), grid_len, n_channels))
                grid[np.repeat(np.repeat(np.arange(len(part)), counts), hours),
                     np.repeat(start, hours) + np.arange(hours.sum()) - first, np.repeat(ch, hours)] = np.repeat(value, hours)
                cells = np.nan_to_num((grid - mean) / std, nan=0.0, posinf=np.inf, neginf=-np.inf).astype(np.float32)
                rows = pa.ListArray.from_arrays(np.arange(len(part) * grid_len + 1, dtype=np.int32) * n_channels, pa.array(cells.ravel()))
                temporal = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * grid_len, rows)
                yield pa.RecordBatch.from_arrays([part.column("patient_id"), temporal], names=["patient_id", "temporal"])

    seg = F.struct(F.col("ch").cast("int"), F.col("h_start").cast("int"), F.col("h_end").cast("int"), F.col("value").cast("double"))
    per = segments.where(F.col("value").isNotNull() & (F.col("ch") < n_channels)).groupBy("patient_id").agg(
        F.collect_list(seg).alias("segments"))
    return anchors.select("patient_id").join(per.hint("merge"), "patient_id", "left").select("patient_id", "segments").mapInArrow(fill, schema)


def pad_or_truncate(arr_col, length: int, width: int | None = None) -> F.Column:
    """Keep the last ``length`` rows when longer, else zero-pad at the
    end; with ``width`` also cut / pad each inner row to ``width``."""
    a = F.when(F.size(arr_col) > length, F.slice(arr_col, -length, length)).otherwise(arr_col)
    if width is not None:
        zero_row = F.array_repeat(F.lit(0.0).cast("float"), width)
        a = F.transform(a, lambda r: F.concat(F.slice(r, 1, width),
                                              F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), width - F.size(r)))))
        pad = F.array_repeat(zero_row, F.greatest(F.lit(0), length - F.size(a)))
    else:
        pad = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), length - F.size(a)))
    return F.concat(a, pad)


def model_ready(static: DataFrame, temporal: DataFrame, targets: DataFrame, split: DataFrame,
                grid_len: int = tl.GRID_LEN, n_channels: int = 26, step_hours: float = 1.0) -> DataFrame:
    """S9 rows: patient_id, split, static ARRAY<FLOAT>[15], temporal
    [grid_len][n_channels], time_index [grid_len] (hours since t0),
    sequence_length, and the four FLOAT targets. Patients without a timeline
    get the all-zero default (F13, sequence_length 0)."""
    st = static.select("patient_id", F.array(*[F.col(c).cast("float") for c in STATIC_FEATURES]).alias("static"))
    # matrices of mostly equal cells shrink in files and shuffles, so a join chosen by size would broadcast them
    x = split.select("patient_id", "split").join(st, "patient_id", "left").join(targets, "patient_id", "left") \
             .join(temporal.hint("merge"), "patient_id", "left")
    has = F.col("temporal").isNotNull()
    shaped = (F.size("temporal") == grid_len) & F.forall("temporal", lambda r: F.size(r) == n_channels)
    zero_static = F.array_repeat(F.lit(0.0).cast("float"), len(STATIC_FEATURES))
    zero_temporal = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), n_channels), grid_len)
    steps = F.transform(F.sequence(F.lit(0), F.lit(grid_len - 1)), lambda i: (i * F.lit(float(step_hours))).cast("float"))
    return x.select(
        "patient_id", "split", F.coalesce(F.col("static"), zero_static).alias("static"),
        F.when(shaped, F.col("temporal")).when(has, pad_or_truncate(F.col("temporal"), grid_len, n_channels))
        .otherwise(zero_temporal).alias("temporal"),
        F.when(has, steps).otherwise(F.array_repeat(F.lit(0.0).cast("float"), grid_len)).alias("time_index"),
        F.when(has, F.lit(grid_len)).otherwise(F.lit(0)).cast("long").alias("sequence_length"),
        *[F.coalesce(F.col(t), F.lit(0.0)).cast("float").alias(t) for t in TARGETS])


def write_model_ready(df: DataFrame, path: str) -> None:
    """S9 sink: Parquet partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


#: Batches that a task puts together (2.2 MB each with 32 patients at 720 x 18; the aggregation holds them a few times).
TASK_BATCHES = 16


def batches(df: DataFrame, batch_size: int, seed: int = 42, shuffle_splits=("train",)) -> DataFrame:
    """Group each split's patients into batches of ``batch_size`` in a
    seeded hash order (train) or id order (other splits); the last batch may
    be short. Each output row is one batch with its stacked fields; a batch
    never holds more than ``batch_size`` patients.

    The rows take few bytes in files and shuffles and much memory, so neither bytes nor the session's partitions
    say how many a task may hold: it reads ``GRID_PATIENTS`` rows at once and packs about ``TASK_BATCHES`` batches."""
    from .ranking import checkpointed, ranked
    df = checkpointed(df, GRID_PATIENTS)  # read for the keys and for the fields
    order = F.when(F.col("split").isin(*shuffle_splits), F.md5(F.concat_ws(":", F.col("patient_id"), F.lit(seed)))) \
             .otherwise(F.lit(""))
    keyed = df.select("patient_id", "split", order.alias("_o"))  # the wide rows join once, when they have a place
    r = ranked(keyed, ["split"], ["_o", "patient_id"], "_rn")
    r = r.select("patient_id", "_rn", ((F.col("_rn") - 1) / F.lit(batch_size)).cast("long").alias("batch_id"))
    b = df.hint("merge").join(r, "patient_id")  # by size the wide rows, small in files, would be broadcast
    fields = [c for c in df.columns if c not in ("split",)]
    n = -(-df.count() // batch_size)
    tasks = max(1, min(n, df.sparkSession.sparkContext.defaultParallelism), -(-n // TASK_BATCHES))
    packed = b.repartition(tasks, "split", "batch_id").groupBy("split", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn"), *[F.col(c) for c in fields]))).alias("_items"))
    def field_of(c):
        return lambda it: it[c]
    return packed.select("split", "batch_id", F.size("_items").alias("batch_len"),
                         *[F.transform("_items", field_of(c)).alias(c) for c in fields])


def split_metadata(model_ready_df: DataFrame, n_static: int = len(STATIC_FEATURES), n_channels: int = 26,
                   grid_len: int = tl.GRID_LEN) -> DataFrame:
    """Patients and tensor dimensions per split."""
    return model_ready_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_patients")).select(
        "split", "n_patients", F.lit(n_static).alias("static_dim"), F.lit(n_channels).alias("temporal_dim"),
        F.lit(grid_len).alias("sequence_length"))


def feature_catalogue(spark) -> DataFrame:
    """Static and temporal feature names with their group and the task types."""
    rows = [("static", i, n) for i, n in enumerate(STATIC_FEATURES)]
    rows += [("temporal", i, n) for i, n in enumerate(f"{c}:{t}" for c, v in TEMPORAL_CATEGORIES for t in v.type_names)]
    rows += [("target", i, t) for i, t in enumerate(TARGETS)]
    return spark.createDataFrame(rows, "kind string, position int, name string")


def score(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], feature_cols: list[str],
          output_schema: str = "mortality_risk double, icu_admission double, ventilator_need double, "
                               "length_of_stay double") -> DataFrame:
    """Batch scoring with a pluggable model. ``scorer`` maps a pandas frame
    of ``feature_cols`` to a frame with the output columns; it runs inside
    ``mapInPandas`` on Arrow batches (one Python call per batch, never per
    row), and the result keeps ``patient_id``."""
    out_schema = "patient_id " + df.schema["patient_id"].dataType.simpleString() + ", " + output_schema

    def run(it):
        for pdf in it:
            res = scorer(pdf[feature_cols])
            res.insert(0, "patient_id", pdf["patient_id"].values)
            yield res

    return df.select("patient_id", *feature_cols).mapInPandas(run, out_schema)
