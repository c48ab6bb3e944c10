"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ranking

#: Most rows, and bytes before another row is added, in one Arrow batch: a task holds few texts at once,
#: and a batch of very long ones few or one.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that tasks exchange with Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def materialize(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back."""
    return ranking.materialize(df, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return ranking.scratch_path(spark, name)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def collect_bounded(df: DataFrame, bound: int, what: str) -> list:
    """Collect at most ``bound`` rows; more is an error, never a silent cut."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows; raise the documented bound")
    return rows


def most_frequent(counts: DataFrame, key: str, times: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (longs) and counts of the most frequent rows, at most ``bound`` of them.

    The cut is made between classes of counts (eight for each power of two), found from the sizes of the
    classes; so neither tasks nor the driver ever hold more than the list itself.
    """
    level = F.floor(F.log2(F.col(times)) * 8)
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    held, cut = 0, None
    for at, n in sizes:
        held += n
        if held > bound:
            break
        cut = at
    if cut is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = counts.filter(level >= cut).select(F.col(key).cast("long"), F.col(times).cast("long")).toArrow()
    return found.column(0).to_numpy(), found.column(1).to_numpy()


def code_point_offsets(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code point offsets of the byte offsets ``at`` in UTF-8 ``data``."""
    if data.isascii():
        return at
    starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))
    return before[at]
