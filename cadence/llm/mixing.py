"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; a document's expected number of copies
is target / size of its source. Within a source the expected copies are summed in a
fixed order, one offset is added, and a document is taken once for each integer
boundary that its stretch of the sum crosses. The order is by size class, then by a
hash of the id, so that each stretch holds documents of like size and the words
taken come near the target.

Scale: ranks within a source come from counts per (source, size class, hash prefix);
only such a cell, of about ``cell_rows`` rows at most, is numbered in one task, so a
source with a third of all rows is spread over many. Texts stay where they are; the
sums work on (id, source, size) alone, unless columns are to be carried along.

Defined results: a null text has size 0; the null source is a source of its own, last
in order; sources without words get target 0 and no copies; rows with equal ids are
numbered one after the other, whichever comes first; an empty table gives no rows;
columns of other names are carried in one struct and can't clash. A very long text is counted whole, where it is,
and taken as often as its source's rate says, like any other.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, small_batches

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
CELL_ROWS = 100_000


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Runs of bytes other than space and 0x09 to 0x0D (what ``bytes.split`` splits at)."""
    return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")


def size_class(size: Column) -> Column:
    """Four classes for each power of two."""
    bits = F.length(F.bin(size)).cast("int")
    return F.when(size < 4, size).otherwise(bits * 4 + F.call_function(
        "shiftright", size, bits - 3).bitwiseAND(F.lit(3))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, n, target`` from a frame with ``source, size``.

    Weights repeat over the sources in code point order, null last. Targets share all
    words by weight and stop at ``max_repeats`` times the source's size; the excess is
    shared again. In order of cap / weight, the first source that needn't stop fixes
    the words per weight of all after it, so no loop is needed.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    w = total.withColumn("w", F.element_at(wheel, (place % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.select("*", F.sum("source_size").over(every).alias("all"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("stopped"), F.sum("w").over(after).alias("rest"))
    wide = "decimal(38,0)"
    w = w.withColumn("free", ((F.col("all") - F.col("stopped")).cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)")).cast(wide)
                     < (F.col("cap").cast("decimal(20,0)") * F.col("rest").cast("decimal(18,0)")).cast(wide))
    first = F.min(F.when(F.col("free"), F.struct("ratio", F.col("stopped").alias("s"), F.col("rest").alias("r")))).over(every)
    w = w.withColumn("first", first)
    share = (F.col("w") * (F.col("all") - F.col("first.s"))).cast("double") / F.col("first.r")
    stops = F.col("first").isNull() | (F.col("ratio") < F.col("first.ratio"))
    return w.select("source", "source_size", "n",
                    F.when(stops, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, cell_rows: int = CELL_ROWS,
        carry: bool = False) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` per document, and with ``carry`` a struct
    ``row`` of all input columns."""
    small_batches(docs.sparkSession)
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col).cast("string")).alias("size"), *kept)
    slim = materialize(rows.select("doc_id", "source", "size"), "mix")
    n = slim.count()
    digits = max(1, math.ceil(math.log(max(1, n / cell_rows), 16)))
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def celled(df: DataFrame) -> DataFrame:
        # The key is never null, so the window and the join below share one exchange of the rows.
        key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
        return df.withColumns({"key": key, "place": place, "cls": size_class(F.col("size"))}).withColumn(
            "cell", F.substring("place", 1, digits))

    cells = celled(slim).groupBy("key", "source", "cls", "cell").agg(F.count(F.lit(1)).alias("rows_in"))
    ahead = Window.partitionBy("key").orderBy("cls", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("rows_in").over(ahead), F.lit(0)))
    goal = targets(slim, weights, max_repeats)
    cells = cells.join(goal, cells.source.eqNullSafe(goal.source), "left").select(
        "key", "cls", "cell", "ahead", "source_size", "target")
    own = celled(rows if carry else slim)
    own = own.withColumn("nth", F.row_number().over(
        Window.partitionBy("key", "cls", "cell").orderBy("place", "doc_id")) - 1)
    found = own.join(cells, ["key", "cls", "cell"], "left")
    rank = F.col("ahead") + F.col("nth")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 5), 16, 10).cast("double") / 2**20
    copies = F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank)
    return found.select("doc_id", "source", "size", "source_size", "target",
                        copies.cast("long").alias("copies"), *(["row"] if carry else []))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed documents themselves: each as often as it is taken, with the number of the copy in ``mix_copy``
    (``mix_copy_`` if a column is called so already)."""
    name = free_name(mixed.schema["row"].dataType.names, "mix_copy")
    return mixed.filter("copies > 0").select("row.*", F.explode(F.expr("sequence(1, copies)")).alias(name))
