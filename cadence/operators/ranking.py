"""Skew-safe ordering primitives.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to one
task; with one entity holding a third of all rows that task holds a third of
the data. These helpers give the same exact answers with bounded work per
task:

1. range-partition on ``(g..., o...)`` (Spark samples the data for the
   bounds, so one hot group is cut across many partitions) and sort within
   partitions;
2. tag rows with the partition index and a within-partition id;
3. materialise the tagged rows as a Parquet table under
   ``spark.checkpoint.dir`` so the tags are stable under recomputation and
   executor loss (columnar, compressed, read back column-pruned);
4. per (partition, group) totals: at most ``#partitions + #groups`` rows, so
   the offset window over them is bounded per group by ``#partitions``;
5. join the offsets back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Session setting: partitions that a ranking pass deals its rows to. Set it so that
#: the ranked rows of one partition take about 128 MB; default: the shuffle partitions.
RANK_PARTITIONS = "spark.cadence.rank.partitions"

_SCOPES: list[list[str]] = []


@contextmanager
def materialized_scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside the block are deleted when it ends: put the
    consumer of a query (its write or collect) inside. Outside any scope they
    stay until the checkpoint folder's retention removes them."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def delete_with_scope(path: str) -> None:
    """Delete ``path`` too when the innermost scope ends."""
    _SCOPES[-1].append(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder (``spark.checkpoint.dir``);
    see ``materialized_scope`` for when it is deleted."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str = "cadence", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back: a lineage cut that survives
    executor loss and makes non-deterministic tags (partition ids) stable.
    See ``materialized_scope`` for when it is deleted.

    ``group_rows``: rows of a row group at most. A reader unpacks up to 4096 rows at
    once, whatever they take, but never of two row groups: set it where rows are wide."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def _target_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    conf = df.sparkSession.conf
    return int(conf.get(RANK_PARTITIONS, None) or conf.get("spark.sql.shuffle.partitions"))


def tagged(df: DataFrame, by: list[str], order: list, n: int | None = None) -> DataFrame:
    """``df`` dealt to range partitions of (by, order), materialised with the
    partition's number ``_pid`` and an ascending ``_mid`` within it."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _target_partitions(df, n)
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    s = (df.repartitionByRange(n, *keys)
           .sortWithinPartitions(*keys)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    return materialize(s)


def join_null_safe(s: DataFrame, offs: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL group keys (no row of a
    NULL group may be lost); ``_pid`` is never NULL."""
    o = offs.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in offs.columns])
    cond = [s[c].eqNullSafe(o[f"_k_{c}"]) if c != "_pid" else s[c] == o[f"_k_{c}"] for c in keys]
    return s.join(o, cond).drop(*[f"_k_{c}" for c in keys])


def ranked(df: DataFrame, by: list[str], order: list, out: str = "rn",
           num_partitions: int | None = None) -> DataFrame:
    """Exact ``row_number()`` within ``by`` ordered by ``order`` (1-based).

    Ties in ``order`` get distinct consecutive numbers in an unspecified
    order; pass a unique tiebreaker column to make it deterministic.
    """
    s = tagged(df, by, order, num_partitions)
    totals = s.groupBy("_pid", *by).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")
    offs = totals.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (join_null_safe(s, offs.select("_pid", *by, "_first", "_off"), ["_pid", *by])
             .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1)
             .drop("_pid", "_mid", "_first", "_off"))


#: Rows around a cut that are ordered exactly when a cut point is sought.
CUT_ROWS = 100_000


def _up_to(row: Row, order: list[str]) -> F.Column:
    """Whether a row stands at or before ``row`` in ascending ``order`` (NULLs first)."""
    out = F.lit(True)
    for c in reversed(order):
        before = F.lit(False) if row[c] is None else F.col(c).isNull() | (F.col(c) < F.lit(row[c]))
        out = before | (F.col(c).eqNullSafe(F.lit(row[c])) & out)
    return out


def first_rows(df: DataFrame, key: str, ties: list[str], ranks: list[int], n: int | None = None) -> list[F.Column]:
    """For each of ``ranks`` whether a row is among that many first ones of ``df`` ordered by the number or time
    ``key`` (never NULL), then ``ties``.

    A quantile sketch brackets the key of each rank, counts place the bracket, and only the rows inside are
    ordered, at most ``CUT_ROWS`` of them as a top-k; where more rows share the bracket (ties), they are ranked by
    ``ranked``. No other row is sorted or written; the conditions compare with the row at the rank. ``n``: the
    number of rows, if known.
    """
    n = df.count() if n is None else n
    inner = {r for r in ranks if 0 < r < n}
    rows: dict[int, Row] = {}
    order, column = [key, *ties], F.col(key)
    bracket, counts = {r: F.lit(True) for r in inner}, {f"{x}{r}": 0 if x == "below" else n for r in inner for x in ("below", "in")}
    if inner and n > CUT_ROWS:
        slack = 2.0 / CUT_ROWS  # as a share of the rows: far above the sketch's error
        near = {r: [max(0.0, (r - 0.5) / n - slack), min(1.0, (r - 0.5) / n + slack)] for r in inner}
        ends = df.agg(*[F.percentile_approx(key, near[r], CUT_ROWS * 10).alias(str(r)) for r in inner]).first()
        bracket = {r: column.between(F.lit(ends[str(r)][0]), F.lit(ends[str(r)][1])) for r in inner}
        counts = df.agg(*[x for r in inner for x in (F.count_if(column < F.lit(ends[str(r)][0])).alias(f"below{r}"),
                                                     F.count_if(bracket[r]).alias(f"in{r}"))]).first()
    for r in inner:
        inside, k = df.where(bracket[r]), r - counts[f"below{r}"]
        if not 1 <= k <= counts[f"in{r}"]:  # the sketch missed: all rows
            inside, k = df, r
        inside = inside.select(*order)
        if k <= CUT_ROWS:
            rows[r] = inside.orderBy(*order).limit(k).orderBy(*[F.col(c).desc() for c in order]).first()
        else:
            rows[r] = ranked(inside, [], order, "_rn").where(F.col("_rn") == k).first()
    return [_up_to(rows[r], order) if r in rows else F.lit(r >= n and n > 0) for r in ranks]


def running_sums(df: DataFrame, by: list[str], order: str, cols: list[str],
                 prefix: str = "cum_", num_partitions: int | None = None,
                 inclusive: bool = True) -> DataFrame:
    """Exact running sums of ``cols`` within ``by`` ordered by ``order``.

    ``order`` must be unique within a group (e.g. distinct scores after a
    group-by). The within-partition running sum is a window partitioned by
    (partition index, group): a piece of a range partition, never a whole
    hot group.
    """
    s = tagged(df, by, [order], num_partitions)
    tot = s.groupBy("_pid", *by).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_off = Window.partitionBy(*by).orderBy("_pid") if by else Window.orderBy("_pid")
    prev = w_off.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *by, *[
        F.coalesce(F.sum(f"_t_{c}").over(prev), F.lit(0)).alias(f"_o_{c}") for c in cols])
    w_in = Window.partitionBy("_pid", *by).orderBy(order)
    frame = w_in.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = s.select("*", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"_l_{c}") for c in cols])
    out = join_null_safe(local, offs, ["_pid", *by])
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.col(f"_l_{c}"))
    return out.drop("_pid", "_mid", *[f"_l_{c}" for c in cols], *[f"_o_{c}" for c in cols])


def next_in_group(df: DataFrame, by: list[str], order: list, value: str, out: str,
                  num_partitions: int | None = None) -> DataFrame:
    """``lead(value) OVER (PARTITION BY by ORDER BY order)`` without a
    per-group task: rank, then an equi-join of rank n with rank n + 1 (the
    key includes the rank, so a hot group spreads over many partitions)."""
    r = ranked(df, by, order, "_rn", num_partitions)
    nxt = r.select(*[F.col(c).alias(f"_n_{c}") for c in by], (F.col("_rn") - 1).alias("_n_rn"),
                   F.col(value).alias(out))
    cond = [r[c].eqNullSafe(nxt[f"_n_{c}"]) for c in by] + [r["_rn"] == nxt["_n_rn"]]
    return r.join(nxt, cond, "left").drop("_rn", "_n_rn", *[f"_n_{c}" for c in by])


def checkpointed(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Materialise (see ``materialize``) a frame that several branches of a
    plan reuse, e.g. one row per patient. Cuts the lineage so executor loss
    recomputes from the written table, not from the scans."""
    return materialize(df, group_rows=group_rows)
