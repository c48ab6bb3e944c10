"""Regular hourly timelines without range joins.

Grid: for each patient, ``grid_len`` points ``t_h = t0 + h * step``
(h = 0 .. grid_len - 1), where ``t0`` is the earliest timestamp of the
patient's observations, encounter/medication start+stop and procedures.

Proximity (J3): a point event at ``d`` is in the window of ``t_h`` iff
``t_h - step <= d < t_h + step``. With ``k = floor((d - t0) / step)`` that is
exactly ``h in {k, k + 1}``: two rows per event, then a plain equi-aggregation
on ``(patient_id, hour_idx)`` -- no inequality join, no Cartesian product.

Interval stabbing (J4): ``[start, stop)`` is active at ``t_h`` iff
``start <= t_h < stop`` (open stop = active to the end of the grid), i.e.
``h in [ceil((start - t0)/step), ceil((stop - t0)/step) - 1]``. Instead of
exploding every interval to up to ``grid_len`` rows we difference-encode it
(+1 at lo, -1 at hi + 1), sum per ``(patient, type, hour)`` -- at most
``grid_len + 1`` rows per group whatever the skew -- and take a running sum.

Vocabulary matching is a projection: one boolean per (type, keyword), all
literal patterns, evaluated once per row inside whole-stage codegen. The
per-hour choice rules (first keyword with numeric data within a type, last
type with data for the collapsed channel) are expressions over per-slot
sums and counts of a *single* aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import HOUR_US, ceil_div, floor_div, micros_between, numeric_value
from ..functions.vocab import Vocab, any_keyword, keyword_match
from ..sources.tables import Roles
from .ranking import checkpointed

GRID_LEN = 720


def _step(step_hours: float) -> int:
    return int(round(step_hours * HOUR_US))


# ---------------------------------------------------------------------------
# Timestamps, extent, anchors
# ---------------------------------------------------------------------------

def timeline_timestamps(roles: Roles) -> DataFrame:
    """Union-all of the timestamp columns that define a patient's extent:
    observations.ts, encounters start/stop, medications start/stop,
    procedures.ts (conditions and devices do not count)."""
    parts = [
        roles.observations.select("patient_id", F.col("ts")),
        roles.encounters.select("patient_id", F.col("start").alias("ts")),
        roles.encounters.select("patient_id", F.col("stop").alias("ts")),
        roles.medications.select("patient_id", F.col("start").alias("ts")),
        roles.medications.select("patient_id", F.col("stop").alias("ts")),
        roles.procedures.select("patient_id", F.col("ts")),
    ]
    return reduce(DataFrame.unionByName, parts)


def timeline_extent(roles: Roles, grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """Per patient ``timeline_start`` (= t0), ``timeline_end`` =
    least(t0 + grid_len * step, max ts), number of non-null timestamps,
    and the observed extent in hours. Null timestamps are ignored."""
    step = _step(step_hours)
    ts = timeline_timestamps(roles).where(F.col("ts").isNotNull())
    agg = ts.groupBy("patient_id").agg(F.min("ts").alias("timeline_start"), F.max("ts").alias("_max"),
                                       F.count(F.lit(1)).alias("n_timestamps"))
    end = F.least(F.timestamp_add("MICROSECOND", F.lit(grid_len * step), F.col("timeline_start")), F.col("_max"))
    return (agg.withColumn("timeline_end", end)
               .withColumn("observed_hours", micros_between("timeline_start", "timeline_end") / F.lit(float(HOUR_US)))
               .drop("_max"))


def anchors_of(extent: DataFrame) -> DataFrame:
    return extent.select("patient_id", F.col("timeline_start").alias("t0"))


# ---------------------------------------------------------------------------
# Binning helpers
# ---------------------------------------------------------------------------

def bin_points(points: DataFrame, anchors: DataFrame, ts: str = "ts", grid_len: int = GRID_LEN,
               step_hours: float = 1.0, hour_col: str = "hour_idx") -> DataFrame:
    """Each point event -> the (at most two) grid hours whose +/- 1 step
    window contains it. Patients without a grid drop out (inner join)."""
    step = _step(step_hours)
    x = points.join(anchors, "patient_id").withColumn("_k", floor_div(micros_between("t0", ts), step))
    x = x.withColumn(hour_col, F.explode(F.array(F.col("_k"), F.col("_k") + 1)))
    return x.where((F.col(hour_col) >= 0) & (F.col(hour_col) < grid_len)).drop("_k")


def listed_hours(points: DataFrame, anchors: DataFrame, ts: str = "ts", grid_len: int = GRID_LEN,
                 step_hours: float = 1.0) -> DataFrame:
    """How many grid hours list each point event (0, 1 or 2), one row per event."""
    step = _step(step_hours)
    k = floor_div(micros_between("t0", ts), step)
    inside = lambda h: F.when((h >= 0) & (h < grid_len), 1).otherwise(0)
    return (points.join(anchors, "patient_id")
                  .withColumn("_k", k)
                  .withColumn("n_listed", inside(F.col("_k")) + inside(F.col("_k") + 1))
                  .drop("_k"))


def active_bounds(intervals: DataFrame, anchors: DataFrame, grid_len: int = GRID_LEN,
                  step_hours: float = 1.0) -> DataFrame:
    """``lo``/``hi`` grid hours during which ``[start, stop)`` is active;
    rows with no active hour (or null start) are dropped."""
    step = _step(step_hours)
    x = intervals.join(anchors, "patient_id").where(F.col("start").isNotNull())
    lo = F.greatest(F.lit(0), ceil_div(micros_between("t0", "start"), step))
    hi = F.when(F.col("stop").isNull(), F.lit(grid_len - 1)).otherwise(
        F.least(F.lit(grid_len - 1), ceil_div(micros_between("t0", "stop"), step) - 1))
    x = x.withColumn("lo", lo.cast("int")).withColumn("hi", hi.cast("int"))
    return x.where(F.col("lo") <= F.col("hi"))


# ---------------------------------------------------------------------------
# A1 / A2: hourly vitals / labs
# ---------------------------------------------------------------------------

#: Most distinct matching texts whose classification is sent to every task.
MAX_TEXTS = 1_000_000


def classified(df: DataFrame, text: str, columns: dict[str, F.Column], keep: F.Column) -> DataFrame:
    """The rows of ``df`` whose ``text`` satisfies ``keep``, with ``columns`` of it.

    Descriptions repeat: the patterns are evaluated once on their distinct values, and the matching ones, written
    (as part of the plan the patterns would be inferred as filters all over again), are joined back by text as a
    broadcast of counted size. With more than ``MAX_TEXTS`` of them (free text) the patterns are evaluated on the
    rows."""
    texts = df.select(text).where(F.col(text).isNotNull()).distinct()
    known = checkpointed(texts.where(keep).select(text, *[c.alias(n) for n, c in columns.items()]))
    if known.count() > MAX_TEXTS:
        return df.where(keep).withColumns(columns)
    return df.join(F.broadcast(known), text)


def hourly_values_multi(obs: DataFrame, anchors: DataFrame, vocabs: dict[str, Vocab], value_is_numeric: bool,
                        grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """Several valued channels (e.g. vitals and labs) from ONE scan and ONE
    aggregation of the observations. Per (patient_id, hour_idx) with any
    matching numeric value: ``{channel}__{type}`` columns (mean of the type's
    first keyword with numeric data) and ``{channel}`` (collapsed: the last
    type, in vocabulary order, with data)."""
    desc = F.col("description")
    v = numeric_value("value", value_is_numeric)
    # one boolean per (channel, type, keyword) slot, then a single aggregation
    slots = []
    for ci, (ch, voc) in enumerate(vocabs.items()):
        for ti, (t, kws) in enumerate(voc.types):
            for ki, kw in enumerate(kws):
                slots.append((f"_m{ci}_{ti}_{ki}", keyword_match(desc, kw, voc.mode)))
    pre = obs.select("patient_id", "ts", "description", v.alias("_v")).where(F.col("_v").isNotNull())
    pre = classified(pre, "description", dict(slots), reduce(lambda a, b: a | b, [m for _, m in slots]))
    binned = bin_points(pre, anchors, "ts", grid_len, step_hours)
    aggs = []
    for n, _ in slots:
        aggs.append(F.sum(F.when(F.col(n), F.col("_v"))).alias(f"s{n}"))
        aggs.append(F.count_if(F.col(n)).alias(f"c{n}"))
    agg = binned.groupBy("patient_id", "hour_idx").agg(*aggs)
    out_cols = []
    for ci, (ch, voc) in enumerate(vocabs.items()):
        type_cols = []
        for ti, (t, kws) in enumerate(voc.types):
            choices = [F.when(F.col(f"c_m{ci}_{ti}_{ki}") > 0, F.col(f"s_m{ci}_{ti}_{ki}") / F.col(f"c_m{ci}_{ti}_{ki}"))
                       for ki in range(len(kws))]
            type_cols.append(F.coalesce(*choices) if len(choices) > 1 else choices[0])
        out_cols += [c.alias(f"{ch}__{t}") for c, t in zip(type_cols, voc.type_names)]
        out_cols.append(F.coalesce(*reversed(type_cols)).alias(ch))
    return agg.select("patient_id", "hour_idx", *out_cols)


def hourly_values_wide(obs: DataFrame, anchors: DataFrame, vocab: Vocab, value_is_numeric: bool,
                       grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """A1 / A2 for one vocabulary: one column per type plus ``collapsed``."""
    m = hourly_values_multi(obs, anchors, {"collapsed": vocab}, value_is_numeric, grid_len, step_hours)
    return m.select("patient_id", "hour_idx", *[F.col(f"collapsed__{t}").alias(t) for t in vocab.type_names],
                    "collapsed")


def hourly_values_long(wide: DataFrame, vocab: Vocab) -> DataFrame:
    """Per-type channel rows ``(patient_id, hour_idx, type, type_ord, value)``."""
    cells = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(i).alias("type_ord"), F.col(t).alias("value"))
                      for i, t in enumerate(vocab.type_names)])
    return (wide.select("patient_id", "hour_idx", F.inline(cells))
                .where(F.col("value").isNotNull()))


def hourly_collapsed(wide: DataFrame) -> DataFrame:
    return wide.select("patient_id", "hour_idx", F.col("collapsed").alias("value"))


# ---------------------------------------------------------------------------
# A4: procedures near each hour
# ---------------------------------------------------------------------------

def hourly_type_counts(points: DataFrame, anchors: DataFrame, vocab: Vocab, grid_len: int = GRID_LEN,
                       step_hours: float = 1.0) -> DataFrame:
    """Number of distinct vocabulary types among point events within +/- 1
    step of each hour (only hours with at least one match are returned)."""
    desc = F.col("description")
    flags = {f"_t{i}": any_keyword(desc, kws, vocab.mode) for i, (_, kws) in enumerate(vocab.types)}
    pre = classified(points.select("patient_id", "ts", "description"), "description", flags,
                     any_keyword(desc, vocab.all_keywords(), vocab.mode))
    binned = bin_points(pre, anchors, "ts", grid_len, step_hours)
    agg = binned.groupBy("patient_id", "hour_idx").agg(
        *[F.max(F.col(f"_t{i}").cast("int")).alias(f"_a{i}") for i in range(len(vocab.types))])
    n = reduce(lambda a, b: a + b, [F.col(f"_a{i}") for i in range(len(vocab.types))])
    return agg.select("patient_id", "hour_idx", n.cast("double").alias("value"))


# ---------------------------------------------------------------------------
# A3 / A5: active medications / devices
# ---------------------------------------------------------------------------

def active_segments_multi(intervals: DataFrame, anchors: DataFrame, vocabs: dict[str, Vocab],
                          grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """Several active-interval channels from one pass over the intervals, as
    run-length segments ``(channel, patient_id, h_start, h_end, value)``:
    over hours ``h_start..h_end`` exactly ``value`` distinct types of the
    channel's vocabulary have an active interval (zero-count hours omitted).

    Two bounded windows, no per-hour rows: per (channel, patient, type) the
    running sum of +1/-1 interval edges (<= grid_len + 1 change points) gives
    the type's on/off switches; per (channel, patient) the running sum of
    those switches is the active-type count between change points.
    """
    desc = F.col("description")
    keys = F.array(*[F.when(any_keyword(desc, kws, voc.mode), F.struct(F.lit(ch).alias("channel"),
                                                                      F.lit(ti).alias("type_ord")))
                     for ch, voc in vocabs.items() for ti, (_, kws) in enumerate(voc.types)])
    found = F.filter(keys, lambda x: x.isNotNull())
    pre = classified(intervals, "description", {"_types": found}, F.size(found) > 0)
    b = active_bounds(pre, anchors, grid_len, step_hours).select("patient_id", "lo", "hi", F.inline("_types"))
    deltas = b.select("channel", "patient_id", "type_ord", F.inline(F.array(
        F.struct(F.col("lo").alias("h"), F.lit(1).alias("d")),
        F.struct((F.col("hi") + 1).alias("h"), F.lit(-1).alias("d")))))
    net = deltas.groupBy("channel", "patient_id", "type_ord", "h").agg(F.sum("d").alias("d")).where(F.col("d") != 0)
    # one shuffle for all that follows, to a stated number of tasks: few bytes here, but each row may become grid_len hours
    net = net.repartition(int(net.sparkSession.conf.get("spark.sql.shuffle.partitions")), "channel", "patient_id")
    wt = Window.partitionBy("channel", "patient_id", "type_ord").orderBy("h")
    run = net.withColumn("run", F.sum("d").over(wt.rowsBetween(Window.unboundedPreceding, 0)))
    on_now = (F.col("run") > 0).cast("int")
    on_before = ((F.col("run") - F.col("d")) > 0).cast("int")
    switches = run.select("channel", "patient_id", "h", (on_now - on_before).alias("s")).where(F.col("s") != 0)
    per_h = switches.groupBy("channel", "patient_id", "h").agg(F.sum("s").alias("s"))
    wp = Window.partitionBy("channel", "patient_id").orderBy("h")
    cnt = per_h.select("channel", "patient_id", "h",
                       F.sum("s").over(wp.rowsBetween(Window.unboundedPreceding, 0)).alias("value"),
                       F.lead("h", 1, grid_len).over(wp).alias("h_next"))
    return cnt.where(F.col("value") > 0).select(
        "channel", "patient_id", F.col("h").alias("h_start"), (F.col("h_next") - 1).alias("h_end"),
        F.col("value").cast("double").alias("value"))


def expand_segments(segments: DataFrame) -> DataFrame:
    """Segments -> one row per hour (only where an hourly frame is asked for)."""
    return segments.select(*[c for c in segments.columns if c not in ("h_start", "h_end", "value")],
                           F.explode(F.sequence(F.col("h_start"), F.col("h_end"))).alias("hour_idx"), "value")


def hourly_active_counts_multi(intervals: DataFrame, anchors: DataFrame, vocabs: dict[str, Vocab],
                               grid_len: int = GRID_LEN, step_hours: float = 1.0) -> DataFrame:
    """``(channel, patient_id, hour_idx, value)`` rows of the active-type counts."""
    return expand_segments(active_segments_multi(intervals, anchors, vocabs, grid_len, step_hours))


def hourly_active_counts(intervals: DataFrame, anchors: DataFrame, vocab: Vocab, grid_len: int = GRID_LEN,
                         step_hours: float = 1.0) -> DataFrame:
    """A3 / A5: number of distinct vocabulary types with an active interval at
    each hour (only hours with at least one active type are returned)."""
    return hourly_active_counts_multi(intervals, anchors, {"c": vocab}, grid_len, step_hours).drop("channel")


# ---------------------------------------------------------------------------
# Events listed per hour (long form; lists only at export)
# ---------------------------------------------------------------------------

def hourly_events(kinds: dict[str, DataFrame], anchors: DataFrame, grid_len: int = GRID_LEN,
                  step_hours: float = 1.0) -> DataFrame:
    """Every (event, hour) listing: ``(patient_id, hour_idx, kind, ts, ...)``.
    Each ``kinds`` frame has ``patient_id, ts`` and any payload columns; the
    payload is kept as one struct column ``record``."""
    parts = []
    for kind, df in kinds.items():
        payload = [c for c in df.columns if c not in ("patient_id",)]
        x = df.select("patient_id", F.col("ts"), F.struct(*payload).alias("record"))
        parts.append(bin_points(x, anchors, "ts", grid_len, step_hours)
                     .select("patient_id", "hour_idx", F.lit(kind).alias("kind"), "ts", "record"))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------------------
# Dense grid and channel statistics
# ---------------------------------------------------------------------------

def dense_grid(sparse: DataFrame, anchors: DataFrame, grid_len: int = GRID_LEN, value: str = "value") -> DataFrame:
    """Zero-filled ``grid_len`` rows per patient with a timeline."""
    grid = anchors.select("patient_id", F.explode(F.sequence(F.lit(0), F.lit(grid_len - 1))).alias("hour_idx"))
    return (grid.join(sparse.select("patient_id", "hour_idx", value), ["patient_id", "hour_idx"], "left")
                .select("patient_id", "hour_idx", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value)))


def point_segments(sparse: DataFrame, value: str = "value") -> DataFrame:
    """Hourly rows as one-hour segments."""
    return sparse.withColumn("h_start", F.col("hour_idx")).withColumn("h_end", F.col("hour_idx")) \
                 .drop("hour_idx").withColumnRenamed(value, "value")


def channel_stats(sparse: DataFrame, anchors: DataFrame, grid_len: int = GRID_LEN,
                  value: str = "value", channels: list[str] | None = None) -> DataFrame:
    """Mean, population std, max and least-squares slope (vs hour
    index) of the zero-filled grid, from sums over the non-zero part only.

    ``sparse`` is either hourly rows (``hour_idx``, ``value``) or run-length
    segments (``h_start``, ``h_end``, ``value``). With L = segment length:
    S1 = sum(v L), S2 = sum(v^2 L), S_hv = sum(v (a + b) L / 2), then
    mean = S1/n, var = S2/n - mean^2, max = greatest(max, 0 if any hour is
    empty), slope = (S_hv - hbar S1) / S_hh, hbar = (n-1)/2, S_hh = n(n^2-1)/12.

    With ``channels``, ``sparse`` carries a ``channel`` column and all
    channels are reduced by one aggregation keyed by (patient, channel);
    every patient with a grid gets a row per channel.
    """
    if "h_start" not in sparse.columns:
        sparse = point_segments(sparse, value)
    n = float(grid_len)
    hbar = (n - 1) / 2.0
    shh = n * (n * n - 1) / 12.0
    v = F.col("value").cast("double")
    ln = (F.col("h_end") - F.col("h_start") + 1).cast("double")
    keys = ["patient_id"] + (["channel"] if channels else [])
    agg = sparse.where(v.isNotNull()).groupBy(*keys).agg(
        F.sum(v * ln).alias("_s1"), F.sum(v * v * ln).alias("_s2"),
        F.sum(v * (F.col("h_start") + F.col("h_end")).cast("double") * ln / 2.0).alias("_shv"),
        F.max(v).alias("_mx"), F.sum(ln).alias("_hits"))
    base = anchors.select("patient_id")
    if channels:
        base = base.select("patient_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    x = base.join(agg.hint("merge"), keys, "left")
    s1 = F.coalesce(F.col("_s1"), F.lit(0.0))
    s2 = F.coalesce(F.col("_s2"), F.lit(0.0))
    shv = F.coalesce(F.col("_shv"), F.lit(0.0))
    mean = s1 / F.lit(n)
    var = F.greatest(s2 / F.lit(n) - mean * mean, F.lit(0.0))
    hits = F.coalesce(F.col("_hits"), F.lit(0.0))
    mx = F.when(hits >= grid_len, F.col("_mx")).otherwise(F.greatest(F.coalesce(F.col("_mx"), F.lit(0.0)), F.lit(0.0)))
    slope = (shv - F.lit(hbar) * s1) / F.lit(shh) if grid_len > 1 else F.lit(0.0)
    return x.select(*keys, mean.alias("mean"), F.sqrt(var).alias("std"), mx.alias("max"), slope.alias("trend"))


# ---------------------------------------------------------------------------
# Relative time
# ---------------------------------------------------------------------------

def relative_hours(points: DataFrame, anchors: DataFrame, ts: str = "ts") -> DataFrame:
    """Hours since the patient's first timestamp."""
    return points.join(anchors, "patient_id").withColumn(
        "rel_hours", micros_between("t0", ts) / F.lit(float(HOUR_US)))
