"""Patient-level train / validation / test splits.

Splits of an order are two cut points: the rows at two ranks are found by a
quantile sketch and exact counts (``first_rows``), and every patient is compared with
them, so the patients are neither sorted nor written. The only driver work is
turning the patient count into ranks with the same float formulas the
reference uses, the two rows, and (stratified split) at most ``9 * min_pos``
pre-assigned ids.

Random orders are ``md5("patient_id:seed")`` (ties by id), so
they are reproducible run to run and independent of partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import first_rows


class CannotSplit(ValueError):
    """The data doesn't allow this split; the message says why."""


SPLITS = ("train", "validation", "test")
LABELS = ("mortality", "icu", "ventilator")


def temporal_cut_points(n: int, test_size: float = 0.1, validation_size: float = 0.15) -> tuple[int, int]:
    test_end = int(n * (1 - test_size))
    val_end = int(test_end * (1 - validation_size / (1 - test_size)))
    return val_end, test_end


def _cut(df: DataFrame, order: list[str], ranks: Callable[[int], tuple[int, int]], names: tuple[str, str, str],
         keep: list[str]) -> DataFrame:
    """``keep`` and the split of every row: ``names[0]`` up to the first of ``ranks`` (of the number of rows),
    ``names[1]`` up to the second, then ``names[2]``. ``df`` is held while the cuts are sought and computed anew
    for the result."""
    held = df.persist()
    try:
        n = held.count()
        first, second = first_rows(held, order[0], order[1:], list(ranks(n)), n)
    finally:
        held.unpersist()
    return df.select(*keep, F.when(first, names[0]).when(second, names[1]).otherwise(names[2]).alias("split"))


def temporal_split(observations: DataFrame, test_size: float = 0.1, validation_size: float = 0.15) -> DataFrame:
    """Patients ordered by earliest observation (ties by id): earliest go
    to train, latest to test. Patients without dated observations are not
    assigned (see ``temporal_split_dropped``)."""
    first = observations.where(F.col("ts").isNotNull()).groupBy("patient_id").agg(F.min("ts").alias("first_ts"))
    def ranks(n: int) -> tuple[int, int]:
        if not n:
            raise CannotSplit("no dated observations")
        return temporal_cut_points(n, test_size, validation_size)

    return _cut(first, ["first_ts", "patient_id"], ranks, ("train", "validation", "test"), ["patient_id", "first_ts"])


def temporal_split_dropped(patients: DataFrame, observations: DataFrame) -> DataFrame:
    """Patients the temporal split leaves out (no dated observation)."""
    dated = observations.where(F.col("ts").isNotNull()).select("patient_id")
    return patients.select("patient_id").join(dated, "patient_id", "left_anti")


def hash_order(df: DataFrame, seed: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.col("patient_id"), F.lit(seed)))


#: The seeded order: a number from the hash's first digits, the hash, the id.
HASHED = ["_n", "_h", "patient_id"]


def _hashed(df: DataFrame, seed: int) -> DataFrame:
    x = df.withColumn("_h", hash_order(df, seed))
    return x.withColumn("_n", F.conv(F.substring("_h", 1, 12), 16, 10).cast("long"))


def random_split(patients: DataFrame, test_size: float = 0.1, validation_size: float = 0.15,
                 seed: int = 42) -> DataFrame:
    """Test share of all, then validation share of the rest (sizes as
    the reference's splitter: ceil of the test fraction)."""
    def ranks(n: int) -> tuple[int, int]:
        n_test = math.ceil(n * test_size)
        return n_test, n_test + math.ceil((n - n_test) * (validation_size / (1 - test_size)))

    return _cut(_hashed(patients.select("patient_id"), seed), HASHED, ranks, ("test", "validation", "train"), ["patient_id"])


def stratified_split(flags: DataFrame, test_size: float = 0.1, validation_size: float = 0.15,
                     min_pos: int = 3, seed: int = 42) -> DataFrame:
    """For each label in order (mortality, icu, ventilator) and each split
    in order (test, validation, train), up to ``min_pos`` still-unassigned
    positives (in seeded hash order) are placed first; the rest fill test,
    then validation to their target sizes; everything else goes to train.
    ``flags``: ``patient_id`` plus 0/1 columns ``mortality, icu, ventilator``."""
    spark = flags.sparkSession
    n = flags.count()
    if not n:
        raise CannotSplit("no patients with label flags")
    n_test = max(1, int(round(n * test_size)))
    n_val = max(1, int(round(n * validation_size)))
    h = flags.select("patient_id", *LABELS, hash_order(flags, seed).alias("_h"))
    # At most 9 * min_pos ids are ever pre-assigned, so for each label its first
    # 9 * min_pos positives in hash order are enough to replay the sequential
    # allocation exactly. One job of three bounded top-k scans (<= 27 * min_pos
    # rows reach the driver).
    k = 3 * len(LABELS) * min_pos
    tops = [h.where(F.col(label) == 1).orderBy("_h", "patient_id").limit(k)
            .select(F.lit(label).alias("_label"), "patient_id", "_h") for label in LABELS]
    cand: dict[str, list] = {label: [] for label in LABELS}
    for row in sorted(reduce(DataFrame.unionByName, tops).collect(), key=lambda r: (r["_h"], r["patient_id"])):
        cand[row["_label"]].append(row["patient_id"])
    assigned: dict = {}
    for label in LABELS:
        for split in ("test", "validation", "train"):
            for pid in [p for p in cand[label] if p not in assigned][:min_pos]:
                assigned[pid] = split
    pre = spark.createDataFrame(list(assigned.items()), "patient_id " + h.schema["patient_id"].dataType.simpleString()
                                + ", split string") if assigned else None
    counts = {s: sum(1 for v in assigned.values() if v == s) for s in SPLITS}
    need_test = max(0, n_test - counts["test"])
    need_val = max(0, n_val - counts["validation"])
    rest = h if pre is None else h.join(F.broadcast(pre.select("patient_id")), "patient_id", "left_anti")
    out = _cut(_hashed(rest.select("patient_id"), seed), HASHED, lambda _: (need_test, need_test + need_val),
               ("test", "validation", "train"), ["patient_id"])
    return out if pre is None else out.unionByName(pre)


def split_counts(split: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """W5 + W7: patients and positives per label per split."""
    if flags is None:
        return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_patients"))
    x = split.join(flags, "patient_id", "left")
    return x.groupBy("split").agg(F.count(F.lit(1)).alias("n_patients"),
                                  *[F.sum(F.coalesce(F.col(lb), F.lit(0))).cast("long").alias(f"{lb}_pos")
                                    for lb in LABELS])
