"""Embedding near-duplicates with a pivot-permutation index.

Every vector is described by its nearest pivots in order of nearness, after the sample's mean is subtracted (embeddings
often point all one way; what tells them apart is the rest). Inverted lists are kept per pair of pivots, so a list
holds what shares two. Members of a list are compared by their permutations alone: each shared pivot counts with the
product of the ranks it has from the end, and pairs whose count is below the fitted share of the largest one go. What
passes is compared by byte sketches of the vectors, with a bound of their error that loses no link, and the members
of pairs that still may link get their vectors joined, for the cosine in double precision; no link below the
threshold is returned.

Fit, on a bounded sample (``4 P`` vectors with the smallest hashes of their values): pivots are those not too
like one before, P about 2 sqrt(n) and at most ``max_pivots``. Pairs made at the threshold from sample vectors (towards
another vector, and in a random direction) say how many of how many pivots must be listed so that ``TARGET`` of
them share two, with the least work on index rows and random pairs; and which rank-aware count nearly all of them reach. Every
vector is indexed. A pair that shares fewer than two listed pivots, or ranks them too differently, is missed;
tests measure the recall against brute force.

Scale: equal vectors are one class with a count. Index rows hold a permutation and a sketch, never a vector. They
are dealt by list; a list with more than
``CELL_ROWS`` classes is cut into salted blocks, and each pair of blocks is a task's work of its own. Pairs are
counted where they are found: a pair counts only in the first list that both share, so pairs are
never sent or gathered; tasks return counts per vector and a spanning forest of links. Within one group of
near copies the comparisons still grow with the square of its size, in blocks over many tasks, and so they do where
embeddings are so narrow that links are hardly nearer than other pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; repeated rows are linked copies; a null vec_id counts as a
vector and gets links, but is never a component's id unless all ids are null; an empty table gives no
rows; other columns (labels too) don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, most_frequent
from .graph import components, local_components
from .jaccard_join import _groups as groups_of

THRESHOLD = 0.9
#: Pivots that a vector lists, at least and at most, and the fewest pivots to list from.
LEAST_LIST, MOST_LIST, LEAST_PIVOTS = 6, 14, 16
#: Share of made pairs that must share two listed pivots; share of those that may fail the rank-aware count.
TARGET, MISS = 0.97, 0.01
#: Comparisons of permutations that cost as much as a row of the index.
ROW_PAIRS = 100
MAX_PIVOTS = 4096
PIVOT_COSINE = 0.8
CELL_ROWS = 1024
#: Longest lists whose blocks are known to all tasks; any other list has about a 1/MAX_HOT share of the index at most.
MAX_HOT = 100_000
#: Sample vectors from which pairs are made.
MADE = 1000


def _normal(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by powers of two first, so that squares neither overflow nor vanish."""
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=-1, keepdims=True, initial=0.0))[1])
    size = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


class Pivots:
    """Unit pivots around ``centre``, how many a vector lists, and the least rank-aware count of a candidate."""

    def __init__(self, rows: np.ndarray, centre: np.ndarray, listed: int, least: float):
        self.rows, self.centre, self.listed, self.least = rows, centre, listed, least

    def __len__(self) -> int:
        return len(self.rows)


def _ordered(unit: np.ndarray, centre: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest pivots of unit vectors, nearest first."""
    k = min(k, len(rows))
    near = -(_normal(unit - centre) @ rows.T)
    top = np.argpartition(near, k - 1, axis=1)[:, :k] if k < len(rows) else np.tile(np.arange(k), (len(unit), 1))
    return np.take_along_axis(top, np.argsort(np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def nearest(vectors: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Numbers of the listed pivots of unit vectors, nearest first."""
    return _ordered(vectors, pivots.centre, pivots.rows, pivots.listed)


def rank_weights(tops: np.ndarray, pivots: int) -> np.ndarray:
    """For each permutation the rank from the end of every pivot that it lists; the product of two rows is their
    rank-aware count, ``largest_count`` if they are equal."""
    out = np.zeros((len(tops), pivots), np.float32)
    np.put_along_axis(out, tops, np.arange(tops.shape[1], 0, -1, dtype=np.float32)[None].repeat(len(tops), 0), 1)
    return out


def largest_count(listed: int) -> float:
    return listed * (listed + 1) * (2 * listed + 1) / 6


def _made_pairs(unit: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the threshold: vectors moved towards another one of the sample, and in a random direction."""
    x = unit[:MADE]
    other = np.roll(unit, len(unit) // 2 + 1, axis=0)[:len(x)]
    low, high = np.zeros((len(x), 1)), np.ones((len(x), 1))
    for _ in range(30):
        t = (low + high) / 2
        near = (x * _normal(x + t * (other - x))).sum(axis=1, keepdims=True) > threshold
        low, high = np.where(near, t, low), np.where(near, high, t)
    noise = np.random.default_rng(1).normal(size=x.shape)
    noise = _normal(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    return [(x, _normal(x + low * (other - x))), (x, threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * noise)]


def _fit_lists(unit: np.ndarray, centre: np.ndarray, rows: np.ndarray, threshold: float, n: int | None) -> Pivots:
    """Of the first P, P / 2, P / 4 ... pivots, and the shortest lists that reach the target, those with fewest random
    pairs in common lists, or with ``n`` vectors the least work: an index row costs about ``ROW_PAIRS`` comparisons. If
    none reaches it, the longest lists from the fewest pivots."""
    apart = unit[(_normal(unit - centre) @ rows.T).max(axis=1) < 0.9999]  # a pivot finds itself too easily
    if len(apart) < 50:
        apart = unit
    pairs = _made_pairs(apart, threshold)
    some = np.resize(apart, (600, apart.shape[1]))
    found = []
    p = len(rows)
    while p >= min(LEAST_PIVOTS, len(rows)):
        most = min(MOST_LIST, p)
        tops = [(_ordered(x, centre, rows[:p], most), _ordered(y, centre, rows[:p], most)) for x, y in pairs]
        chance = _ordered(some, centre, rows[:p], most)
        for k in range(min(LEAST_LIST, most), most + 1):
            counts = [((a[:, :k, None] == b[:, None, :k]).sum(axis=(1, 2))) for a, b in tops]
            reached = min(float((c >= 2).mean()) for c in counts)
            if reached >= TARGET or k == most:
                there = rank_weights(chance[:, :k], p) > 0
                common = there[:300].astype(np.float32) @ there[300:].astype(np.float32).T
                share = float((common >= 2).mean())
                work = share if n is None else share * n / ROW_PAIRS + k * (k - 1) / 2
                found.append((reached < TARGET, work if reached >= TARGET else -reached, p, k))
                break
        p //= 2
    *_, p, k = min(found)
    counts = []
    for x, y in pairs:
        a, b = rank_weights(_ordered(x, centre, rows[:p], k), p), rank_weights(_ordered(y, centre, rows[:p], k), p)
        both = ((a > 0) & (b > 0)).sum(axis=1) >= 2
        counts.append(np.quantile((a * b).sum(axis=1)[both], MISS) if both.any() else 0.0)
    return Pivots(rows[:p], centre, k, float(min(counts)))


def choose_pivots(sample: list[list[float]], wanted: int, threshold: float = THRESHOLD, n: int | None = None) -> dict[int, Pivots]:
    """Pivots by vector length, in the sample's order, with lists fitted for links at ``threshold`` among ``n`` vectors."""
    by: dict[int, list[list[float]]] = {}
    for values in sample:
        by.setdefault(len(values), []).append(values)
    out = {}
    for d, vectors in by.items():
        unit = _normal(np.array(vectors, np.float64))
        centre = unit.mean(axis=0)
        own = np.zeros((0, d))
        for start in range(0, len(unit), 256):
            if len(own) >= wanted:
                break
            block = _normal(unit[start:start + 256] - centre)
            block = block[(block != 0).any(axis=1)]
            if len(own) and len(block):
                block = block[(block @ own.T).max(axis=1) < PIVOT_COSINE]
            alike = np.triu(block @ block.T >= PIVOT_COSINE, 1)
            own = np.concatenate((own, block[~alike.any(axis=0)]))
        if len(own):
            out[d] = _fit_lists(unit, centre, own[:wanted], threshold, n)
    return out


def _unit(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _keys(tops: np.ndarray, dim: int) -> np.ndarray:
    """List numbers (dim, p, q) of every pair of listed pivots p < q, one row per vector."""
    k = tops.shape[1]
    if k < 2:
        return np.full((len(tops), 1), dim << 32, np.int64)
    tops = np.sort(tops, axis=1).astype(np.int64)
    i, j = np.triu_indices(k, 1)
    return (dim << 32) + (tops[:, i] << 16) + tops[:, j]


def sketches(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and scale of each unit vector: within ``scale / 2`` of every component."""
    scale = np.abs(unit).max(axis=1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float64)


def may_link(q: np.ndarray, scale: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each pair may reach the threshold, by the sketches and their largest error."""
    error = scale * math.sqrt(q.shape[1]) / 2
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 1 << 15):
        x, y = a[i:i + (1 << 15)], b[i:i + (1 << 15)]
        about = np.einsum("ij,ij->i", q[x].astype(np.float32), q[y].astype(np.float32)) * scale[x] * scale[y]
        out[i:i + (1 << 15)] = about >= threshold - error[x] - error[y] - error[x] * error[y] - 1e-5
    return out


def _index(pivots, parts, whole: bool):
    """Rows of the inverted lists: the list or, ``whole``, list, cell (packed), class, permutation and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy(zero_copy_only=False)
            vectors = b.column(1).to_pylist()
            dims = np.fromiter(map(len, vectors), np.int64, len(vectors))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit = _normal(np.array([vectors[i] for i in at], np.float64))
                own = pivots.value.get(dim)
                tops = nearest(unit, own) if own is not None else np.zeros((len(at), 0), np.int64)
                keys = _keys(tops, dim)
                row = np.repeat(np.arange(len(at)), keys.shape[1])
                key = keys.ravel()
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["list"])
                    continue
                cut = parts.value
                pieces = np.fromiter((cut.get(k, 1) for k in key.tolist()), np.int64, len(key))
                salt = rid[at][row] % pieces
                again = np.repeat(np.arange(len(key)), pieces)  # one row per cell of its list
                other = np.arange(len(again)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                low, high = np.minimum(salt[again], other), np.maximum(salt[again], other)
                place = (low << 40) + (high << 20) + salt[again]
                src = row[again]
                q, scale = sketches(unit)
                order = [t.astype(np.int16).tobytes() for t in tops]
                told = [x.tobytes() + s.tobytes() for x, s in zip(q, scale)]
                for i in range(0, len(again), 20_000):
                    s = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[again][s]), pa.array(place[s]), pa.array(rid[at][src[s]]),
                         pa.array([order[k] for k in src[s]], pa.binary()), pa.array([told[k] for k in src[s]], pa.binary())],
                        names=["list", "place", "rid", "tops", "sketch"])

    return run


def _permutations(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int16).reshape(len(blobs), len(blobs[0]) // 2).astype(np.int64)


def _own_cell(place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair's blocks are those of its cell (a pair within one block stands in several cells)."""
    salt, low, high = place & 0xFFFFF, place >> 40, place >> 20 & 0xFFFFF
    return (np.minimum(salt[a], salt[b]) == low[a]) & (np.maximum(salt[a], salt[b]) == high[a])


def counted_pairs(tops: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of permutations with a rank-aware count of at least ``least``, block by block."""
    if not tops.shape[1]:  # nothing is listed: all of one list
        w = np.ones((len(tops), 1), np.float32)
    else:
        there, local = np.unique(tops, return_inverse=True)
        w = rank_weights(local.reshape(tops.shape), len(there))
    for i in range(0, len(w), CELL_ROWS):
        for j in range(i, len(w), CELL_ROWS):
            a, b = np.nonzero(w[i:i + CELL_ROWS] @ w[j:j + CELL_ROWS].T >= least)
            a, b = a + i, b + j
            yield a[a < b], b[a < b]


def _candidates(pivots, threshold: float):
    """The members of each cell that are in a pair which may link: list, place, rid, tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches):
            if len(g["rid"]) < 2:
                continue
            place, tops = np.array(g["place"], np.int64), _permutations(g["tops"])
            dim = g["list"][0] >> 32
            raw = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(place), dim + 8)
            q, scale = raw[:, :dim].view(np.int8), np.ascontiguousarray(raw[:, dim:]).view(np.float64)[:, 0]
            own = pivots.value.get(dim)
            keep = np.zeros(len(place), bool)
            for a, b in counted_pairs(tops, own.least if own else 0.0):
                mine = _own_cell(place, a, b)
                a, b = a[mine], b[mine]
                near = may_link(q, scale, a, b, threshold)
                a, b = a[near], b[near]
                first = _first_shared(tops, a, b) == g["list"][0] & 0xFFFFFFFF
                keep[a[first]] = keep[b[first]] = True
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g["list"][0]] * len(at), pa.int64()), pa.array(place[at]), pa.array(np.array(g["rid"], np.int64)[at]),
                     pa.array([g["tops"][i] for i in at], pa.binary())], names=["list", "place", "rid", "tops"])

    return run


def linked_pairs(unit: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b of rows with cosine >= threshold, block by block."""
    step = CELL_ROWS
    for i in range(0, len(unit), step):
        for j in range(i, len(unit), step):
            a, b = np.nonzero(unit[i:i + step] @ unit[j:j + step].T >= threshold)
            a, b = a + i, b + j
            yield a[a < b], b[a < b]


def _first_shared(tops: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """p << 16 | q of the two smallest pivots that both list, for each pair."""
    out = np.empty(len(a), np.int64)
    width = tops.shape[1]
    for i in range(0, len(a), 1 << 16):
        x, y = tops[a[i:i + (1 << 16)]], tops[b[i:i + (1 << 16)]]
        both = (x[:, :, None] == y[:, None, :]).any(axis=2)
        low = np.sort(np.where(both, x, 1 << 16), axis=1)
        out[i:i + (1 << 16)] = (low[:, 0].astype(np.int64) << 16) + low[:, 1] if width > 1 else 0
    return out


def _verify(threshold: float):
    """(rid, links, root) of the members of each cell that have links there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups_of(batches):
            if len(g["rid"]) < 2:
                continue
            rid, weight = np.array(g["rid"], np.int64), np.array(g["weight"], np.int64)
            place, tops = np.array(g["place"], np.int64), _permutations(g["tops"])
            unit = _normal(np.array(g["v"], np.float64))
            shared = g["list"][0] & 0xFFFFFFFF
            links = np.zeros(len(rid), np.int64)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in linked_pairs(unit, threshold):
                own = _own_cell(place, a, b)
                a, b = a[own], b[own]
                first = _first_shared(tops, a, b) == shared
                a, b = a[first], b[first]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            at = np.flatnonzero(links)
            if len(at):
                label = local_components(len(rid), a, b)
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(links[at]), pa.array(rid[label[at]])],
                                                 names=["rid", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = THRESHOLD, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row."""
    spark = vectors.sparkSession
    # single precision is sent as it is and widened, exactly, where it is used
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), True) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.withColumn("rid", F.when(valid, F.xxhash64("v"))), "vectors")
    good = rows.filter("rid is not null")
    classes = materialize(good.groupBy("rid").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight")), "classes")
    n = classes.count()
    wanted = int(min(max_pivots, max(64, 2 * math.sqrt(n))))
    sample = [r["v"] for r in classes.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(4 * wanted).collect()]
    pivots = spark.sparkContext.broadcast(choose_pivots(sample, wanted, threshold, n))

    given = classes.select("rid", "v")
    lists = map_batches(given, _index(pivots, None, False), "list long").groupBy("list").count()
    hot, sizes = most_frequent(lists.filter(F.col("count") > CELL_ROWS), "list", "count", MAX_HOT)
    parts = spark.sparkContext.broadcast(dict(zip(hot.tolist(), (-(-sizes // CELL_ROWS)).tolist())))
    row = "list long, place long, rid long, tops binary"
    index = map_batches(given, _index(pivots, parts, True), f"{row}, sketch binary")
    shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 10_000))
    cell = F.xxhash64("list", F.shiftright("place", 20)).alias("cell")
    index = index.select(cell, "*").repartition(shuffles, "cell").sortWithinPartitions("cell")
    near = materialize(map_batches(index, _candidates(pivots, threshold), row), "candidates")
    near = near.join(classes, "rid").select(cell, "list", "place", "rid", "tops", "weight", "v")
    near = near.repartition(shuffles, "cell").sortWithinPartitions("cell")
    found = materialize(map_batches(near, _verify(threshold), "rid long, links long, root long"), "links")

    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    told = (classes.select("rid", "weight").join(links, "rid", "left").join(roots, F.col("rid") == F.col("node"), "left")
            .select("rid", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("root", "rid").alias("root")))
    named = rows.select("vec_id", "rid").join(told, "rid", "left")
    smallest = materialize(named.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "smallest")
    out = named.join(smallest, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("root").isNotNull(), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
