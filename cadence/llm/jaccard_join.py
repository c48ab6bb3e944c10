"""N-gram Jaccard join with signature trees.

Documents link when 100 * |A and B| >= 80 * |A or B| for their sets of five-word shingles.
The result is exact but for collisions of 64-bit hashes. Steps, all distributed:

1. Texts with equal word sequences are one class (``rid``). Common shingles are counted in
   each task and summed; the most common ones (a bounded list) come last in the order below.
2. Prefix filter: with shingles in any one order, two linked sets share a shingle among the
   first n - ceil(0.8 n) + 1 of each. Each class sends these keys, packed by bucket; a key
   that is known to be common is dealt to cells of salt pairs. Keys with one class, or without two classes of
   like size, end here, and of keys with the same classes one is enough. The groups that remain are counted,
   and large ones dealt to pairs of blocks, so no tree gets a hot key whole.
3. Signature trees: in each cell, a leaf holds the bitmap of one class's shingles (at least
   twice as many bits as shingles) and inner nodes the OR of their children with their range
   of sizes. A dual traversal from the root drops every pair of nodes whose largest possible
   overlap is too small for any pair below; what remains gives a spanning forest of possible
   links, never all pairs.
4. Components of possible links are split into blocks of bounded size; each pair of blocks
   of like sizes gets the whole sets of its members, goes through the trees again, and
   verifies pairs on the sets until every pair is verified, refuted or already connected.
5. Components of verified links; a document's component is its smallest reachable doc_id.

Every broadcast is bounded: the list of common shingles has ``max_frequent`` entries (it sets
the order of the filter only, so its length never changes results), and the filter of step 4
has a checked size. Nothing of the documents is collected to the driver.

Defined results: null or empty texts have no shingles and link with nothing; fewer than five
words are one shingle; repeated rows are linked copies; a null doc_id gets a null component and
links with nothing; a very long text is read whole, and its bitmaps grow with its shingles; an empty table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, most_frequent
from .graph import components, local_components
from .shingles import WORDS, shingle_sets, spread
from .url_filter import possible_hits

MAX_FREQUENT = 1_000_000
#: Classes in a cell of a common key, and classes and shingles in a block of a component.
CELL_ROWS = 512
BLOCK_SHINGLES = 1_000_000
FANOUT = 8
#: Bytes of bitmaps of pairs compared at once.
PAIR_BYTES = 2 << 20


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


# ---------------------------------------------------------------- step 1


def _describe(words: int):
    """Per document (doc_id, rid, n), and the shingles that recur within the task (null, key, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "rid", "n", "common"]
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in batches:
            rids, sizes, sets, seen = [], [], [], set()
            for rid, _, s in shingle_sets(b.column(1).to_pylist(), words):
                rids.append(rid)
                sizes.append(len(s))
                if rid not in seen:
                    seen.add(rid)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _i64(np.array(rids, np.uint64)), pa.array(sizes, pa.int64()),
                 pa.array([False] * len(rids))], names=names)
            own, times = np.unique(np.concatenate([keys[:0], *sets]), return_counts=True)
            own, times = own[times > 1], times[times > 1]
            every = np.concatenate((keys, own))
            keys, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, times)), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            k = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(keys[k]), pa.int64()), _i64(keys[k]), pa.array(counts[k], pa.int64()),
                 pa.array([True] * len(keys[k]))], names=names)

    return run


# ---------------------------------------------------------------- step 2


def prefix_length(n: np.ndarray | int):
    return n - (4 * n + 4) // 5 + 1


def _send(frequent, words: int, buckets: int):
    """Packed rows (bucket, keys, rids, sizes) of the prefix keys of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, salts = frequent.value
        for b in batches:
            gids, rids, sizes, seen = [], [], [], set()
            for rid, _, s in shingle_sets(b.column(0).to_pylist(), words):
                if rid in seen or not len(s):
                    continue
                seen.add(rid)
                at = np.searchsorted(common, s)
                hot = np.zeros(len(s), bool)
                if len(common):
                    hot = common[np.minimum(at, len(common) - 1)] == s
                order = np.argsort(hot, kind="stable")[:prefix_length(len(s))]
                keys, hot, at = s[order], hot[order], at[order]
                parts = np.ones(len(keys), np.int64)
                parts[hot] = salts[at[hot]]
                split = parts > 1
                own = [keys[~split]]
                for k, p in zip(keys[split].tolist(), parts[split].tolist()):
                    i = rid % p
                    j = np.arange(p)
                    cell = np.minimum(i, j) * p + np.maximum(i, j) + 1
                    own.append(spread(np.uint64(k) + cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                own = np.concatenate(own)
                gids.append(own)
                rids.append(np.full(len(own), rid, np.uint64))
                sizes.append(np.full(len(own), len(s), np.int32))
            if not gids:
                continue
            gid, rid, size = np.concatenate(gids), np.concatenate(rids), np.concatenate(sizes)
            bucket = (gid >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            gid, rid, size, bucket = gid[order], rid[order], size[order], bucket[order]
            there, first = np.unique(bucket, return_index=True)
            edge = np.append(first, len(bucket))
            yield pa.RecordBatch.from_arrays(
                [_i64(there)] + [pa.array([x[edge[i]:edge[i + 1]].tobytes() for i in range(len(there))], pa.binary())
                                 for x in (gid, rid, size)],
                names=["bucket", "gids", "rids", "sizes"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, rid) of the keys that two classes of like size have; rows come sorted by bucket."""
    held: list[tuple[bytes, bytes, bytes]] = []
    now = None

    def found() -> Iterator[pa.RecordBatch]:
        gid = np.frombuffer(b"".join(h[0] for h in held), np.uint64)
        rid = np.frombuffer(b"".join(h[1] for h in held), np.uint64)
        size = np.frombuffer(b"".join(h[2] for h in held), np.int32).astype(np.int64)
        order = np.lexsort((rid, size, gid))
        gid, rid, size = gid[order], rid[order], size[order]
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (rid[1:] != rid[:-1])
        gid, rid, size = gid[new], rid[new], size[new]
        like = (gid[1:] == gid[:-1]) & (size[1:] * 4 <= size[:-1] * 5)
        keep = np.zeros(len(gid), bool)
        keep[1:] |= like
        keep[:-1] |= like
        gid, rid = gid[keep], rid[keep]
        if not len(gid):
            return
        # Keys with the same members do the same work: the group's name is a hash of its members.
        first = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
        count = np.diff(np.append(first, len(gid)))
        name = spread(np.add.reduceat(spread(rid), first) + count.astype(np.uint64))
        once = np.zeros(len(first), bool)
        once[np.unique(name, return_index=True)[1]] = True
        gid, rid = np.repeat(name, count)[np.repeat(once, count)], rid[np.repeat(once, count)]
        for i in range(0, len(gid), 100_000):
            yield pa.RecordBatch.from_arrays([_i64(gid[i:i + 100_000]), _i64(rid[i:i + 100_000])], names=["gid", "rid"])

    for b in batches:
        for bucket, *blobs in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != now and held:
                yield from found()
                held = []
            now = bucket
            held.append(tuple(blobs))
    if held:
        yield from found()


# ---------------------------------------------------------------- step 3: signature trees


def signature_bits(n: int) -> int:
    """Bits of a bitmap for n shingles: a power of two, at least 2 n and at least 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def signature(s: np.ndarray) -> bytes:
    bits = signature_bits(len(s))
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _fold(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits."""
    half = maps.shape[1] // 2
    return maps[:, :half] | maps[:, half:]


class _Tree:
    """Levels of nodes from the leaves up; each has an OR-combined bitmap, a range of sizes, and the
    least number of bits that any leaf below must share with a linked one."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        ones = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, ones - size // 5)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, need = self.levels[-1]
            first = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, first), np.minimum.reduceat(lo, first),
                                np.maximum.reduceat(hi, first), np.minimum.reduceat(need, first)))


def _children(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes x among n, and which of x each belongs to."""
    kids = (x[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    own = np.repeat(np.arange(len(x)), FANOUT)
    there = kids < n
    return kids[there], own[there]


def _overlapping(x: _Tree, y: _Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal: pairs of leaves whose overlap may be large enough."""
    depth = max(len(x.levels), len(y.levels)) - 1
    a = b = np.zeros(1, np.int64)
    for d in range(depth, -1, -1):
        la, lb = min(d, len(x.levels) - 1), min(d, len(y.levels) - 1)
        if d < depth:
            if la < len(x.levels) - 1:
                kids, own = _children(a, len(x.levels[la][0]))
                a, b = kids, b[own]
            if lb < len(y.levels) - 1:
                kids, own = _children(b, len(y.levels[lb][0]))
                a, b = a[own], kids
        if same and la == lb:
            a, b = a[a <= b], b[a <= b]
        (ma, loa, hia, na), (mb, lob, hib, nb) = x.levels[la], y.levels[lb]
        near = (loa[a] * 4 <= hib[b] * 5) & (lob[b] * 4 <= hia[a] * 5)
        a, b = a[near], b[near]
        kept = []
        step = max(16, PAIR_BYTES // (8 * ma.shape[1]))
        for i in range(0, len(a), step):
            p, q = a[i:i + step], b[i:i + step]
            shared = np.bitwise_count(ma[p] & mb[q]).sum(axis=1, dtype=np.int64)
            fits = (shared >= na[p]) & (shared >= nb[q])
            if d == 0:  # leaves: shingles missing in the other must leave 4/9 of both sizes
                least = (4 * (loa[p] + lob[q]) + 8) // 9
                ones_p, ones_q = na[p] + loa[p] // 5, nb[q] + lob[q] // 5
                fits &= (ones_p - shared <= loa[p] - least) & (ones_q - shared <= lob[q] - least)
            kept.append(fits)
        keep = np.concatenate(kept) if kept else np.zeros(0, bool)
        a, b = a[keep], b[keep]
    if same:
        a, b = a[a < b], b[a < b]
    return a, b


def possible_pairs(size: np.ndarray, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members whose overlap may reach the similarity, by their bitmaps."""
    kinds: dict[int, np.ndarray] = {}
    bits = np.fromiter(map(len, maps), np.int64, len(maps))
    for k in np.unique(bits):
        at = np.flatnonzero(bits == k)
        kinds[int(k)] = at[np.argsort(size[at], kind="stable")]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k, at in kinds.items():
        own = np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1)
        tree = _Tree(own, size[at])
        a, b = _overlapping(tree, tree, True)
        left.append(at[a])
        right.append(at[b])
        if 2 * k in kinds:
            up = kinds[2 * k]
            wide = np.frombuffer(b"".join(maps[i] for i in up), np.uint64).reshape(len(up), -1)
            a, b = _overlapping(tree, _Tree(_fold(wide), size[up]), False)
            left.append(at[a])
            right.append(up[b])
    return np.concatenate(left), np.concatenate(right)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one value of the first column at a time; rows come sorted by it."""
    held: dict[str, list] = {}
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in b.schema.names}
        key = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
        first = b.schema.names[0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if held and held[first][0] != cols[first][i]:
                yield held
                held = {}
            for n, c in cols.items():
                held.setdefault(n, []).extend(c[i:j])
    if held:
        yield held


def _forest(rid: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Links of the members to the first of their component."""
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([_i64(rid[moved]), _i64(rid[label[moved]])], names=["a", "b"])


def _traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _groups(batches):
        if len(g["rid"]) > 1:
            rid = np.array(g["rid"], np.int64)
            a, b = possible_pairs(np.array(g["n"], np.int64), g["map"])
            if len(a):
                yield _forest(rid, local_components(len(rid), a, b))


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, tuple[int, bytes]] = {}
            for rid, _, s in shingle_sets(b.column(0).to_pylist(), words):
                if len(s) and rid not in out:
                    out[rid] = (len(s), signature(s))
            yield pa.RecordBatch.from_arrays(
                [_i64(np.fromiter(out, np.uint64, len(out))), pa.array([v[0] for v in out.values()], pa.int64()),
                 pa.array([v[1] for v in out.values()], pa.binary())], names=["rid", "n", "map"])

    return run


# ---------------------------------------------------------------- step 4


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, bytes] = {}
            for rid, _, s in shingle_sets(b.column(0).to_pylist(), words):
                if len(s):
                    out[rid] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [_i64(np.fromiter(out, np.uint64, len(out))), pa.array(list(out.values()), pa.binary())],
                names=["rid", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the verified links in each cell."""
    for g in _groups(batches):
        n = len(g["rid"])
        if n < 2:
            continue
        rid = np.array(g["rid"], np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in g["shingles"]]
        size = np.fromiter(map(len, sets), np.int64, n)
        a, b = possible_pairs(size, [signature(s) for s in sets])
        label = np.arange(n)
        while len(a):  # some pairs at a time; those that are connected by then need no check
            good = []
            for i, j in zip(a[:256].tolist(), b[:256].tolist()):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                good.append(100 * both >= 80 * (size[i] + size[j] - both))
            good = np.array(good)
            label = local_components(n, np.concatenate((np.arange(n), a[:256][good])),
                                     np.concatenate((label, b[:256][good])))
            a, b = a[256:], b[256:]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        yield _forest(rid, label)


def _cells(roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cell, rid): members of each component, in pairs of blocks if it is large.

    Blocks hold members whose sizes have equal numbers of bits; linked sizes differ by at most one bit.
    """
    member = roots.select(F.col("node").alias("rid"), "root").join(sizes, "rid").withColumn(
        "cls", F.length(F.bin("n")).cast("long"))
    held = member.groupBy("root", "cls").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.col("c") / CELL_ROWS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("long")
    held = held.withColumn("k", blocks)
    above = held.select("root", (F.col("cls") - 1).alias("cls"), F.col("k").alias("up"))
    below = held.select("root", (F.col("cls") + 1).alias("cls"), F.col("k").alias("down"))
    whole = held.groupBy("root").agg(F.sum("c").alias("tc"), F.sum("s").alias("ts"))
    held = (held.join(above, ["root", "cls"], "left").join(below, ["root", "cls"], "left").join(whole, "root")
            .select("root", "cls", "k", F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("down", F.lit(0)).alias("down"),
                    ((F.col("tc") <= CELL_ROWS) & (F.col("ts") <= BLOCK_SHINGLES)).alias("one")))
    held = materialize(held, "blocks")  # so that the join can split a hot root
    at = member.join(held, ["root", "cls"]).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("k")))
    i, cls, long = F.col("i"), F.col("cls"), "array<long>"

    def each(count, made):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), made)).otherwise(
            F.array().cast(long))

    pairs = F.concat(
        each(F.col("k"), lambda j: F.xxhash64("root", cls, F.lit(0), F.least(i, j), F.greatest(i, j))),
        each(F.col("up"), lambda j: F.xxhash64("root", cls, F.lit(1), i, j)),
        each(F.col("down"), lambda j: F.xxhash64("root", cls - 1, F.lit(1), j, i)))
    return at.select("rid", F.explode(F.when(F.col("one"), F.array(F.xxhash64("root"))).otherwise(pairs)).alias("cell"))


def _dealt(met: DataFrame, cell_rows: int) -> DataFrame:
    """(cell, rid): each group of ``met``, or each pair of blocks of ``cell_rows`` of a group of more than four times as
    many members, whatever was known of its key before (a cell of a key that was dealt already has two blocks)."""
    heavy = met.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 4 * cell_rows).select(
        "gid", F.ceil(F.col("c") / cell_rows).cast("long").alias("k"))
    heavy = materialize(heavy, "heavy-groups")
    if heavy.isEmpty():
        return met.select(F.col("gid").alias("cell"), "rid")
    at = met.join(heavy, "gid", "left").withColumn("i", F.pmod(F.xxhash64("rid"), F.col("k")))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1),
                         lambda j: F.xxhash64("gid", F.least(F.col("i"), j), F.greatest(F.col("i"), j)))
    return at.select(F.explode(F.when(F.col("k").isNull(), F.array("gid")).otherwise(blocks)).alias("cell"), "rid")


# ---------------------------------------------------------------- the join


def word_hash(text: Column, words: int = WORDS) -> Column:
    """Hash of the text's word sequence: the ``rid`` of ``jaccard_components``."""

    @F.pandas_udf("long")
    def rid(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([h for h, *_ in shingle_sets(texts.tolist(), words)], np.uint64).view(np.int64))

    return rid(text.cast("string"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       max_frequent: int = MAX_FREQUENT, cell_rows: int = CELL_ROWS, with_rid: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; ``with_rid``, also the hash of its word sequence."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    told = materialize(map_batches(given, _describe(words), "doc_id long, rid long, n long, common boolean"), "classes")
    rows = told.filter("not common")
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(32, total[0] // 2000)
    common = told.filter("common").groupBy("rid").agg(F.sum("n").alias("times")).filter(F.col("times") >= least)
    keys, times = most_frequent(common, "rid", "times", max_frequent)
    keys, parts = keys.view(np.uint64), -(-times // cell_rows)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], parts[order]))

    own = given.filter("doc_id is not null").select("text")
    buckets = max(shuffles, math.ceil(total[1] / 4_000_000))
    sent = map_batches(own, _send(frequent, words, buckets), "bucket long, gids binary, rids binary, sizes binary")
    sent = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = _dealt(materialize(map_batches(sent, _meet, "gid long, rid long").distinct(), "met"), cell_rows)
    marked = map_batches(own, _signatures(words), "rid long, n long, map binary")
    marked = marked.groupBy("rid").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    cells = met.join(marked, "rid").select("cell", "rid", "n", "map")
    cells = cells.repartition(buckets, "cell").sortWithinPartitions("cell")
    roots = components(map_batches(cells, _traverse, "a long, b long"))

    classes = rows.filter("doc_id is not null").groupBy("rid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    placed = materialize(_cells(roots, classes.select("rid", "n")), "cells")
    wanted = placed.select("rid").distinct().join(classes, "rid").select("rid", "doc_id")
    probe = given.withColumn("key", F.col("doc_id"))
    texts = possible_hits(probe, materialize(wanted, "wanted").select(F.col("doc_id").alias("key"))).select("text")
    sets = map_batches(texts, _whole_sets(words), "rid long, shingles binary")
    sets = sets.join(placed.select("rid").distinct(), "rid", "left_semi").groupBy("rid").agg(
        F.first("shingles").alias("shingles"))
    filled = placed.join(sets, "rid").select("cell", "rid", "shingles")
    filled = filled.repartition(buckets, "cell").sortWithinPartitions("cell")
    linked = components(map_batches(filled, _verify, "a long, b long"))

    at = rows.filter("n > 0 and doc_id is not null").join(linked, rows.rid == linked.node, "left").select(
        "doc_id", F.coalesce("root", "rid").alias("root"))
    # written, so that the join below can split a hot root
    smallest = materialize(at.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    carried = ["rid"] if with_rid else []
    named = rows.join(linked, rows.rid == linked.node, "left").select(
        "doc_id", "n", *carried, F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("root", "rid")).alias("root"))
    return named.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *carried)
