"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: at every word a row of five lead columns (the word and the four after it,
padded where the piece ends), one count per distinct window. ``ROLLUP`` over the five columns then sums
the windows that share their first four, three or two words, which are the counts of all shorter phrases, so there
is no explosion per phrase length.

A phrase that occurs ``least`` times consists of words and neighbouring pairs that occur as often, so windows are
padded where a pair can't. Pair hashes are counted for that in one aggregation, and the pairs that may be frequent
are marked in a bitmap of bounded size sent to the tasks; a false mark only leaves a longer window, whose
count decides. Words are 64-bit hashes of language and word until the phrases are known.

Scores are exact: products are decimals of up to 38 digits and divided as integers.

Defined cases: null texts have no words, a null language is ``und``, a very long text is one row whose windows are
dealt out by their own hash, repeated rows count as often as they stand, an empty table gives no rows, and other
columns are ignored. A language may hold any share of the rows: every aggregation combines before it shuffles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Letters to lower, marks and line ends that end a piece, and tabs; and what becomes of them. A mark is no part of
#: any word, so it can stand for itself between words.
MARK = "."
FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ".,;:!?\n\x0b\x0c\r" + "\t"
TO = "abcdefghijklmnopqrstuvwxyz" + MARK * 10 + " "
#: Words in the longest phrase.
ORDER = 5
#: Least occurrences of a candidate.
LEAST = 100
#: Rows reported for each language.
TOP = 2000
#: Bits of the pair bitmap for each frequent pair, and the most bits at all (32 MB).
BITS_PER_PAIR, MOST_BITS = 16, 1 << 28


def tokens(text: Column) -> Column:
    """The words of a text in order, a ``MARK`` wherever a piece ends; may hold empty strings."""
    marked = F.replace(F.translate(F.coalesce(text, F.lit("")), FROM, TO), F.lit(MARK), F.lit(f" {MARK} "))
    return F.split(marked, " +")


def word_code(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, code, f``: occurrences of every word of each language."""
    words = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(tokens(F.col("text"))).alias("word"))
    words = words.filter((F.col("word") != "") & (F.col("word") != MARK))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))
    return counts.withColumn("code", word_code(F.col("lang"), F.col("word")))


def coded(docs: DataFrame) -> DataFrame:
    """``codes``: the tokens of each document as word codes, null where a piece ends (or a string is empty)."""
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select(F.transform(tokens(F.col("text")), lambda w: F.when((w != MARK) & (w != ""), word_code(lang, w))).alias("codes"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and for each whether it is the last of its piece."""
    rows = batch.column(0)
    flat = rows.flatten()
    word = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    last = np.ones(len(values), bool)
    last[:-1] = ~word[1:]  # the next token is no word
    ends = np.cumsum(np.diff(rows.offsets.to_numpy()))
    last[ends[ends > 0] - 1] = True
    return values[word], last[word]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    f = first.view(np.uint64)
    return (((f << np.uint64(17)) | (f >> np.uint64(47))) ^ second.view(np.uint64)).view(np.int64)


def pair_counts(codes: DataFrame) -> DataFrame:
    """``pair, n``: occurrences of the hash of every two neighbouring words, counted by batch, then summed."""
    def task(batches):
        for batch in batches:
            values, last = _flat(batch)
            pairs, n = np.unique(pair_hash(values[:-1], values[1:])[~last[:-1]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return map_batches(codes, task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Words of a bitmap in which the hash of every row of ``pairs`` is marked; its size follows their number, up to
    ``MOST_BITS``."""
    n = pairs.count()
    bits = 1 << min(max(int(np.ceil(np.log2(BITS_PER_PAIR * max(n, 1)))), 10), int(np.log2(MOST_BITS)))
    at = F.col("pair").bitwiseAND(F.lit(bits - 1))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = (pairs.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(mark).alias("m")).toArrow())  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def runs(codes: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``run``: the longest stretches of pieces all of whose pairs may be frequent, of two words or more."""
    sent = codes.sparkSession.sparkContext.broadcast(bitmap)

    def task(batches):
        marks = sent.value
        for batch in batches:
            values, last = _flat(batch)
            if len(values) < 2:
                continue
            pair = pair_hash(values[:-1], values[1:]).view(np.uint64) & np.uint64(len(marks) * 64 - 1)
            on = (marks[(pair >> np.uint64(6)).astype(np.int64)] >> (pair & np.uint64(63))) & np.uint64(1)
            tied = (on == 1) & ~last[:-1]  # word i and the next belong together
            cut = np.concatenate(([0], np.flatnonzero(~tied) + 1, [len(values)]))
            long = np.diff(cut) > 1
            inside = np.repeat(long, np.diff(cut))
            offsets = np.concatenate(([0], np.cumsum(np.diff(cut)[long]))).astype(np.int32)
            run = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[inside]))
            yield pa.RecordBatch.from_arrays([run], names=["run"])

    return map_batches(codes, task, "run array<long>")


def phrase_counts(stretches: DataFrame, least: int, order: int = ORDER) -> DataFrame:
    """``codes, a``: phrases of 2 to ``order`` words that occur at least ``least`` times.

    Padding is null in the lead columns; a prefix that reaches into it is no phrase.
    """
    lead = [f"w{i}" for i in range(1, order + 1)]
    shifted = F.arrays_zip(*[F.slice("run", i, F.size("run")).alias(c) for i, c in enumerate(lead, 1)])
    windows = stretches.select(F.inline(shifted)).toDF(*lead)
    longest = windows.groupBy(*lead).agg(F.count(F.lit(1)).alias("n"))
    # grouping_id has one bit for each column summed away, the last column's lowest
    prefixes = longest.rollup(*lead).agg(F.grouping_id().alias("away"), F.sum("n").alias("a")).filter(F.col("a") >= least)
    kept = reduce(lambda x, y: x | y, [(F.col("away") == (1 << (order - k)) - 1) & F.col(f"w{k}").isNotNull()
                                       for k in range(2, order + 1)])
    # codes are never null, so null lead columns are those summed away or padding after the phrase
    return prefixes.filter(kept).select(F.filter(F.array(*lead), lambda w: w.isNotNull()).alias("codes"), "a")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """``codes, lang, a, l, r, n, score`` at the lowest-scoring cut of each phrase."""
    counts = phrases.select("codes", "a").unionByName(words.select(F.array("code").alias("codes"), F.col("f").alias("a")))
    cuts = phrases.select("codes", "a", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("codes", F.lit(1), F.col("k")).alias("first"),
                       F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select(F.col("codes").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(counts.select(F.col("codes").alias("rest"), F.col("a").alias("r")), "rest")
    lang = words.select("lang", F.col("code").alias("_code")).join(totals, "lang")
    cuts = cuts.join(lang, F.element_at("codes", 1) == F.col("_code"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    # 1000 fits the smaller factor's width: a <= n
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * big["a"]).cast("decimal(19,0)") * big["n"], big["l"] * big["r"])
    cuts = cuts.select("codes", "lang", "a", "l", "r", "n", "k", score.cast("long").alias("score"))
    return cuts.groupBy("codes", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select(
        "codes", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def not_contained(phrases: DataFrame, candidates: DataFrame) -> DataFrame:
    """``candidates`` without those inside a longer phrase that occurs as often.

    A longer phrase never occurs more often than one inside it, so any such container implies one that is a word
    longer; phrases of one word less are looked up from both ends.
    """
    m = F.size("codes")
    inner = phrases.filter(m > 2).select(
        F.explode(F.array(F.slice("codes", F.lit(1), m - 1), F.slice("codes", F.lit(2), m - 1))).alias("codes"),
        F.col("a").alias("longer"))
    most = inner.groupBy("codes").agg(F.max("longer").alias("longer"))
    return candidates.join(most, "codes", "left").filter("longer is null or longer < a").drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, order: int = ORDER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases."""
    docs = docs.select("text", "lang")
    counted = materialize(word_counts(docs), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = materialize(counted.filter(F.col("f") >= least), "frequent-words")
    codes = coded(docs)
    pairs = materialize(pair_counts(codes).filter(F.col("n") >= least), "frequent-pairs")
    phrases = materialize(phrase_counts(runs(codes, pair_bitmap(pairs)), least, order), "phrases")
    found = materialize(not_contained(phrases, scored(phrases, words, totals)), "scored-phrases")
    spelled = (found.select("codes", F.posexplode("codes").alias("at", "code")).join(words.select("code", "word"), "code")
               .groupBy("codes").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("parts")))
    named = found.join(spelled, "codes").select(
        "lang", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("phrase"), "a", "l", "r", "n", "score")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
