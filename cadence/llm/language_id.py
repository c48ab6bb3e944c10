"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF values of character 1- to 3-grams of the lower-cased letters (all else is
one space), hashed to ``DIM`` numbers. The weights are learned by follow-the-regularised-leader
with elastic-net penalties, which leaves most of them exactly zero; one temperature, fitted on a
part of the sample that the weights haven't seen, calibrates the scores.

Document frequencies come from every training document. The weights are fitted on a bounded
sample: about ``per_language`` documents of each language, taken by a hash of the id and the number
of documents of the language, so no group is sorted or gathered. Prediction is one map over whole
texts; the model that it broadcasts has DIM x (number of languages) weights, with at most
``max_languages`` languages.

Defined results: null text or text without letters is ``und`` with score 0; without any labelled
training row every text is ``und``; a very long text is read whole, n-gram by n-gram; null labels are not learned from; equal rows get equal results;
ties between languages go to the smaller label; an empty table gives no rows; other columns of the
input don't matter and are kept by ``with_language``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_bounded, map_batches, small_batches

BITS = 14
DIM = 1 << BITS
PER_LANGUAGE = 800
#: Share of rows beyond ``PER_LANGUAGE`` that is drawn before the exact cut, as distinct rows are counted approximately.
SPARE = 1.3
MAX_LANGUAGES = 200
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
#: A document is left out of training if crc32(id as text) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the text (sorted numbers) and their counts; None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    c = np.where(letter, codes, np.uint32(32))[keep]
    c = np.concatenate((np.array([32], np.uint32), c, np.array([32] * int(c[-1] != 32), np.uint32)))
    grams, run = [], c
    for n in range(3):
        if n:
            run = run[:-1] * np.uint32(0x01000193) + c[n:]
        x = (run ^ (run >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)
        grams.append((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(grams), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1) x labels; the last row is the bias
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        got = ngram_counts(text) if self.labels else None
        if got is None:
            return UNKNOWN, 0.0
        p = softmax(_logits(self.weights, got[0], tf_idf(*got, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def _logits(weights: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ weights[at] + weights[-1]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal, one example at a time."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, x, y = examples[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, df) of the task's texts; gram -1 counts the texts with letters."""
    df = np.zeros(DIM + 1, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            got = ngram_counts(t)
            if got is not None:
                df[got[0]] += 1
                df[DIM] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at == DIM, -1, at)), pa.array(df[at])], names=["gram", "df"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        labels, at, counts = [], [], []
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            got = ngram_counts(t)
            if got is not None:
                labels.append(y)
                at.append(got[0].astype(np.uint16).tobytes())
                counts.append(got[1].astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(at, pa.binary()),
                                          pa.array(counts, pa.binary())], names=["label", "at", "counts"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from the labelled documents that aren't held out."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("label"),
                       F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(~held_out("id") & F.col("label").isNotNull())
    # Rows are sampled by id and text, repeated ones once, so that neither a hot id nor many copies decide.
    rows = rows.withColumn("place", F.xxhash64(F.coalesce("id", F.lit("")), F.coalesce("text", F.lit("")), F.lit(9)))
    held = {r["label"]: r["n"] for r in collect_bounded(rows.groupBy("label").agg(
        F.approx_count_distinct("place", 0.03).alias("n")), max_languages, "languages")}
    labels = sorted(held)
    if not labels:
        return Model([], np.ones(DIM), np.zeros((DIM + 1, 0)), 1.0)
    df = np.zeros(DIM + 1)
    for r in map_batches(rows.select("text"), _frequencies, "gram long, df long").groupBy("gram").agg(
            F.sum("df").alias("df")).collect():  # at most DIM + 1 rows
        df[r["gram"]] = r["df"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    share = F.lit(0.0)
    for label, n in held.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, SPARE * per_language / max(n, 1)))).otherwise(share)
    part = rows.filter(F.pmod("place", F.lit(1 << 24)) / (1 << 24) < share).dropDuplicates(["label", "place"])
    first = Window.partitionBy("label").orderBy("place")
    part = part.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_language)
    some = map_batches(part.select("label", "text"), _sampled, "label string, at binary, counts binary")
    examples = []
    for r in sorted(some.collect(), key=lambda r: (r["at"], r["counts"], r["label"])):  # at most per_language per label
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        examples.append((at, tf_idf(at, np.frombuffer(r["counts"], np.uint32), idf), labels.index(r["label"])))
    if not examples:
        return Model([], idf, np.zeros((DIM + 1, 0)), 1.0)
    mixed = np.random.default_rng(0).permutation(len(examples))
    unseen = [examples[i] for i in mixed[:len(examples) // 5]]
    weights = ftrl([examples[i] for i in mixed[len(examples) // 5:]], len(labels))
    logits = np.array([_logits(weights, at, x) for at, x, _ in unseen]).reshape(len(unseen), len(labels))
    t = fit_temperature(logits, np.array([y for *_, y in unseen], np.int64))
    return Model(labels, idf, weights.astype(np.float32), t)


def with_language(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` and a struct ``out`` of ``lang_pred, score``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, predict(F.col(text_col).cast("string")))
