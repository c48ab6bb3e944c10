"""Benchmark decontamination with one Aho-Corasick automaton.

Test items (questions and answers) are normalised to words, cut into windows of
``window`` consecutive words (an item with fewer words is one window) and put in
one automaton. Each document is normalised the same way and scanned once; hits
are mapped to word numbers and to code point offsets of the original text.

Normalisation works on UTF-8 bytes: A-Z become a-z, and every ASCII byte that is
no digit or letter becomes a space, so byte offsets stay those of the original.

Scale: the automaton is built in each Python worker from the item texts. A window's
pattern repeats its words, so the windows of an item hold up to ``window`` times its bytes, and the
automaton takes about 46 bytes of memory for each of those. Items are therefore sent in
parts whose windows hold at most ``max_pattern_bytes`` (370 MB of memory in a worker); a larger
benchmark is scanned for part by part, in chained maps over the same rows. One item is the least part.
Documents are never shuffled.

Defined results: null or empty text has no words and no hits; null or empty items
have no windows; an item whose id is null still marks words but isn't listed;
repeated items count once; repeated documents are scanned each for itself; other
columns of ``docs`` don't matter and aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_point_offsets, map_batches, small_batches

WINDOW = 10
MAX_PATTERN_BYTES = 8 << 20
_SPACE = 32

#: Every byte's normal form: a-z, 0-9 and bytes of non-ASCII characters stay.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else _SPACE
    for b in range(256)
)

RESULT = ("doc_id long, n_words long, n_hit long, items array<string>, "
          "spans array<struct<start:long,end:long>>")

_AUTOMATA: dict[str, tuple] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[list[bytes]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield words[i:i + window]


def _automaton(key: str, items: list[tuple[str | None, str | None]], window: int) -> tuple:
    """(automaton, words per pattern, item numbers per pattern, item ids), the automaton None without windows;
    kept in the worker under ``key``, the digest of items and window."""
    if key not in _AUTOMATA:
        ids = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(ids)}
        patterns: dict[bytes, int] = {}
        lengths: list[int] = []
        owners: list[set[int]] = []
        for item, text in items:
            for w in windows_of(words_of(text), window):
                p = patterns.setdefault(b" " + b" ".join(w) + b" ", len(lengths))
                if p == len(lengths):
                    lengths.append(len(w))
                    owners.append(set())
                if item is not None:
                    owners[p].add(number[item])
        auto = ahocorasick.Automaton()
        for p, k in patterns.items():
            auto.add_word(p.decode("latin-1"), k)
        auto.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = (auto, lengths, owners, ids) if patterns else (None, lengths, owners, ids)
    return _AUTOMATA[key]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true flags."""
    turn = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def scan(text: str | None, auto: tuple) -> tuple[np.ndarray, set[str]]:
    """A flag for each word of the text (hit or not) and the ids of the items that occur."""
    automaton, lengths, owners, ids = auto
    words = words_of(text)
    hit = np.zeros(len(words), bool)
    if automaton is None or not words:
        return hit, set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return hit, set()
    ends = np.fromiter((e for e, _ in found), np.int64, len(found))
    size = np.fromiter((lengths[k] for _, k in found), np.int64, len(found))
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == _SPACE)
    after = np.searchsorted(spaces, ends)  # number of the word that follows the window
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, after - size, 1)
    np.add.at(edge, after, -1)
    return np.cumsum(edge)[:-1] > 0, {ids[i] for k in {k for _, k in found} for i in owners[k]}


def spans_of(text: str | None, hit: np.ndarray) -> list[dict[str, int]]:
    """Code point ranges of the runs of hit words in the original text."""
    if not hit.any():
        return []
    data = (text or "").encode()
    begins, stops = _runs(np.frombuffer(data.translate(_NORMAL), np.uint8) != _SPACE)
    first, after = _runs(hit)
    start, end = code_point_offsets(data, begins[first]), code_point_offsets(data, stops[after - 1])
    return [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(part: Part, window: int, last: bool):
    """Scan for one part of the items and add to what the parts before have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = part.automaton(window)
        for b in batches:
            n, n_hit, names, spans, runs = [], [], [], [], []
            for text, before, old in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(),
                                         strict=True):
                hit, own = scan(text, auto)
                for r in before:
                    hit[r["start"]:r["end"]] = True
                n.append(len(hit))
                names.append(sorted(own.union(old)))
                if last:
                    n_hit.append(int(hit.sum()))
                    spans.append(spans_of(text, hit))
                else:
                    runs.append([{"start": s, "end": e} for s, e in zip(*map(np.ndarray.tolist, _runs(hit)))])
            names = pa.array(names, pa.list_(pa.string()))
            if last:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), names, pa.array(spans, _SPANS)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, _SPANS), names],
                                                 names=["doc_id", "text", "runs", "items"])

    return run


class Part(NamedTuple):
    """Items sent to the tasks, and the digest of items and window."""

    key: str
    items: Broadcast

    def automaton(self, window: int) -> tuple:
        return _automaton(self.key, self.items.value, window)


def _item_parts(items: DataFrame, item_col: str, item_text_col: str, window: int, max_pattern_bytes: int) -> list[Part]:
    """The items in broadcasts whose patterns have a bounded size."""
    given = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("t")).distinct()
    size = given.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) * window // max_pattern_bytes))
    out = []
    for k in range(parts):
        mine = given.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k) if parts > 1 else given
        rows = sorted(map(tuple, mine.collect()), key=repr)
        out.append(Part(hashlib.sha256(repr((window, rows)).encode()).hexdigest(), items.sparkSession.sparkContext.broadcast(rows)))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, spans``.

    ``items``: ids (as strings, sorted) of the test items that have a window in the text;
    ``spans``: code point ranges of the runs of hit words.
    """
    parts = _item_parts(items, item_col, item_text_col, window, max_pattern_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.lit(None).cast("array<struct<start:long,end:long>>").alias("runs"),
                       F.lit(None).cast("array<string>").alias("items"))
    rows = rows.withColumns({"runs": F.coalesce("runs", F.array().cast("array<struct<start:long,end:long>>")),
                             "items": F.coalesce("items", F.array().cast("array<string>"))})
    for k, sent in enumerate(parts):  # without a shuffle between the passes
        last = k == len(parts) - 1
        rows = map_batches(rows, _scan_batches(sent, window, last),
                           RESULT if last else "doc_id long, text string, "
                           "runs array<struct<start:long,end:long>>, items array<string>")
    return rows


def _hit_udf(part: Part, window: int):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        auto = part.automaton(window)
        return pd.Series([bool(scan(t, auto)[0].any()) for t in texts], dtype=bool)

    return hit


def is_contaminated(items: DataFrame, text: Column, *, item_col: str = "item_id", item_text_col: str = "text",
                    window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> Column:
    """Whether any window of any item occurs in a text; false for null texts."""
    small_batches(items.sparkSession)
    out = F.lit(False)
    for sent in _item_parts(items, item_col, item_text_col, window, max_pattern_bytes):
        out = out | _hit_udf(sent, window)(text.cast("string"))
    return out
