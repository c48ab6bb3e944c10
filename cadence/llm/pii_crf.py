"""Personal data: base patterns and a skip-chain conditional random field.

Base kinds (email, ip, card, phone) are found by pattern and checks. The nodes of the field are
the base spans and every other stretch that could be one of them in another form: long runs of digits with
any of the usual separators, parts of such runs in the form of a phone or card, and separate occurrences of a mail address's local part. Labels are
``O`` and the four kinds. Potentials, as log-linear factors:

* node: number of digits, form (separators, prefix), cue word just before;
* chain: labels of neighbouring nodes that stand within ``NEAR`` characters;
* skip: labels of nodes with the same key, however far apart: equal last digits, or equal local part of
  an address. Each node is linked with the next of its key, so a token repeated k times has k - 1 links.

The potentials maximise the pseudo-likelihood (each label given its neighbours') of all nodes of all documents
whose label is known: base spans have theirs, nodes that resemble no base span of their document are ``O``, the
rest are hidden and not counted. Of a token that repeats, every base span but the first is masked: it gets the form that
it would have without its pattern, so its label can only be recovered from its size, its cue and its
neighbours, which is what hidden nodes need. A context is a handful of small numbers, so all documents together have a
bounded table of contexts and counts (at most ``MAX_CONTEXTS``; more is an error), on which the gradient is followed on
the driver. Base spans are clamped; loopy sum-product
messages (damped, synchronous, until they settle or ``MAX_ROUNDS``) give the marginals of the others, and
a node whose most likely label isn't ``O`` is a new span of that kind.

Scale: the texts are read in one map; nodes with their factors' indices (no text) are written to the shared
folder, the contexts are one small table, and inference is one map over documents that have hidden
nodes. Work per document is linear in its length and its nodes.

Defined results: null text is empty; equal rows are judged each for itself; new spans never overlap
base spans, which all stay; an empty table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded, map_batches, materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PHONE_LIKE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])")
CARD_LIKE = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])")
#: Digits with at most two separators between them, whole.
LOOSE = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9])*")
ENOUGH = re.compile(r"[0-9](?:[^0-9]{0,2}[0-9]){6}")  # no pattern of nodes needs fewer digits
#: Words that say what comes next (fixed values, lower case).
CUES = (
    ("email", "e-mail", "mail", "correo", "courriel"),
    ("ip", "host", "server", "address"),
    ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "telefon", "téléphone", "teléfono"),
)
CUE = re.compile(r"([^\W\d_]+)\W*$")
CUE_CHARS = 24
NEAR = 80
KEY_DIGITS = 7
DIGIT_STEPS = (1, 7, 9, 13, 16, 20)
FORMS = 8
MAX_ROUNDS = 30
DAMPING = 0.3
#: Weights are drawn to 0, those of equal labels on skip links to ``AGREE``, with this standard deviation.
SPREAD, AGREE = 3.0, 2.0
STEPS, RATE = 400, 0.1
MAX_CONTEXTS = 500_000
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    found = []
    end = 0
    # the name before each '@', as far back as the last address; the characters of a name hold no '@'
    for m in LOCAL.finditer(text) if "@" in text else ():
        if m.end() > end and text.startswith("@", m.end()):
            d = DOMAIN.match(text, m.end())
            if d:
                found.append((0, max(end, m.start()), d.end()))
                end = d.end()
    for m in DOTTED.finditer(text) if text.count(".") > 2 else ():
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):  # four numbers after another, whether small enough or not
            size = sum(map(len, parts[i:i + 4])) + 3
            if all(map(_small, parts[i:i + 4])):
                found.append((1, at, at + size))
            at += size + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def loose(text: str) -> Iterator[tuple[int, int]]:
    """Whole chains of digits and separators. A chain that touches letters (or a dot before it) loses the number there."""
    for m in LOOSE.finditer(text):
        start, end = m.span()
        if end - start < KEY_DIGITS:
            continue
        if end < len(text) and text[end].isascii() and text[end].isalpha():
            end = start + len(text[start:end].rstrip("0123456789").rstrip(" ().-/+"))
        before = text[start - 1:start]
        if before == "." or (before.isascii() and before.isalnum()):
            cut = _FIRST_NUMBER.match(text, start, end)
            start = cut.end() if cut else end
        if end > start:
            yield start, end


#: A chain's first number with the separators after it.
_FIRST_NUMBER = re.compile(r"[+(]*[0-9]+[^0-9]*")


def _form(piece: str, digits: str) -> int:
    if "@" in piece:
        return 0
    if piece.startswith("+"):
        return 1
    if len(digits) <= 12 and IP.fullmatch(piece):
        return 2
    if not piece.isdigit():
        return 5 if not digits else 3 if len(digits) > 12 and luhn(digits) else 7
    return 4 if len(digits) > 12 and luhn(digits) else 6


def _cue(text: str, start: int) -> int:
    m = CUE.search(text[max(0, start - CUE_CHARS):start])
    word = m[1].lower() if m else ""
    return next((i + 1 for i, words in enumerate(CUES) if word in words), 0)


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Nodes in text order: place, base label (0: none), factor indices and the skip key."""
    spans = sorted((s, e, k + 1) for k, s, e in base)
    taken: list[tuple[int, int]] = []
    for s, e, _ in spans:
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    begins = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        i = bisect.bisect_left(begins, e) - 1
        return i < 0 or taken[i][1] <= s

    def matches(pattern: re.Pattern) -> Iterator[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(text))

    for places in (matches(PHONE_LIKE), matches(CARD_LIKE), loose(text)) if ENOUGH.search(text) else ():
        more = [(s, e) for s, e in places if free(s, e) and len(_NOT_DIGIT.sub("", text[s:e])) >= KEY_DIGITS]
        spans += [(s, e, 0) for s, e in more]
        taken = sorted(taken + more)
        begins = [s for s, _ in taken]
    names = {text[s:e].partition("@")[0].lower() for s, e, k in spans if k == 1}
    names = {n for n in names if len(n) >= 6 and re.search(r"[._0-9+-]", n)}
    if names:
        longest = max(map(len, names))
        for m in LOCAL.finditer(text):  # a name is a token, or its beginning before a dot
            if text.startswith("@", m.start() - 1) and m.start() or text.startswith("@", m.end()):
                continue
            token = m[0].lower()
            ends = [len(token)] if len(token) <= longest else []
            ends += [i for i in range(min(len(token) - 1, longest), 5, -1) if token[i] == "."]
            size = next((i for i in ends if token[:i] in names), 0)
            if size and free(m.start(), m.start() + size):
                spans.append((m.start(), m.start() + size, 0))
    out = []
    for s, e, k in sorted(spans):
        piece = text[s:e]
        digits = _NOT_DIGIT.sub("", piece)
        name = piece.partition("@")[0].lower()
        key = name if k == 1 or name in names else digits[-KEY_DIGITS:] if len(digits) >= KEY_DIGITS else piece
        out.append({"start": s, "end": e, "label": k, "size": bisect.bisect_right(DIGIT_STEPS, len(digits)),
                    "form": _form(piece, digits), "cue": _cue(text, s), "key": key})
    return out


def links_of(nodes: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of near neighbours and skip links of nodes with one key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1]["start"] - nodes[i]["end"] <= NEAR]
    last: dict[str, int] = {}
    skip = []
    for i, n in enumerate(nodes):
        if n["key"] in last:
            skip.append((last[n["key"]], i))
        last[n["key"]] = i
    return chain, skip


def known_labels(nodes: list[dict]) -> list[int]:
    """Labels for training: base spans have theirs, nodes unlike any base span are O, others -1."""
    keys = {n["key"] for n in nodes if n["label"]}
    return [n["label"] if n["label"] else -1 if n["key"] in keys else 0 for n in nodes]


TABLES = ("size", "form", "cue", "chain", "skip")
_WIDTH = {"size": len(DIGIT_STEPS) + 1, "form": FORMS, "cue": len(CUES) + 1, "chain": len(LABELS), "skip": len(LABELS)}
#: Forms of base spans -> the form that the span would have if no pattern told it.
MASKED = {0: 5, 1: 7, 2: 7, 3: 7, 4: 6}


def contexts(nodes: list[dict]) -> list[tuple[int, ...]]:
    """(size, form, cue, two chain neighbours' labels, two skip neighbours' labels, label) of the nodes with known
    label; -1 for a neighbour that isn't there or isn't known."""
    known = known_labels(nodes)
    near = {"chain": [[] for _ in nodes], "skip": [[] for _ in nodes]}
    chain, skip = links_of(nodes)
    for name, links in (("chain", chain), ("skip", skip)):
        for i, j in links:
            near[name][i].append(known[j])
            near[name][j].append(known[i])
    later = {j for _, j in skip}  # not the first of its key
    out = []
    for i, (n, y) in enumerate(zip(nodes, known)):
        if y < 0:
            continue
        form = MASKED.get(n["form"], n["form"]) if n["label"] and i in later else n["form"]
        told = [sorted(near[t][i] + [-1, -1])[-2:] for t in ("chain", "skip")]
        out.append((n["size"], form, n["cue"], *told[0], *told[1], y))
    return out


def potentials(counts: list[tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Weights of the factors that maximise the pseudo-likelihood of ``contexts`` with their numbers (last)."""
    k = len(LABELS)
    weights = {"prior": np.zeros((1, k))} | {t: np.zeros((_WIDTH[t], k)) for t in TABLES}
    centre = {t: w.copy() for t, w in weights.items()}
    centre["skip"] = AGREE * np.eye(k)
    weights = {t: w.copy() for t, w in centre.items()}
    rows = np.array(sorted(counts), np.int64).reshape(-1, 9)
    n, y = rows[:, 8].astype(float), rows[:, 7]
    scale = max(n.sum(), 1.0)
    # every term: its table, and the row of the table for each context; -1 adds nothing
    terms = [("prior", np.zeros(len(rows), np.int64))] + [(t, rows[:, i]) for i, t in enumerate(("size", "form", "cue", "chain", "chain", "skip", "skip"))]
    mean = {t: np.zeros_like(w) for t, w in weights.items()}
    square = {t: np.zeros_like(w) for t, w in weights.items()}
    for step in range(1, STEPS + 1):
        score = np.zeros((len(rows), k))
        for t, at in terms:
            score += np.where((at >= 0)[:, None], weights[t][np.maximum(at, 0)], 0.0)
        p = np.exp(score - score.max(axis=1, keepdims=True)) if len(rows) else score
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        error = -p * n[:, None]
        error[np.arange(len(rows)), y] += n
        slope = {t: (centre[t] - w) / SPREAD ** 2 for t, w in weights.items()}
        for t, at in terms:
            np.add.at(slope[t], at[at >= 0], error[at >= 0])
        for t, g in slope.items():
            g = (g + g.T) / 2 / scale if t in ("chain", "skip") else g / scale
            mean[t] = 0.9 * mean[t] + 0.1 * g
            square[t] = 0.99 * square[t] + 0.01 * g * g
            move = mean[t] / (1 - 0.9 ** step) / (np.sqrt(square[t] / (1 - 0.99 ** step)) + 1e-12)
            weights[t] += RATE * (1 - step / (STEPS + 1)) * move
    weights["prior"] = weights["prior"][0]
    return weights


def marginals(nodes: list[dict], factors: dict[str, np.ndarray]) -> np.ndarray:
    """Beliefs of every node by loopy sum-product messages; base nodes are clamped."""
    k = len(LABELS)
    own = np.array([factors["prior"] + sum(factors[t][n[t]] for t in TABLES[:3]) for n in nodes])
    for i, n in enumerate(nodes):
        if n["label"]:
            own[i] = -30.0
            own[i, n["label"]] = 0.0
    chain, skip = links_of(nodes)
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    src = np.concatenate((pairs[:, 0], pairs[:, 1]))
    dst = np.concatenate((pairs[:, 1], pairs[:, 0]))
    joint = np.array([factors["chain"]] * len(chain) + [factors["skip"]] * len(skip)).reshape(-1, k, k)
    joint = np.concatenate((joint, joint.transpose(0, 2, 1)))  # from src's label to dst's
    m = len(pairs)
    back = np.concatenate((np.arange(m, 2 * m), np.arange(m)))
    told = np.zeros((2 * m, k))
    for _ in range(MAX_ROUNDS if m else 0):
        belief = own.copy()
        np.add.at(belief, dst, told)
        out = belief[src] - told[back]
        x = out[:, :, None] + joint
        top = x.max(axis=1, keepdims=True)
        new = (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
        new -= new.max(axis=1, keepdims=True)
        new = DAMPING * told + (1 - DAMPING) * new
        moved = np.abs(new - told).max()
        told = new
        if moved < 1e-3:
            break
    belief = own.copy()
    np.add.at(belief, dst, told)
    e = np.exp(belief - belief.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def new_spans(nodes: list[dict], factors: dict[str, np.ndarray]) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the nodes without base label whose likeliest label is a kind; the leftmost
    of overlapping ones."""
    out: list[tuple[int, int, int]] = []
    best = marginals(nodes, factors).argmax(axis=1)
    end = -1
    for n, y in zip(nodes, best.tolist()):
        if not n["label"] and y and n["start"] >= end:
            out.append((y - 1, n["start"], n["end"]))
            end = n["end"]
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_NODE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("size", pa.int32()),
                            ("form", pa.int32()), ("cue", pa.int32()), ("key", pa.string())]))
_CONTEXT = ("size", "form", "cue", "chain1", "chain2", "skip1", "skip2", "label")
_CONTEXTS = pa.list_(pa.struct([(c, pa.int32()) for c in _CONTEXT]))
SPANS = "array<struct<kind:int,start:int,end:int>>"
NODES = "array<struct<start:int,end:int,label:int,size:int,form:int,cue:int,key:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base, nodes, seen = [], [], []
        for t in b.column(1).to_pylist():
            found = base_spans(t or "")
            own = nodes_of(t or "", found)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            nodes.append(own if any(not n["label"] for n in own) else [])
            seen.append([dict(zip(_CONTEXT, c)) for c in contexts(own)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, _SPAN), pa.array(nodes, _NODE),
                                          pa.array(seen, _CONTEXTS)], names=["doc_id", "base", "nodes", "contexts"])


def read_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, nodes, contexts`` per document, written once; nodes only where some label is hidden."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(map_batches(rows, _read, f"doc_id long, base {SPANS}, nodes {NODES}, "
                                   f"contexts array<struct<{','.join(f'{c}:int' for c in _CONTEXT)}>>"), "pii")


def train(read: DataFrame) -> dict[str, np.ndarray]:
    """Potentials from the contexts of all documents."""
    counts = read.select(F.inline("contexts")).groupBy(*_CONTEXT).count()
    return potentials([tuple(r) for r in collect_bounded(counts, MAX_CONTEXTS, "contexts")])


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` per document: arrays of (kind number, start, end), by kind, then start."""
    read = read_nodes(docs, id_col, text_col)
    factors = docs.sparkSession.sparkContext.broadcast(train(read))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, nodes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                more = new_spans(nodes, factors.value) if nodes else []
                every = sorted([(s["kind"], s["start"], s["end"]) for s in base] + more)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPAN)],
                                             names=["doc_id", "base", "spans"])

    return map_batches(read.select("doc_id", "base", "nodes"), infer, f"doc_id long, base {SPANS}, spans {SPANS}")


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by kinds."""
    spark = docs.sparkSession
    small_batches(spark)
    factors = spark.sparkContext.broadcast(train(read_nodes(docs, id_col, text_col)))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            base = base_spans(t or "")
            nodes = nodes_of(t or "", base)
            out.append(mask(t, base + (new_spans(nodes, factors.value) if nodes else [])))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
