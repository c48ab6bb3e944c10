"""Secret scan: base patterns, and a battery of randomness tests with false-discovery control.

Three base kinds (an assignment to a secret's name, an access key id, a long hex run) are
found by pattern. The battery judges every run of 20 or more characters that an encoded
secret could consist of:

* the encoding is inferred from the characters (hex, base32, base64, base64url), with the form of the run;
* chi-squared of the symbol counts against a uniform alphabet,
* runs above and below the middle of the alphabet (Wald-Wolfowitz),
* serial correlation of neighbouring symbols (lag 1)

give three p-values under "random symbols of that encoding", joined by Fisher's weighted method to
one score: low if the run looks random, high if it looks like language.

What must be controlled is calling language a secret, so the score is turned into a p-value
under "language in the same form". A form is the inferred encoding, the case of the letters and whether
separators stand in the run: ``UPPERCASE``, ``CamelCase``, ``some-slug`` and ``a/path`` score quite unlike prose.
The words of all documents (the candidates and base kinds cut out), spelled in every form, are cut into stretches of each class of length and scored in the form's alphabet. A
candidate's p-value is the share of the null stretches of its form and length class that look at least as
random. Benjamini-Hochberg holds the share of false discoveries at ``fdr``, with weights by
length class (long runs, on which the tests have power, get more of it; weights average 1
over the candidates). A run of digits alone is a number in no key's encoding and is not judged.

Scale: the text is scanned once, in one map; spans and scores are written to the shared
folder, all counts are tables of (length class, form, score bin), whose size doesn't depend
on the data, and the decision is a comparison with one cut-off score per class and form.

Defined results: null text is empty; equal rows are scanned each for itself; without any null
stretch nothing is added by the method; a span that a base kind already has is not reported
again; an empty table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Whole runs; '=' belongs to one only as padding at its end.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")

#: Alphabets in the order of their symbols' values.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Lower ends of the length classes, and the weight that each gets before they are made to average 1.
LENGTHS = (20, 24, 32, 40, 64)
WEIGHTS = (0.5, 0.75, 1.0, 1.25, 1.5)
FDR = 0.01
BIN = 0.5
BINS = 240

_VALUES = {}
for _name, _symbols in ENCODINGS.items():
    _VALUES[_name] = np.full(128, -1, np.int64)
    for _v, _c in enumerate(_symbols):
        _VALUES[_name][ord(_c)] = _v
for _v, _c in enumerate("ABCDEF"):
    _VALUES["hex"][ord(_c)] = 10 + _v


#: Encoding, case of the letters, and separators of a run, as text.
FORMS = ("hex", "base32", *(f"{e} {case}" for e in ("base64", "base64 joined", "base64url joined") for case in ("lower", "upper", "mixed")))
_ALPHABET = {f: f.split()[0] for f in FORMS}


def form_of(run: str) -> str | None:
    """The smallest alphabet that holds the run, the case of its letters and whether separators join it; None for digits."""
    body = run.rstrip("=")
    if body.isdigit():
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32"
    case = "upper" if body == body.upper() else "lower" if body == body.lower() else "mixed"
    if re.search(r"[-_]", body):
        return f"base64url joined {case}"
    return f"base64 joined {case}" if re.search(r"[+/]", body) else f"base64 {case}"


#: Bytes that aren't symbols of an encoding; every byte's letter or digit, else a space.
_NOT = {e: bytes(b for b in range(256) if chr(b) not in symbols) for e, symbols in ENCODINGS.items()}
_WORDS = bytes(b if chr(b).isascii() and chr(b).isalnum() else 32 for b in range(256))


def spellings(text: bytes) -> Iterator[tuple[str, bytes]]:
    """Language in every form: the words of ``text`` in its case, joined by its separator, in its alphabet."""
    words = b" ".join(text.translate(_WORDS).split())
    for case, cased in (("lower", words.lower()), ("upper", words.upper()), ("mixed", words.title())):
        if case == "lower":
            yield "hex", cased.translate(None, _NOT["hex"])
        if case == "upper":
            yield "base32", cased.translate(None, _NOT["base32"])
        yield f"base64 {case}", cased.replace(b" ", b"")
        yield f"base64 joined {case}", cased.replace(b" ", b"/")
        yield f"base64url joined {case}", cased.replace(b" ", b"-")


#: ln of the upper tail of the normal distribution, for interpolation.
_Z = np.arange(-8, 37, 0.01)
_LN_TAIL = np.array([math.log(0.5 * math.erfc(z / math.sqrt(2))) for z in _Z])


def _ln_tail(z: np.ndarray) -> np.ndarray:
    return np.interp(z, _Z, _LN_TAIL)


#: Weights of the three tests in Fisher's sum: language differs from random symbols most by its counts. At 32
#: characters equal weights find 94 to 98 of 100 base64 keys at a share of 1 in 300 of CamelCase, these 98 to 99.
CHI, RUNS, SERIAL = 2.0, 0.5, 0.5


def scores(values: np.ndarray, k: int) -> np.ndarray:
    """Fisher's -2 sum(w ln p) of the three tests for each row of symbols 0..k-1; about 6 if random."""
    m, n = values.shape
    counts = np.bincount((values + k * np.arange(m)[:, None]).ravel(), minlength=k * m).reshape(m, k)
    chi = ((counts - n / k) ** 2).sum(axis=1) * k / n
    df = k - 1  # Wilson-Hilferty: the cube root of chi-squared / df is nearly normal
    ln_chi = _ln_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = values >= k // 2
    up = high.sum(axis=1)
    mean = 1 + 2 * up * (n - up) / n
    turns = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    ln_runs = np.minimum(0, math.log(2) + _ln_tail(np.abs(turns - mean) / np.sqrt(var)))
    ln_runs = np.where((up == 0) | (up == n), (1 - n) * math.log(2), ln_runs)  # all on one side
    centred = values - (k - 1) / 2
    product = (centred[:, 1:] * centred[:, :-1]).sum(axis=1)
    ln_serial = np.minimum(0, math.log(2) + _ln_tail(np.abs(product) / ((k * k - 1) / 12 * math.sqrt(n - 1))))
    return -2 * (CHI * ln_chi + RUNS * ln_runs + SERIAL * ln_serial)


def bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, (score / BIN).astype(np.int64))


def score_bin(run: str, form: str) -> int:
    encoding = _ALPHABET[form]
    # a run that mixes the separators of two encodings has symbols outside of both: they count as the last one
    values = _VALUES[encoding][np.frombuffer(run.rstrip("=").encode("ascii"), np.uint8)]
    return int(bins(scores(np.where(values < 0, len(ENCODINGS[encoding]) - 1, values)[None, :], len(ENCODINGS[encoding])))[0])


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int, int, str, int]]:
    """(start, end, length class, form, score bin) of the runs to be judged."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        body = run.rstrip("=")
        if len(body) < LENGTHS[0]:
            continue
        form = form_of(run)
        if form is not None:
            found.append((m.start(), m.end(), length_class(len(body)), form, score_bin(run, form)))
    return found


def language_of(text: str, base: list[tuple[int, int, str]], tried: list[tuple[int, int, int, str, int]]) -> bytes:
    """The text in ASCII (other characters part words), base spans and candidates (they may overlap) cut out."""
    if base or tried:
        parts, at = [], 0
        for start, end in sorted(s[:2] for s in (*base, *tried)):
            parts.append(text[at:start])
            at = max(at, end)
        text = " ".join([*parts, text[at:]])
    return text.encode("ascii", "replace")


#: Symbols of one stretch of every length.
CYCLE = sum(LENGTHS)


class Null:
    """Score counts of language in every form; what doesn't fill a cycle of stretches waits for more text."""

    def __init__(self) -> None:
        self.rest = dict.fromkeys(FORMS, b"")

    def counts(self, text: bytes) -> dict[str, np.ndarray]:
        """Counts (length class, bin) by form of the stretches that ``text`` completes."""
        out = {}
        for form, letters in spellings(text):
            letters = self.rest[form] + letters
            whole = len(letters) // CYCLE * CYCLE
            self.rest[form] = letters[whole:]
            if whole:
                out[form] = null_counts(letters[:whole], _ALPHABET[form])
        return out


def null_counts(letters: bytes, encoding: str) -> np.ndarray:
    """Score counts (length class, bin) of consecutive stretches of all lengths, over and over."""
    out = np.zeros((len(LENGTHS), BINS), np.int64)
    values = _VALUES[encoding][np.frombuffer(letters, np.uint8)].reshape(-1, CYCLE)
    at = 0
    for c, n in enumerate(LENGTHS):
        for i in range(0, len(values), 4096):
            out[c] += np.bincount(bins(scores(values[i:i + 4096, at:at + n], len(ENCODINGS[encoding]))), minlength=BINS)
        at += n
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_TRIED = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cls", pa.int64()), ("form", pa.string()),
                    ("bin", pa.int64())])
_NULL = pa.struct([("cls", pa.int64()), ("form", pa.string()), ("bin", pa.int64()), ("n", pa.int64())])
SCANNED = ("doc_id long, base array<struct<start:long,end:long,kind:string>>, "
           "tried array<struct<start:long,end:long,cls:long,form:string,bin:long>>, "
           "language array<struct<cls:long,form:string,bin:long,n:long>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(lists, kind):
        names = [f.name for f in kind]
        return pa.array([[dict(zip(names, x)) for x in r] for r in lists], pa.list_(kind))

    null = Null()
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        base = [base_spans(t) for t in texts]
        tried = [candidates(t) for t in texts]
        counts = null.counts(b" ".join(map(language_of, texts, base, tried)))
        language = [[(c, f, x, n[c, x]) for f, n in counts.items() for c, x in zip(*map(np.ndarray.tolist, np.nonzero(n)))]]
        yield pa.RecordBatch.from_arrays(  # the counts of the whole batch stand in its first row
            [b.column(0), rows(base, _SPAN), rows(tried, _TRIED),
             rows(language + [[]] * (len(texts) - 1), _NULL)], names=["doc_id", "base", "tried", "language"])


def cut_offs(tried: list[tuple[int, str, int, int]], language: list[tuple[int, str, int, int]], fdr: float = FDR
             ) -> dict[tuple[int, str], int]:
    """Highest score bin that counts as a discovery, by length class and form.

    ``tried``: (class, form, bin, count) of the candidates; ``language``: (class, form, bin, count) of the null.
    Without null stretches of a form and class, no run of it is a discovery.
    """
    null: dict[tuple[int, str], np.ndarray] = {}
    for c, f, b, n in language:
        null.setdefault((c, f), np.zeros(BINS))[b] += n
    share = {k: (1 + n.cumsum()) / (1 + n.sum()) for k, n in null.items()}
    none = np.ones(BINS)
    total = sum(n for *_, n in tried)
    if not total:
        return {}
    mean = sum(WEIGHTS[c] * n for c, _, _, n in tried) / total
    ranked = sorted((share.get((c, f), none)[b] * mean / WEIGHTS[c], c, f, b, n) for c, f, b, n in tried)
    limit, seen, i = -1.0, 0, 0
    while i < len(ranked):
        p = ranked[i][0]
        while i < len(ranked) and ranked[i][0] == p:
            seen += ranked[i][4]
            i += 1
        if p <= fdr * seen / total:
            limit = p
    out: dict[tuple[int, str], int] = {}
    for p, c, f, b, _ in ranked:
        if p <= limit:
            out[c, f] = max(b, out.get((c, f), -1))
    return out


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``doc_id, spans`` per document: array of (start, kind number, end, kind), by start, then kind."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(map_batches(rows, _scan, SCANNED), "secrets")
    tried = scanned.select(F.inline("tried")).groupBy("cls", "form", "bin").count().collect()
    language = scanned.select(F.inline("language")).groupBy("cls", "form", "bin").agg(F.sum("n")).collect()
    cuts = cut_offs([tuple(r) for r in tried], [tuple(r) for r in language], fdr)

    def found(t: Column) -> Column:
        hit = F.lit(False)
        for (c, f), b in sorted(cuts.items()):
            hit = hit | ((t["cls"] == c) & (t["form"] == f) & (t["bin"] <= b))
        return hit

    def ordered(s: Column, kind: Column) -> Column:
        number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)
        return F.struct(s["start"].alias("start"), number.alias("place"), s["end"].alias("end"), kind.alias("kind"))

    new = F.filter("tried", lambda t: found(t) & ~F.exists(
        F.col("base"), lambda s: (s["start"] <= t["start"]) & (s["end"] >= t["end"])))
    spans = F.concat(F.transform("base", lambda s: ordered(s, s["kind"])),
                     F.transform(new, lambda t: ordered(t, F.lit("random"))))
    return scanned.select("doc_id", F.array_sort(spans).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
