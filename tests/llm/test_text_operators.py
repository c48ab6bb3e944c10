"""Operators on texts against plain Python versions, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import decontaminate as de
from cadence.llm import language_id, pii_crf, secrets
from cadence.llm.shingles import shingle_sets

LOWER = {i: i + 32 for i in range(65, 91)}
CLASH = "doc_id long, text string, n_words string, spans string, base int, items double, row string, lang string"


def clashing(spark, rows):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2.0, "z", "en") for i, t in rows], CLASH)


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "null id"), (5, "é" * 10 + " x"),
        (6, "long " * 60_000)]


# ------------------------------------------------------------------ decontamination

def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, names = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i:i + 10]
            for k in range(len(words) - len(win) + 1):
                if words[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    if item is not None:
                        names.add(str(item))
    return len(words), len(hit), sorted(names)


ITEMS = [(1, "One two, THREE four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, "été à la"),
         (3, None), (4, " ,;"), (None, "no id here"), (10, "short item"), (5, "a a a a a a a a a a a")]


@pytest.mark.parametrize("limit", [1 << 20, 20])
def test_decontamination_equals_brute_force(spark, limit):
    rng = random.Random(3)
    pool = "one two three four five six seven eight nine ten eleven twelve short item été à la no id here a".split()
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, "x One; two three-four five six seven eight NINE ten y"), (101, "a " * 30), (102, ITEMS[0][1] * 2),
             (103, "Short—item short\x00item"), *EDGE]
    got = de.decontaminate(clashing(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string"),
                           max_pattern_bytes=limit).collect()
    assert len(got) == len(docs)
    want = sorted(((d, *brute_hits(t, ITEMS)) for d, t in docs), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got), key=repr) == want


def test_decontamination_spans_map_to_the_original(spark):
    text = "Ü–été, À LA! x Été\tÀ la.. short  ITEM"
    hit, names = de.scan(text, de._automaton("x", [("2", "à la"), ("10", "short item")], 10))
    assert names == {"10"} or names == {"2", "10"}
    assert [text[s["start"]:s["end"]] for s in de.spans_of(text, hit)][-1] == "short  ITEM"


def test_is_contaminated(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = clashing(spark, [(1, "see the SHORT item"), (2, "clean"), (3, None)])
    for limit in (1 << 20, 20):
        got = docs.select("doc_id", de.is_contaminated(items, F.col("text"), max_pattern_bytes=limit).alias("c")).collect()
        assert {r["doc_id"]: r["c"] for r in got} == {1: True, 2: False, 3: False}


# ------------------------------------------------------------------ secrets

def brute_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
        r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_secrets_equal_brute_force():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "ſecret", "secret", "api_key", "apikey", "toKen", "passwd", " ", "=", ":", "==", '"', "'",
             "abc", "abcdef123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "  ", "\n", "-", "/"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s, secrets.KINDS.index(k), e) for s, e, k in secrets.base_spans(t)] == brute_secrets(t), t


def test_battery_tells_random_from_language(spark):
    rng = random.Random(1)
    import base64
    keys = [base64.b64encode(rng.randbytes(33)).decode() for _ in range(20)]
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away from here " * 40
             + " antidisestablishmentarianisms " + (keys[i] if i < 20 else "")) for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(clashing(spark, rows)).collect()}
    found = sum(any(s["kind"] == "random" and rows[i][1][s["start"]:s["end"]] == keys[i] for s in got[i]) for i in range(20))
    assert found >= 18
    assert sum(len(got[i]) for i in range(20, 60)) == 0
    assert secrets.cut_offs([], [], 0.01) == {}


def test_battery_finds_values_of_names_beside_a_hot_source(spark):
    rng = random.Random(4)
    import string

    def key(n):
        return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))

    keys = [key(40) if i % 2 else key(32) for i in range(60)]
    prose = ("the people of this house said that all the water in the old well had come from the hill and that "
             "some more of it would be there at the end of the year if there was rain " * 8).split()
    rows = []
    for i in range(300):
        rng.shuffle(prose)
        if i < 60:
            said = f"AWS_SECRET_ACCESS_KEY={keys[i]}" if i % 2 else f"GET /a?sig={keys[i]}&b=1"
        else:
            said = "\n".join(f"level=info token={key(40)} done" for _ in range(20))
        rows.append((i, " ".join(prose) + " " + said))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(clashing(spark, rows)).collect()}
    found = sum(any(s["kind"] == "random" and rows[i][1][s["start"]:s["end"]] == keys[i] for s in got[i]) for i in range(60))
    assert found >= 54
    assert sum(s["kind"] == "random" for r in got.values() for s in r) == found
    assert all(sum(s["kind"] == "assign" for s in got[i]) == 20 for i in range(60, 300))
    a, b = "ab" * 10, "cd" * 12
    runs = [f"{a}={b}"[s[0]:s[1]] for s in secrets.candidates(f"{a}={b}")]
    assert runs == [a, b] and [s[1] for s in secrets.candidates(f"{a}== x={b}=")] == [22, 50]


def test_random_p_values_are_uniform_enough():
    rng = np.random.default_rng(0)
    s = secrets.scores(rng.integers(0, 64, (4000, 64)), 64)
    # three p-values: about chi-squared with 6 degrees; 95 % below 12.6
    assert 0.9 < (s < 12.6).mean() < 0.99


def test_secret_scan_edges(spark):
    got = secrets.scan_secrets(clashing(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and all(len(r["spans"]) == 0 for r in got)
    assert secrets.scan_secrets(clashing(spark, [])).count() == 0


# ------------------------------------------------------------------ personal data

def brute_pii(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_pii_equals_brute_force():
    rng = random.Random(7)
    parts = ["a.b", "@", "x", ".", "com", "1", "255", "0300", "256", "4111111111111111", "4111 1111", "-", " ", "+", "49", "(30)",
             "1234567", "٣", "é", "\n", "5500-0000-0000-0004"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(pii_crf.KINDS[k], s, e) for k, s, e in pii_crf.base_spans(t)] == brute_pii(t), t


def enumerate_marginals(nodes, f):
    """Exact marginals by summing over all labellings."""
    import itertools
    chain, skip = pii_crf.links_of(nodes)
    k = len(pii_crf.LABELS)
    out = np.zeros((len(nodes), k))
    for y in itertools.product(range(k), repeat=len(nodes)):
        if any(n["label"] and n["label"] != v for n, v in zip(nodes, y)):
            continue
        s = sum(f["prior"][v] + sum(f[t][n[t], v] for t in pii_crf.TABLES[:3]) for n, v in zip(nodes, y) if not n["label"])
        s += sum(f["chain"][y[i], y[j]] for i, j in chain) + sum(f["skip"][y[i], y[j]] for i, j in skip)
        out[range(len(nodes)), y] += np.exp(s)
    return out / out.sum(axis=1, keepdims=True)


TEXTS = ["card 4111 1111 1111 1111 then 4111.1111.1111.1111 and call +49 30 1234567 or (030) 1234567",
         "john.smith@example.com wrote; john.smith again", "ip 10.0.0.1, 10.0.0.1", "nothing here", "+1 (314) 555-6532 4663622617512349"]


def test_messages_are_exact_without_loops_and_spans_agree():
    nodes = [pii_crf.nodes_of(t, pii_crf.base_spans(t)) for t in TEXTS]
    counts: dict = {}
    for own in nodes * 20:
        for c in pii_crf.contexts(own):
            counts[c] = counts.get(c, 0) + 1
    f = pii_crf.potentials([(*c, n) for c, n in counts.items()])
    for own in nodes:
        if own:
            chain, skip = pii_crf.links_of(own)
            got, exact = pii_crf.marginals(own, f), enumerate_marginals(own, f)
            if len({*chain, *skip}) < len(own):  # a tree: messages are exact
                assert np.allclose(got, exact, atol=1e-3)
            assert (got.argmax(axis=1) == exact.argmax(axis=1)).all()
    t = TEXTS[0]
    new = pii_crf.new_spans(nodes[0], f)
    assert ("card", "4111.1111.1111.1111") in [(pii_crf.KINDS[k], t[s:e]) for k, s, e in new]
    assert ("phone", "(030) 1234567") in [(pii_crf.KINDS[k], t[s:e]) for k, s, e in new]


def test_pii_edges_and_masking(spark):
    rows = EDGE + [(20 + i, t) for i, t in enumerate(TEXTS)] + [(30, "mail a@b.cd"), (30, "mail a@b.cd")]
    got = pii_crf.find_personal_data(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = {tuple(s) for s in r["base"]}
        assert base <= {tuple(s) for s in r["spans"]}
    out = pii_crf.masked(clashing(spark, rows))
    assert out.columns == clashing(spark, []).columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] is None and texts[4] == "word" and texts[30] == "mail [EMAIL]" and texts[23] == "nothing here"
    assert pii_crf.find_personal_data(clashing(spark, [])).count() == 0
    assert pii_crf.mask("abcdef", [(0, 1, 3), (1, 2, 4)]) == "a[EMAIL]ef"


@pytest.mark.parametrize("unit", ["1", "a", "1.", "1 ", "a@", "a.b@c.d ", "+1 ", "(1) 2-", "1.2.3.4.", "joe.smith@x.org joe.smith ", "1a"])
def test_long_texts_take_linear_time(unit):
    """Four times the text takes about four times as long, whatever it repeats."""
    took = []
    for n in (30_000, 120_000):
        t = (unit * n)[:n] + " @x y@z.de"
        start = time.perf_counter()
        nodes = pii_crf.nodes_of(t, pii_crf.base_spans(t))
        took.append(time.perf_counter() - start)
        assert isinstance(nodes, list)
    assert took[1] < 9 * max(took[0], 0.02), took


def _planted(rng, n):
    """Documents with an address, phone or card, the same again in a form that no pattern knows, and other numbers."""
    docs, truth = [], []
    for i in range(n):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        name = f"{rng.choice(['jo', 'ann', 'max'])}.{rng.choice(['smith', 'berger', 'long'])}{rng.randint(1, 99)}"
        kind = i % 3
        first, again = ((f"+1 {a} {b} {c}", f"1/{a}/{b}/{c}"), (f"{name}@example.org", name.title()),
                        ("4111 1111 1111 1111", "4111.1111.1111.1111"))[kind]
        other = f"{rng.randint(100, 999)}/{rng.randint(100, 999)}/{rng.randint(1000, 9999)}"
        text = f"Please write to {first} about order {other}. " + "words " * 40 + f" Ask for {again} here. " + "words " * 30 + f"again {first} or {first} end"
        docs.append(text)
        truth.append((("phone", "email", "card")[kind], again, other))
    return docs, truth


def test_skip_links_recover_repeats():
    """Without skip links the repeats in other forms are lost; other numbers are left alone either way."""
    docs, truth = _planted(random.Random(5), 300)
    nodes = [pii_crf.nodes_of(t, pii_crf.base_spans(t)) for t in docs]
    counts = {}
    for own in nodes[:200]:
        for c in pii_crf.contexts(own):
            counts[c] = counts.get(c, 0) + 1
    f = pii_crf.potentials([(*c, n) for c, n in counts.items()])
    without = f | {"skip": np.zeros_like(f["skip"])}
    recall, wrong = {}, {}
    for name, factors in (("with", f), ("without", without)):
        new = [{(pii_crf.KINDS[k], t[s:e]) for k, s, e in pii_crf.new_spans(own, factors)} for own, t in zip(nodes[200:], docs[200:])]
        recall[name] = sum((kind, again) in got for got, (kind, again, _) in zip(new, truth[200:]))
        wrong[name] = sum(any(x == other for _, x in got) for got, (*_, other) in zip(new, truth[200:]))
    assert recall["with"] >= 90 and recall["without"] <= recall["with"] - 50, recall
    assert wrong["with"] <= 2, wrong


def test_potentials_climb_the_pseudo_likelihood():
    """The fitted weights are a maximum: the penalised pseudo-likelihood, written out, falls in every direction tried."""
    docs, _ = _planted(random.Random(6), 60)
    counts = {}
    for t in docs:
        for c in pii_crf.contexts(pii_crf.nodes_of(t, pii_crf.base_spans(t))):
            counts[c] = counts.get(c, 0) + 1
    f = pii_crf.potentials([(*c, n) for c, n in counts.items()])

    def objective(w):
        total = -sum(((w[t] - (pii_crf.AGREE * np.eye(5) if t == "skip" else 0)) ** 2).sum() for t in w) / 2 / pii_crf.SPREAD ** 2
        for (size, form, cue, c1, c2, s1, s2, y), n in counts.items():
            score = w["prior"] + w["size"][size] + w["form"][form] + w["cue"][cue]
            for t, js in (("chain", (c1, c2)), ("skip", (s1, s2))):
                score = score + sum(w[t][j] for j in js if j >= 0)
            total += n * (score[y] - np.log(np.exp(score).sum()))
        return total
    best = objective(f)
    rng = np.random.default_rng(2)
    for _ in range(40):
        t = rng.choice(list(f))
        d = rng.normal(size=f[t].shape)
        d = (d + d.T) / 2 if t in ("chain", "skip") else d
        d *= 0.5 / np.abs(d).max()
        assert objective(f | {t: f[t] + d}) < best + 0.02


# ------------------------------------------------------------------ language

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    assert 0 < (model.weights != 0).mean() < 0.5  # sparse
    got = language_id.with_language(docs, model).select("lang", "language.*", language_id.held_out().alias("h"))
    held = [r for r in got.collect() if r["h"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    again = language_id.fit(docs)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_language_edges(spark):
    words = {"en": "the and of with that", "fr": "le la et dans avec"}
    rows = [(i, " ".join([words[y]] * 5), y) for i in range(60) for y in words] + [
        (900, None, "en"), (901, "", None), (902, "123 !!", "fr"), (903, "the and of", None), (None, "le la et", "fr")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = {r["doc_id"]: r["language"] for r in language_id.with_language(docs, language_id.fit(docs)).collect()}
    assert [tuple(out[k]) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[903]["lang_pred"] == "en" and out[None]["lang_pred"] == "fr"
    empty = docs.limit(0)
    assert language_id.with_language(empty, language_id.fit(empty)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["language"]["lang_pred"] for r in language_id.with_language(none, language_id.fit(none)).collect()} == {"und"}


# ------------------------------------------------------------------ shingles

def test_shingles_equal_sets_of_words():
    rng = random.Random(2)
    texts = [None, "", "  ", "a", "A  b\tc", "a b c d e", "x\na b c d e f"] + [
        " ".join(rng.choice("aB cé ſ  d".split(" ")) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    seen: dict = {}
    for t, (_, n, s) in zip(texts, shingle_sets(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert n == len(w) and len(s) == len(want)
        for a, (ws, ss) in seen.items():
            assert len(np.intersect1d(s, ss)) == len(want & ws)
        if len(seen) < 25:
            seen[t] = (want, s)



# ------------------------------------------------------------------ hot ids, roles, memory bounds

def test_language_sample_is_of_rows_not_of_ids(spark):
    """A language whose rows share one id, or are copies, is learned, and the sample is bounded."""
    from cadence.llm import language_id as li
    rng = random.Random(8)
    en = ["the", "river", "and", "house", "with", "water", "that", "there"]
    de_ = ["der", "fluss", "und", "haus", "mit", "wasser", "dass", "dort"]
    ok = [r["id"] for r in spark.range(60).withColumnRenamed("id", "doc_id").where(~li.held_out()).selectExpr("doc_id as id").collect()]
    for hot in ok[:5]:
        rows = [(hot, " ".join(rng.choices(en, k=30)), "en") for _ in range(3000)]
        rows += [(None, "der fluss und das haus am wasser", "de")] * 2000
        rows += [(ok[6 + i % 20], " ".join(rng.choices(de_, k=30)) if i % 2 else None, "de") for i in range(40)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = li.fit(df, per_language=100)
        assert model.labels == ["de", "en"]
        assert model.predict("the water and the river")[0] == "en" and model.predict("das wasser und der fluss")[0] == "de"


def test_language_model_against_a_dense_textbook_version(spark):
    """TF-IDF, FTRL-proximal and temperature of the sparse code equal those written out densely."""
    from cadence.llm import language_id as li
    rng = np.random.default_rng(4)
    examples = []
    for i in range(30):
        at = np.sort(rng.choice(50, 6, replace=False)).astype(np.int64)
        examples.append((at, rng.random(6), int(i % 3)))
    got = li.ftrl(examples, 3, epochs=2)
    z, n, w = np.zeros((li.DIM + 1, 3)), np.zeros((li.DIM + 1, 3)), np.zeros((li.DIM + 1, 3))
    order = np.random.default_rng(1)
    for _ in range(2):
        for i in order.permutation(len(examples)):
            at, v, y = examples[i]
            x = np.zeros(li.DIM + 1)
            x[at], x[li.DIM] = v, 1.0
            for f in np.flatnonzero(x):
                for c in range(3):
                    w[f, c] = 0.0 if abs(z[f, c]) <= li.L1 else -(z[f, c] - math.copysign(li.L1, z[f, c])) / (
                        (li.BETA + math.sqrt(n[f, c])) / li.ALPHA + li.L2)
            logits = x @ np.where(x[:, None] != 0, w, 0.0)
            p = np.exp(logits - logits.max())
            p /= p.sum()
            for f in np.flatnonzero(x):
                for c in range(3):
                    g = (p[c] - (c == y)) * x[f]
                    s = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / li.ALPHA
                    z[f, c] += g - s * w[f, c]
                    n[f, c] += g * g
    want = np.where(np.abs(z) <= li.L1, 0.0, -(z - np.sign(z) * li.L1) / ((li.BETA + np.sqrt(n)) / li.ALPHA + li.L2))
    assert np.allclose(got, want) and (want != 0).any()
    logits, y = rng.normal(size=(200, 3)) * 4, rng.integers(0, 3, 200)

    def loss(t):
        p = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return -np.log((p / p.sum(axis=1, keepdims=True))[np.arange(200), y]).mean()
    best = li.fit_temperature(logits, y)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-4, 4, 200))) + 1e-6


def test_patterns_are_bounded_by_their_bytes(spark):
    """Windows repeat words: the parts count pattern bytes, and every part's patterns stay near the bound."""
    rng = random.Random(3)
    items = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 9999)}" for _ in range(200))) for i in range(40)], "item_id long, text string")
    bound = 60_000
    parts = de._item_parts(items, "item_id", "text", 10, bound)
    sizes = [sum(len(b" ".join(w)) for _, t in p.items.value for w in de.windows_of(de.words_of(t))) for p in parts]
    assert len(parts) > 5 and max(sizes) < 3 * bound and sum(len(p.items.value) for p in parts) == 40
    assert len({p.key for p in parts}) == len(parts)


def test_scanning_time_of_long_texts_is_linear():
    items = [(str(i), " ".join(f"a{j}" for j in range(i, i + 10))) for i in range(50)]
    auto = de._automaton("linear", items, 10)
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"a{i % 60}" for i in range(n))
        start = time.perf_counter()
        hit, _ = de.scan(text, auto)
        took.append(time.perf_counter() - start)
        assert len(hit) == n
    assert took[1] < 10 * max(took[0], 0.01)


# ------------------------------------------------------------------ false discoveries by form

def _prose(rng, n):
    words = ("the of and to in that house water people old well hill year rain would there some more came from said had been small "
             "great light under every north window paper train letter green summer answer market river question number history "
             "kitchen garden morning picture office simple letter report version update index server config path").split()
    return [rng.choice(words) for _ in range(n)]


def _form_runs(rng, kind):
    w = _prose(rng, 8)
    return {"upper": "".join(w).upper()[:rng.randint(20, 50)], "camel": "".join(x.title() for x in w)[:rng.randint(20, 50)],
            "lower": "".join(w)[:rng.randint(20, 50)], "digits": "".join(rng.choice("0123456789") for _ in range(rng.randint(20, 40))),
            "slug": "-".join(w)[:rng.randint(24, 50)], "snake": "_".join(x.upper() for x in w)[:rng.randint(24, 50)],
            "path": "/" + "/".join(w)[:rng.randint(24, 50)], "camel_path": "/" + "/".join(x.title() for x in w)[:rng.randint(24, 50)]}[kind]


@pytest.mark.parametrize("with_keys", [False, True])
def test_false_discoveries_of_every_form(spark, with_keys):
    """Runs of language in all forms stay below the bound, alone and beside real keys of each encoding, which are found."""
    import base64
    rng = random.Random(12)
    kinds = ("upper", "camel", "lower", "digits", "slug", "snake", "path", "camel_path")
    rows, truth = [], {}
    for i in range(1500):
        words = _prose(rng, 700)
        kind = kinds[i % len(kinds)]
        said = [("run", kind, _form_runs(rng, kind))]
        if with_keys and i % 3 == 0:
            raw = rng.randbytes(30)
            key = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode(), base64.b32encode(raw).decode(),
                   raw.hex().upper()][i // 3 % 4]
            said.append(("key", ["base64", "base64url", "base32", "hex"][i // 3 % 4], key))
        text = " ".join(words[:300])
        for what, kind, run in said:
            truth[i, len(text) + 1] = (what, kind)
            text += f" {run} " + " ".join(words[300:340])
        rows.append((i, text))
    found = {}
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        for s in r["spans"]:
            if s["kind"] == "random":
                t = truth.get((r["doc_id"], s["start"])) or truth.get((r["doc_id"], s["start"] - 1), ("other", "prose"))
                found[t] = found.get(t, 0) + 1
    wrong = sum(n for (what, _), n in found.items() if what != "key")
    keys = sum(n for (what, _), n in found.items() if what == "key")
    assert wrong <= max(3, 0.02 * keys), found  # the bound of one in a hundred, with room for chance
    if with_keys:
        assert keys >= 0.9 * 500, found
        assert all(n >= 0.75 * 125 for (what, _), n in found.items() if what == "key"), found
