"""Similarity joins, URL filter, chat format, mixing and HTML against plain Python versions, and edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import chat_format as cf
from cadence.llm import html_extract as hx
from cadence.llm import jaccard_join as jj
from cadence.llm import mixing, pivot_index, url_filter
from cadence.llm.graph import components, local_components

LOWER = {i: i + 32 for i in range(65, 91)}


def reach(nodes, links):
    """Smallest node reachable, by plain search."""
    near = {n: {n} for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


# ------------------------------------------------------------------ components

def test_components_of_chain_star_and_random_graph(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 900)]
    links += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(250)] + [(-5, 7), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = np.array([3, 1, 5, 0]), np.array([4, 3, 6, 0])
    assert local_components(7, a, b).tolist() == [0, 1, 2, 1, 1, 5, 5]


# ------------------------------------------------------------------ n-gram Jaccard join

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_join(docs):
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2)
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    root = reach({d for d, _ in sets}, links)
    return sorted(((d, len(shingles(t)), root.get(d)) for d, t in docs), key=repr)


def near_copies(seed, groups=12, size=8):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(vocab) for _ in range(15))  # a passage that many share
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w) + (" " + common if rng.random() < 0.5 else ""))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # small cells and blocks: salted keys, pairs of blocks
        monkeypatch.setattr(jj, "CELL_ROWS", 3)
        monkeypatch.setattr(jj, "BLOCK_SHINGLES", 300)
    docs = near_copies(seed) + [(900, None), (901, ""), (902, "  "), (903, "A b"), (904, "a  B"), (905, "a b c"),
                               (None, "A b"), (906, "A b"), (906, "A b")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, rid string, n int")
    got = jj.jaccard_components(df, cell_rows=3 if seed == 2 else 512).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_join(docs)


def test_common_shingles_are_salted_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(jj, "CELL_ROWS", 8)
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(100)]
    docs = []
    for i in range(150):  # one large group of near copies: every shingle is common
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = jj.jaccard_components(df, cell_rows=8).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_join(docs)


def test_tree_traversal_keeps_every_link():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 5))):
            s = base.copy()
            k = int(len(s) * rng.random() * 0.2)
            s[:k] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(s))
    size = np.array([len(s) for s in sets])
    a, b = jj.possible_pairs(size, [jj.signature(s) for s in sets])
    kept = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    linked = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
              if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= kept and len(kept) < 3 * len(linked) + 200


def test_join_of_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ vectors

def brute_vectors(rows):
    good = [(i, v, np.array(e, float)) for i, (v, e) in enumerate(rows)
            if e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links = [(a, b) for (a, _, x), (b, _, y) in itertools.combinations(good, 2)
             if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    root = reach(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, math.inf), rows[i][0])
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((rows[i][0], n[i], least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("cell", [1024, 5])
def test_vectors_equal_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(pivot_index, "CELL_ROWS", cell)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        c = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((c + rng.normal(size=16) * 0.08).tolist())
    rows += [rows[0], rows[0], None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, None] * 8,
             [1.0, 2.0], [2.0, 4.0], [], [5.0], [7.0]]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, rid string, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivot_index.near_duplicates(df).collect())
    want = brute_vectors(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)  # recall
    assert all(g[1] <= w[1] for g, w in zip(got, want))  # and no false link
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0


def test_recall_on_links_near_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.92 * x + math.sqrt(1 - 0.92**2) * noise
    pivots = pivot_index.choose_pivots(x[:1000].tolist(), 128)[64]
    a, b = pivot_index.nearest(x, pivots), pivot_index.nearest(y, pivots)
    shared = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2))
    assert (shared >= 2).mean() >= 0.95


@pytest.mark.parametrize("dim", [64, 256])
@pytest.mark.parametrize("wanted", [632, 2000, pivot_index.MAX_PIVOTS])
def test_recall_at_the_threshold_with_many_pivots(dim, wanted):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.9 * x + math.sqrt(1 - 0.9**2) * noise
    pivots = pivot_index.choose_pivots(rng.normal(size=(wanted * 5 // 4, dim)).tolist(), wanted)[dim]
    assert len(pivots) == wanted
    a, b = pivot_index.nearest(x, pivots), pivot_index.nearest(y, pivots)
    shared = np.array([len(np.intersect1d(p, q)) for p, q in zip(a, b)])
    assert (shared >= 2).mean() >= 0.96


@pytest.mark.parametrize("mean,most", [(0.0, 0.1), (0.5, 0.25), (0.8, 1.0)])
def test_recall_of_narrow_embeddings(spark, mean, most):
    """Links just above the threshold among vectors of mean cosine 0, 0.5 and 0.8 are found, by comparing that share of the pairs."""
    rng = np.random.default_rng(7)
    n, dim = 1500, 48
    common = np.zeros(dim)
    common[0] = 1.0

    def around(m):
        u = rng.normal(size=(m, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        x = math.sqrt(mean) * common + math.sqrt(1 - mean) * u
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    x = around(n)
    noise = around(300) if mean else rng.normal(size=(300, dim))
    low, high = np.zeros((300, 1)), np.ones((300, 1))
    for _ in range(40):  # partners at cosines a little above 0.9
        t = (low + high) / 2
        y = x[:300] + t * (noise - x[:300])
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        c = (x[:300] * y).sum(axis=1, keepdims=True)
        low, high = np.where(c > 0.905, t, low), np.where(c > 0.905, high, t)
    y = x[:300] + low * (noise - x[:300])
    every = np.concatenate((x, y))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_duplicates(df).collect()}
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sum(got.values()) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in got)
    fitted = pivot_index.choose_pivots(every[rng.permutation(len(every))].tolist(), 84)[dim]
    tops = pivot_index.nearest(unit, fitted)
    w = pivot_index.rank_weights(tops, len(fitted))
    compared = np.triu(((w > 0).astype(np.float32) @ (w > 0).astype(np.float32).T >= 2) & (w @ w.T >= fitted.least), 1).sum()
    assert compared <= most * len(every) ** 2 / 2, compared / (len(every) ** 2 / 2)


def test_rank_aware_counts_see_the_order():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [4, 3, 2, 1], [1, 5, 6, 7], [8, 9, 5, 6]])
    w = pivot_index.rank_weights(a, 10)
    count = w @ w.T
    assert count[0, 1] == pivot_index.largest_count(4) > count[0, 2] > count[0, 3] > count[0, 4] == 0
    pairs = {(int(x), int(y)) for i, j in pivot_index.counted_pairs(a, 20.0) for x, y in zip(i, j)}
    assert pairs == {(i, j) for i in range(5) for j in range(i + 1, 5) if count[i, j] >= 20}


def test_very_large_and_small_vectors_are_compared(spark):
    rows = [(1, [1e300, 1e300, 0.0]), (2, [1e-300, 1e-300, 0.0]), (3, [1.0, 1.0, 0.1]), (4, [0.0, 1e-320, 1e300]), (5, [-1.0, -1.0, 0.0])]
    got = {r["vec_id"]: r["n_links"] for r in pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}


def test_sketches_lose_no_link():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24)) ** 3
    y = x + rng.normal(size=x.shape) * 0.4 * np.abs(x)
    unit = np.concatenate((x, y))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, scale = pivot_index.sketches(unit)
    a, b = np.triu_indices(len(unit), 1)
    cosine = (unit[a] * unit[b]).sum(axis=1)
    may = pivot_index.may_link(q, scale, a, b, 0.9)
    assert may[cosine >= 0.9].all() and (cosine[may] > 0.8).all() and (cosine >= 0.9).sum() > 100


# ------------------------------------------------------------------ URLs

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("exact.io", "/a", "block")]
URLS = ["http://A.Example.NET/en/x", "https://b.net/", "https://b.net", "http://example.net/de", "HTTP://x.example.com/de/?q",
        "http://x.example.com/de", "http://y.org/fr/#t", "no scheme", None, "", "://", "http://bad.com/p?utm_source=a&b=1",
        "https://www.bad.com/p/?b=1#f", "http://bad.com/p?b=2", "http://exact.io/abc", "http://notexact.io/abc", "a://b://c.net/x",
        "http://net/", "http://xnet/", "http://b.net/"]


def brute_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = m[1].translate(LOWER), m[2]
    fits = [(h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0]), default=None)
    listed = u in ("http://bad.com/p?utm_source=a&b=1", "https://www.bad.com/p/?b=1#f")
    return u, host, path, best and best[0], best[1] if best else "block" if listed else "allow"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_urls_equal_brute_force(spark, limit):
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(URLS * 2)],
                                  "page_id long, url string, key string, listed boolean")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    listed = spark.createDataFrame([("https://bad.com/p?b=1",), (None,)], "url string")
    got = url_filter.filter_urls(pages, listed, rules, max_filter_bytes=limit).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_url(u) for u in URLS * 2]
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, listed.limit(0), rules.limit(0)).collect()} == {"allow"}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    probe = spark.range(30000).select(F.concat(F.lit("u"), F.col("id")).alias("key"))
    passed = {r["key"] for r in url_filter.possible_hits(probe, listed).collect()}
    assert {f"u{i}" for i in range(3000)} <= passed and len(passed) < 3000 + 0.03 * 27000


# ------------------------------------------------------------------ chat

def test_chat_round_trip_of_every_layout(spark):
    nasty = ["", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "a<", "|b", "<<||", "é\n\n", "<|nl|>", "\\", "$1"]
    rows, want = [], []
    for i, t in enumerate(nasty):
        rows.append((i, t, t + "y", None, None, None, None, None))
        want.append([("user", t), ("assistant", t + "y")])
    n = len(nasty)
    rows += [(n, None, None, "ins", None, "out", None, None), (n + 1, None, None, "ins", "in", "out", None, None),
             (n + 2, None, None, None, None, None, [("ro<|im_end|>\nle", t) for t in nasty], None),
             (n + 3, None, None, None, None, None, None, [("human", "h"), ("gpt", None), (None, "z")]),
             (n + 4, "only a prompt", None, None, None, None, None, None), (n + 5, None, None, None, None, None, [], None)]
    want += [[("user", "ins"), ("assistant", "out")], [("system", "ins"), ("user", "in"), ("assistant", "out")],
             [("ro<|im_end|>\nle", t) for t in nasty], [("user", "h"), ("assistant", ""), ("", "z")], None, []]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, prompt string, response string, instruction string, "
                               "input string, output string, messages array<struct<role:string,content:string>>, "
                               "conversations array<struct<from:string,value:string>>, formatted string")
    out = cf.format_chat(cf.canonical_turns(df)).withColumns(
        {"back": cf.read_back(F.col("formatted")), "said": cf.loss_text(F.col("formatted"), F.col("loss_mask"))})
    for r, w in zip(out.orderBy("id").collect(), want):
        assert (None if r["back"] is None else [tuple(t) for t in r["back"]]) == w
        if w is not None:
            assert r["said"] == "".join(t for role, t in w if role == "assistant")
    assert [r["layout"] for r in out.orderBy("id").collect()][n:] == [
        "instruction", "instruction_input", "messages", "conversations", "unknown", "messages"]


def test_gathering_keeps_ties_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "n"),
            (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "<|x")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, messages int")
    out = cf.format_chat(cf.canonical_turns(cf.as_layouts(cf.gather_turns(df)))).withColumn("b", cf.read_back(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["b"]] for r in out.collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("assistant", "b")], 2: [("", "")], None: [("user", "n")],
                   3: [("system", "s"), ("user", "u"), ("assistant", "<|x")]}
    assert cf.gather_turns(df.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = cf.format_chat(cf.canonical_turns(cf.as_layouts(cf.gather_turns(df))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ mixing

def waterfill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] >= 3 * sizes[s]}
        if not over:
            return t | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mix_hits_targets(spark):
    rng = random.Random(9)
    docs = []
    for i in range(3000):
        s = rng.choice(["a"] * 12 + ["b", "c", "d", None, "é"])
        docs.append((i, " ".join(["w"] * rng.choice([1, 5, 20, 300])), s, 1, "x"))
    docs += [(5000, None, "empty", 1, "x"), (5001, "", "empty", 1, "x"), (5002, "w w", "tiny", 1, "x"), (5002, "w w", "tiny", 1, "x"),
             (None, "w", "a", 1, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copies int, target string")
    rows = mixing.mix(df, cell_rows=100).collect()
    assert len(rows) == len(docs)
    sizes: dict = {}
    for _, t, s, *_ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = waterfill(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in own)
        taken = sum(r["copies"] * r["size"] for r in own)
        assert abs(taken - want[s]) <= max(300, 0.03 * want[s]), (s, taken, want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert all(math.floor(rate) <= r["copies"] <= math.ceil(rate) for r in own)
    key = lambda r: (repr(r["doc_id"]), r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(df.repartition(7), cell_rows=100).collect()))
    full = mixing.emit(mixing.mix(df, carry=True))
    assert full.columns == [*df.columns, "mix_copy"] and full.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(df.limit(0)).count() == 0


# ------------------------------------------------------------------ HTML

def test_min_cut_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        cost = np.round(rng.normal(size=n) * 2, 2)
        edges = [(int(i), int(j), float(round(rng.random() * 2, 2))) for i, j in rng.integers(0, n, (2 * n, 2))]

        def energy(keep):
            e = sum(max(c, 0) for c, k in zip(cost, keep) if not k) + sum(max(-c, 0) for c, k in zip(cost, keep) if k)
            return e + sum(w for i, j, w in edges if keep[i] != keep[j])

        best = min(energy(k) for k in itertools.product([False, True], repeat=n))
        assert abs(energy(hx.min_cut(cost, edges)) - best) < 1e-9


def test_article_text_is_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    from html import unescape
    for r in hx.extract(pages).select("html", "text").collect():
        inner = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


def test_html_edges(spark):
    html = ["", None, "plain text only, but long enough to be a sentence of some kind.", "<p", "<!-- open", "<script>x",
            "<article><h1>T &amp; t</h1><p>a<b> b</b>\n c<br>d<li>x<ul><li>y</ul></p><nav>n</nav><div class='adBox'>z</div>"
            "<div class='comments'><p>c</p></div><aside>s</aside>tail &#233; &lt;p&gt;</article><footer>f</footer>" + "x" * 50,
            "<main><p>" + "<p>".join(["long paragraph, with words."] * 3000) + "</main>"]
    df = spark.createDataFrame([(i, h, "t", 1) for i, h in enumerate(html * 2)], "page_id long, html string, text string, n int")
    got = [r["text"] for r in hx.extract(df).orderBy("page_id").collect()]
    assert got[:8] == got[8:] and got[0] == got[1] == got[3] == got[4] == got[5] == ""
    assert got[6] == "T & t\na b c d\nx\ny\ntail é <p>"
    assert got[7].count("\n") == 2999
    assert hx.extract(df.limit(0)).count() == 0


def test_words_of_wrappers_keep_the_page(spark):
    said = "<h1>A title</h1>" + "".join(f"<p>Paragraph {i} of the text, with some words, and an end.</p>" for i in range(6))
    junk = ("<div class='sidebar'><p>Side words, said here.</p></div><div class='related'><article><p>Teaser words.</p></article></div>"
            "<div id='comments'><article class='comment'><p>Comment words.</p></article></div>")
    pages = [f"<body class='has-sidebar'><article>{said}</article>{junk}</body>",
             f"<body><div class='content with-sidebar'><article>{said}</article></div>{junk}</body>",
             f"<body><article class='comments-open'>{said}</article>{junk}</body>",
             f"<body><div class='social'><article>{said}</article></div><article class='share'>{said}</article>{junk}</body>",
             f"<body class='banner-top'><main class='search'>{said}{junk}</main></body>",
             f"<body><article>{said}{junk}</article></body>",
             f"<body class='has-sidebar'><div>{said}</div>{junk.replace('article', 'div')}</body>",
             f"<body><div id='content-with-sidebar'>{said}</div>{junk.replace('article', 'div')}</body>",
             f"<body><div>{said}</div>{junk}</body>"]
    text = "\n".join(re.findall(r">([^<]+)<", said))
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id long, html string")
    got = [r["text"] for r in hx.extract(df).orderBy("page_id").collect()]
    assert got == [text] * 3 + [text + "\n" + text] + [text] * 5


def test_most_frequent_is_bounded_and_ordered(spark):
    from cadence.llm.common import most_frequent
    df = spark.createDataFrame([(i, 2 ** (i % 10)) for i in range(1000)], "k long, n long")
    keys, times = most_frequent(df, "k", "n", 250)
    assert len(keys) == 200 and set(times.tolist()) == {256, 512}
    assert len(most_frequent(df, "k", "n", 50)[0]) == 0 and len(most_frequent(df, "k", "n", 10_000)[0]) == 1000
    assert len(most_frequent(df.limit(0), "k", "n", 5)[0]) == 0


# ------------------------------------------------------------------ alias roles, URL variants, many labels

def _said(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = cf.format_chat(cf.canonical_turns(cf.as_layouts(cf.gather_turns(df))))
    return {r["conv_id"]: [tuple(t) for t in r["said"]] for r in out.withColumn("said", cf.read_back(F.col("formatted"))).collect()}


def test_alias_roles_stay_where_the_layout_does_not_use_them(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
            (3, 0, "bot", None), (4, 0, "user", None), (4, 1, "model", "x"), (5, 0, None, "n")]
    said = _said(spark, rows)
    assert said == {1: [("human", "a"), ("gpt", "b")], 2: [("user", "a"), ("assistant", "b"), ("user", "c")], 3: [("bot", "")],
                    4: [("user", ""), ("model", "x")], 5: [("", "n")]}
    shared = spark.createDataFrame([([("human", "q"), ("gpt", "r"), ("tool", None)],)], "conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in cf.canonical_turns(shared).first()["turns"]] == [("user", "q"), ("assistant", "r"), ("tool", "")]


def test_fingerprints_see_nested_fields(spark):
    schema = "messages array<struct<role:string,content:string,weight:int>>, prompt string, response string"
    df = spark.createDataFrame([([("user", "a", 1)], None, None), ([("user", None, None)], None, None), ([(None, "b", None)], None, None),
                                ([(None, None, 3)], None, None), ([], None, None), ([("user", "a", 1)], "p", None), (None, "p", "r")], schema)
    got = [(r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in cf.canonical_turns(df).collect()]
    assert got == [("messages", [("user", "a")]), ("messages", [("user", "")]), ("messages", [("", "b")]), ("unknown", None),
                   ("messages", []), ("unknown", None), ("prompt", [("user", "p"), ("assistant", "r")])]


def test_long_chat_texts_and_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x<|im_end|>" * (20_000 if i == 1 else 1)) for i in range(500)]
    said = _said(spark, rows)
    assert [t for _, t in said[1]] == [t for *_, t in rows]


def test_listed_urls_are_found_in_other_forms(spark):
    listed = spark.createDataFrame([("http://spam.example.org/a/b",), ("https://www.bad.example.com:443/x/?q=1&utm_source=n",)], "url string")
    pages = spark.createDataFrame(list(enumerate([
        "https://www.spam.example.org/a/b/", "http://SPAM.example.org/a/b?utm_source=feed#top", "http://spam.example.org/a/b?page=2",
        "http://bad.example.com/x?q=1", "http://bad.example.com/x", "http://spam.example.org/a/bc"])), "page_id long, url string")
    rules = spark.createDataFrame([("example.net", "/", "block")], "host string, path string, action string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_hosts_of_many_labels_cost_no_more(spark):
    deep = ".".join(["a"] * 20_000)
    pages = spark.createDataFrame([(0, f"http://{deep}.example.net/en/x"), (1, f"http://{deep}/"), (2, "http://net/"), (3, "http://example.net.com/en/" + "y" * 500_000)],
                                  "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow")], "host string, path string, action string")
    start = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, pages.select("url").limit(0), rules).collect()}
    assert time.perf_counter() - start < 20
    assert got == {0: ("example.net/en/", "allow"), 1: (None, "allow"), 2: ("net/", "block"), 3: (None, "allow")}


# ------------------------------------------------------------------ HTML: the cut, odd quotes, deep nesting

def _mixed_page(rng, plain):
    """Paragraphs, some of them short or all link, between menus with a sentence here and there; without names if plain."""
    def said(n):
        return " ".join(rng.choice("the river and house under water with green hill near old market people said it".split()) for _ in range(n))
    body, truth = [], []
    for _ in range(rng.randint(5, 12)):
        kind = rng.random()
        text = f"{said(rng.randint(25, 60)).capitalize()}, {said(8)}." if kind < 0.75 else said(rng.randint(1, 4)).title()
        truth.append(text)
        body.append(f"<p><a href='/x'>{text}</a></p>" if 0.75 <= kind < 0.85 else f"<p>{text}</p>")

    def menu(n):
        return "".join(f"<li><p>{said(rng.randint(20, 30))}, {said(4)}.</p></li>" if rng.random() < 0.06 else f"<li><a href='/m'>{said(rng.randint(1, 3)).title()}</a></li>"
                       for _ in range(n))
    nav, foot, main = ("div", "div", "div") if plain else ("nav", "footer", "article")
    html = f"<body><{nav}><ul>{menu(rng.randint(5, 10))}</ul></{nav}><{main}>{''.join(body)}</{main}><{foot}><ul>{menu(rng.randint(5, 10))}</ul></{foot}></body>"
    return html, truth


def _weights(pages):
    seen = {}
    for html in pages:
        for b, t in hx.read_blocks(html):
            y = hx.silver(b)
            if y >= 0:
                for f in (None, *hx.features(b, t)):
                    seen[f, y] = seen.get((f, y), 0) + 1
    return hx.weights_of({k: n for k, n in seen.items() if k[0] is not None}, (seen.get((None, 0), 0), seen.get((None, 1), 0)))


def test_the_cut_labels_better_than_the_costs():
    """On pages without telling elements, the cut changes labels that the costs alone get wrong."""
    rng = random.Random(23)
    weights = _weights([_mixed_page(rng, False)[0] for _ in range(150)])
    right = {"cut": 0, "cost": 0}
    blocks = changed = mended = 0
    for _ in range(150):
        html, truth = _mixed_page(rng, True)
        found = hx.read_blocks(html)
        want = np.array([t in truth and b.place.name == "p" and b.place.up.name == "div" for b, t in found])
        costs = hx.costs_of(found, weights) > 0
        cut = hx.label_page(found, weights)
        right["cut"] += int((cut == want).sum())
        right["cost"] += int((costs == want).sum())
        blocks += len(found)
        changed += int((cut != costs).sum())
        mended += int(((cut != costs) & (cut == want)).sum())
    assert changed >= 100 and mended > 0.8 * changed, (blocks, changed, mended, right)
    assert right["cut"] > right["cost"] + 0.02 * blocks and right["cut"] > 0.97 * blocks, (blocks, changed, mended, right)


def test_quotes_open_strings_after_an_equals_sign_only(spark):
    pages = ["<article><p>One.</p><p title=Bob's>Two.</p><p>Three.</p></article>", "<article><p>One.</p><a href=x\">Two.</a><p>Three.</p></article>",
             "<article><p title=\"a > b\" data-x = 'c > d' e=f\"g>One.</p><p 'odd' \">Two.</p><p>Three.</p></article>",
             "<article><p>One.</p><p>Two <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p><p>Three.</p></article>",
             "<main><p>One.</p><section class='related-work'><p>Two.</p></section><p>Three.</p></main>",
             "<article><p>One.</p><p title=>Two.</p><p title='>Three.</p></article>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = [r["text"] for r in hx.extract(df).orderBy("page_id").collect()]
    assert got == ["One.\nTwo.\nThree."] * 3 + ["One.\nTwo x=2.\nThree.", "One.\nTwo.\nThree.", "One.\nTwo."]


@pytest.mark.parametrize("unit", ["<div>text ", "<div class=ad>text ", "<p>text</b></i>", "<article><p>text", "<b>text ", "<li><ul>text", "<a href=x\">t", "<p title=x'y>z", "< p", "</div>t"])
def test_reading_time_is_linear(unit):
    took = []
    weights = {"len0": -1.0, "stop0": 0.5}
    for n in (2_000, 8_000):
        start = time.perf_counter()
        hx.main_text(unit * n, weights)
        took.append(time.perf_counter() - start)
    assert took[1] < 9 * max(took[0], 0.02), took


# ------------------------------------------------------------------ hubs and uncounted keys

@pytest.mark.parametrize("hub,sent", [(3, 2_000_000), (3, 0), (1000, 10)])
def test_components_with_hubs(spark, monkeypatch, hub, sent):
    from cadence.llm import graph
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "MAX_SENT_HUBS", sent)
    rng = random.Random(9)
    links = [(0, i) for i in range(1, 2500)] + [(5000, i) for i in range(5001, 5040)] + [(i, i + 1) for i in range(6000, 6060)]
    links += [(rng.randint(7000, 7300), rng.randint(7000, 7300)) for _ in range(200)] + [(2499, 6000), (5001, 7000)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in links)}


def test_keys_that_no_batch_counts_are_dealt(spark, monkeypatch):
    """Nothing is known to be common: large groups are still cut into cells of bounded size, and no link is lost."""
    monkeypatch.setattr(jj, "CELL_ROWS", 8)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    docs = [(i, " ".join(base[:40] + [f"x{rng.randint(0, 3)}"] + base[41:58] + [f"y{i}"])) for i in range(120)]
    docs += [(1000 + i, f"other text number {i} with words of its own") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(40)
    sizes = []
    real = jj._dealt

    def dealt(met, cell_rows):
        out = real(met, cell_rows)
        sizes.append((met.groupBy("gid").count().agg(F.max("count")).first()[0], out.groupBy("cell").count().agg(F.max("count")).first()[0]))
        return out
    monkeypatch.setattr(jj, "_dealt", dealt)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, cell_rows=8, max_frequent=0).collect()), key=repr)
    assert got == brute_join(docs)
    assert sizes[0][0] > 100 and sizes[0][1] <= 40, sizes
