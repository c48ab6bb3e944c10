"""Centroid clustering, phrase collocations and WARC archives against plain Python versions, and edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import centroids, collocations, warc
from cadence.llm.common import scratch

LOWER = {i: i + 32 for i in range(65, 91)}


# ------------------------------------------------------------------ centroid clustering

def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(v))) for v in e]) for i, e in rows
            if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e)]
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    centres = [x for _, x in sorted(((name(i), x) for i, x in kept))[:k]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def nearest(x):
        return min((dist(x, c), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    per = Counter()
    for _, c, d in found:
        per[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in found), key=repr)


def vectors(seed, n, dims, hot=True):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    rows = [(i, [float(np.float32(v)) for v in middles[i % 6] + 0.3 * rng.normal(size=dims)]) for i in range(n)]
    if hot:  # a third of the rows are copies; ids and rows repeat
        rows += [(10_000 + i, rows[0][1]) for i in range(n // 2)] + [rows[1], rows[1], (3, rows[4][1]), (None, rows[5][1])]
    bad = rows[2][1]
    rows += [(20_000, None), (20_001, []), (20_002, bad[:-1]), (20_003, [None, *bad[1:]]), (20_004, [float("nan"), *bad[1:]]),
             (20_005, [float("inf"), *bad[1:]]), (20_006, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("seed,n,dims,k", [(1, 120, 64, 40), (2, 60, 3, 7), (3, 90, 1, 12), (4, 10, 5, 40)])
def test_clusters_match_brute_force(spark, seed, n, dims, k):
    rows = vectors(seed, n, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1))
    got = sorted((tuple(r) for r in centroids.cluster(df.repartition(3), k=k, dims=dims).collect()), key=repr)
    assert got == brute_clusters(rows, k, 5, dims)


def test_threshold_walk_is_exact_and_skips_distances():
    rng = np.random.default_rng(5)
    c = rng.integers(-5, 5, (300, 2))  # many ties
    lists = centroids.SortedCentroids(c)
    x = rng.integers(-6, 6, (2000, 2))
    number, distance, scored = lists.nearest(x)
    every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert lists.nearest(np.empty((0, 2), np.int64))[2] == 0
    wide = rng.integers(-10_000, 10_000, (300, 2))
    number, distance, scored = centroids.SortedCentroids(wide).nearest(x * 1000)
    every = ((x[:, None, :] * 1000 - wide[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert scored < 0.5 * every.size  # the walk stops before it has met half of them
    edge = np.array([[centroids.LARGEST] * 64, [-centroids.LARGEST] * 64])
    assert centroids.SortedCentroids(edge[:1]).nearest(edge)[1].tolist() == [0, 64 * (2 * centroids.LARGEST) ** 2]


def test_clusters_of_nothing_and_of_large_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    with pytest.raises(Exception, match="scaled component exceeds"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], schema), dims=1)


# ------------------------------------------------------------------ phrase collocations

def brute_phrases(docs, least, top):
    pieces = []
    for text, lang in docs:
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            pieces.append((lang or "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", p)))
    n, f = Counter(), Counter()
    for lang, w in pieces:
        n[lang] += len(w)
        for k in range(1, 6):
            for i in range(len(w) - k + 1):
                f[lang, tuple(w[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {}
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i:i + k]] = max(inside.get((lang, p[i:i + k]), 0), a)
    rows = []
    for (lang, p), a in cand.items():
        if 100 * inside.get((lang, p), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(out)


def prose(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["Über", "日本", "a-b", "x'y", "É"]
    fixed = ["once upon a time there was", "as soon as possible", "w1 w2 w3"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! ", "\x0b"]))
        docs.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    return docs + [(None, "en"), ("", None), (" , . ", "en"), ("A a A a a a", "de"), ("w1 w2 " * 3000, "en")] + [docs[0]] * (n // 3)


@pytest.mark.parametrize("seed,least,top", [(1, 5, 2000), (2, 3, 10), (3, 12, 5)])
def test_phrases_match_brute_force(spark, seed, least, top):
    docs = prose(seed, 150)
    df = spark.createDataFrame(docs, "text string, lang string").withColumn("n", F.lit("x")).withColumn("code", F.lit(0)).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, top).collect())
    want = brute_phrases(docs, least, top)
    assert got == want and len(want) > 10


def test_phrases_do_not_depend_on_the_bitmap(spark, monkeypatch):
    docs = prose(7, 80)
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 10)  # most marks are false
    monkeypatch.setattr(collocations, "BITS_PER_PAIR", 1)
    df = spark.createDataFrame(docs, "text string, lang string")
    assert sorted(tuple(r) for r in collocations.collocations(df, 4, 50).collect()) == brute_phrases(docs, 4, 50)


def test_phrases_of_nothing_and_large_products(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    rare = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert collocations.collocations(rare).count() == 0
    phrases = spark.createDataFrame([([1, 2], 3_000_000_007)], "codes array<long>, a long")
    words = spark.createDataFrame([("en", "x", 1, 4_000_000_000), ("en", "y", 2, 3_000_000_019)], "lang string, word string, code long, f long")
    totals = spark.createDataFrame([("en", 9_000_000_000_000)], "lang string, n long")
    got = collocations.scored(phrases, words, totals).first()
    assert got["score"] == 1000 * 3_000_000_007 * 9_000_000_000_000 // (4_000_000_000 * 3_000_000_019)


# ------------------------------------------------------------------ WARC

INNER = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Type: text/plain\r\n"
         "Content-Length: 5\r\n\r\nhello\r\n\r\n")


def some_pages(seed=1, n=120):
    rng = random.Random(seed)
    big = "<p>" + "é日x" * 400 + "</p>"
    pages = [(i, f"http://h{i}/", rng.choice([big, big + str(i % 3), "x" * rng.randint(0, 1500), "small", "", None])) for i in range(n)]
    pages += [(1000, None, "\r\n" + INNER * 3), (1001, "", "a\r\nWARC/1.0\r\nbroken"), (1002, "http://x/WARC/1.1", "\r\nWARC/1."),
              (1003, "http://x/\r\nWARC-Record-ID: <urn:page:5>\nü", "\r\n\r\n\r\nWARC/1.1\r\n\r\n"),
              (1004, "u", INNER + "y" * 3000), (1005, "u", INNER + "y" * 3000), (1005, "v", INNER + "y" * 3000),
              (1006, "u", "x" * 999), (1007, "u", "x" * 999), (1008, "u", "z" * 1000), (1009, "u", "z" * 1000), (None, "u", "z" * 1000),
              (None, "u", "q" * 1000), (None, "u", "q" * 1000), (1010, "u", "\r\n" + (INNER + "t" * 500) * 40)]
    return pages


def brute_records(pages):
    data = [(i, (h or "").encode()) for i, _, h in pages]
    top = {}
    for i, b in data:
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    return sorted(((i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", top[b]) if top.get(b, i) != i else ("response", None)))
                   for i, b in data), key=repr)


@pytest.fixture
def block_size(spark):
    """Reads files in blocks of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")
    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("blocks", [1 << 27, 20_000, 1500, 333])
def test_archives_keep_every_page(spark, block_size, blocks):
    pages = some_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("key", F.lit(2)).repartition(2)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, path)
    block_size(blocks)
    got = warc.read_archives(spark, path).withColumns({"id": warc.page_of("record_id"), "to": warc.page_of("refers_to")}).collect()
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["to"]) for r in got), key=repr) == brute_records(pages)
    payload = {i: (h or "").encode() for i, _, h in pages}
    assert all(bytes(r["payload"]) == payload[r["id"]] and r["digest_ok"] for r in got if r["record_type"] == "response" and r["id"] is not None)
    url = {(i, h): u for i, u, h in pages}
    assert {r["target_uri"] for r in got if r["id"] == 1000} == {None} and {r["target_uri"] for r in got if r["id"] == 1001} == {""}
    assert next(r["target_uri"] for r in got if r["id"] == 1003) == "http://x/%0D%0AWARC-Record-ID: <urn:page:5>%0Aü"
    assert warc.broken(spark, path).count() == 0 and url


def test_query_form(spark):
    pages = some_pages(2, 60)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=repr) == brute_records(pages)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_groups_joined_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_SENT_GROUPS", 0)
    pages = some_pages(3, 60)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.archive_pages(df).collect()), key=repr) == brute_records(pages)


def test_archives_of_others_and_damaged_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\ncontent-length:  7 \r\n\r\na: b\r\n\xff\r\n\r\n"
    http = b"HTTP/1.0 200 OK\r\n\r\n\x00\xff\xfe\r\n\r\nbinary"
    second = (b"WARC/1.0\r\nContent-Length: %d\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\n"
              b"WARC-Payload-Digest: sha1:00\r\n\r\n%s\r\n\r\n" % (len(http), http))
    (tmp_path / "good.warc").write_bytes(info + second + second)
    (tmp_path / "cut.warc").write_bytes(info + second + second[:-20])
    (tmp_path / "junk.warc").write_bytes(b"junk\r\n" + info)
    (tmp_path / "gap.warc").write_bytes(info + b"\r\n" + second)
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["off"]):
        by.setdefault(os.path.basename(r["path"]), []).append(r)
    assert [r["record_type"] for r in by["good.warc"]] == ["warcinfo", "response", "response"]
    assert bytes(by["good.warc"][0]["payload"]) == b"a: b\r\n\xff" and by["good.warc"][0]["digest_ok"] is None
    assert bytes(by["good.warc"][1]["payload"]) == b"\x00\xff\xfe\r\n\r\nbinary" and by["good.warc"][1]["digest_ok"] is False
    assert [r["off"] for r in by["good.warc"]] == [0, len(info), len(info) + len(second)]
    assert "junk.warc" not in by and len(by["gap.warc"]) == 1
    assert by["cut.warc"][2]["payload_bytes"] is None  # its length is declared, its bytes are missing
    at = {os.path.basename(r["path"]): r["at"] for r in warc.broken(spark, str(tmp_path)).collect()}
    assert at == {"cut.warc": len(info) + 2 * len(second), "junk.warc": 0, "gap.warc": len(info)}


def test_pointer_jumping_inside_a_block():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 40)
        off = np.array(sorted(rng.sample(range(200), n)))
        after = np.array([rng.choice([int(rng.choice(off)), rng.randint(0, 400)]) for _ in off])
        after = np.maximum(after, off + 1)  # successors lie behind
        step = dict(zip(off.tolist(), after.tolist()))

        def walk(x):
            seen = []
            while x in step:
                seen.append(x)
                x = step[x]
            return seen, x
        assert warc.exits(off, after).tolist() == [walk(x)[1] for x in off.tolist()]
        entry = np.array([rng.random() < 0.2 for _ in off])
        want = {y for x, e in zip(off.tolist(), entry) if e for y in walk(x)[0]}
        assert set(off[warc.reached(off, after, entry)].tolist()) == want
