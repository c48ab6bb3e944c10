"""URL filter: a blocked Bloom filter lets possible hits pass to an exact hash join.

Listed are canonical URLs and prefix rules (host and path; a rule fits its host and all
subdomains if the path starts with the rule's, and the longest rule wins). Both kinds are
keys of one list. Every distinct URL is expanded to the keys that could fit it: its
canonical form, and each host suffix with each path prefix of a length that some rule
has, for suffixes of as many labels as some rule's host has (so a host of many labels costs no more). Keys that the filter lets pass are joined exactly with the list.

The filter is a table of 256-bit blocks (four words; a key sets one bit of each), built by
one aggregation. It is broadcast only if its size, computed from the number of keys, is at
most ``max_filter_bytes``; a larger one is joined by block number. Repeated URLs are judged
once; joins on hot keys are left to skew splitting, as the list's side holds a key once.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no
rule; it can still be listed as it stands if not null. Verdicts go to every row, repeated rows
included. Ties between rules of equal length go to the smaller rule; a key listed twice with
different actions blocks. A very long URL, or a host of many labels, is looked up by as many keys as the rules have
lengths and label counts, like any other. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import collect_bounded

BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = 4
MAX_FILTER_BYTES = 64 << 20
#: Query parameters that don't change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without a last slash, sorted parameters but those for
    tracking; no scheme, no fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    given = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(TRACKING)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(url.contains("://"), F.concat(host, path, asked)).otherwise(url)


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, w0..w3`` from a frame with ``key``."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"),
                       *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(probe: DataFrame, listed: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Rows of ``probe`` whose ``key`` the filter of ``listed`` lets pass."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    made = bloom_blocks(listed, blocks)
    if blocks * 8 * (WORDS + 1) <= max_filter_bytes:
        made = F.broadcast(made)
    at = probe.withColumn("block", _block(F.col("key"), blocks))
    passes = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("key")))]
    return at.join(made, "block").filter(passes[0] & passes[1] & passes[2] & passes[3]).select(probe.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: DataFrame, *, id_col: str = "page_id",
                url_col: str = "url", listed_col: str = "url", max_filter_bytes: int = MAX_FILTER_BYTES,
                max_path_lengths: int = 4096) -> DataFrame:
    """``page_id, url, host, path, rule, listed, verdict`` for every page.

    ``rules``: ``host, path, action`` (block or allow). At most ``max_path_lengths`` different lengths of rules' paths,
    and label counts of their hosts, are looked up; more raise an error that names them (raise the bound). A page without a fitting rule is blocked if its
    canonical URL is listed, else allowed.
    """
    rule = rules.select(F.concat(F.lit("r"), "host", "path").alias("key"),
                        F.concat("host", "path").alias("rule"), "action", F.length("path").alias("len"))
    sizes = sorted(r[0] for r in collect_bounded(rules.select(F.size(F.split("host", r"\."))).distinct(), max_path_lengths, "labels of rules' hosts"))
    rule = rule.groupBy("key", "rule", "len").agg(F.max("action").alias("action"))
    lengths = sorted(r[0] for r in collect_bounded(rule.select("len").distinct(), max_path_lengths, "path lengths of rules"))
    known = (listed.filter(F.col(listed_col).isNotNull())
             .select(F.concat(F.lit("u"), canonical(F.col(listed_col))).alias("key")).distinct()
             .select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action")))
    entries = rule.select("key", "rule", "action").unionByName(known)

    urls = pages.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull()).distinct()
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.size(F.split("host", r"\."))
    suffixes = F.filter(F.array(*[F.when(labels >= n, F.substring_index("host", ".", -n)) for n in sizes]).cast("array<string>"),
                        lambda h: h.isNotNull())
    heads = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("path"))
    fits = F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda x: F.concat(
        F.lit("r"), h, F.substring(F.col("path"), F.lit(1), x)))))
    keys = F.array_append(F.when(F.col("url").contains("://"), fits).otherwise(F.array().cast("array<string>")),
                          F.concat(F.lit("u"), canonical(F.col("url"))))
    probe = urls.select("url", F.explode(keys).alias("key"))
    hits = possible_hits(probe, entries.select("key"), max_filter_bytes).join(entries, "key")
    best = F.min(F.when(F.col("rule").isNotNull(), F.struct(
        (-F.length("rule")).alias("len"), F.col("rule").alias("rule"), F.col("action").alias("action"))))
    judged = hits.groupBy("url").agg(best.alias("best"), F.max(F.col("rule").isNull()).alias("listed"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    out = rows.join(judged, "url", "left")
    is_listed = F.coalesce("listed", F.lit(False))
    verdict = F.coalesce(F.col("best.action"), F.when(is_listed, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                      F.col("best.rule").alias("rule"), is_listed.alias("listed"), verdict.alias("verdict"))
