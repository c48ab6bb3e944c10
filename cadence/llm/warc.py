r"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

Writing. One record per page; of equal payloads of at least ``min_revisit`` bytes the one with the largest page
id is a ``response``, the others are ``revisit`` records that refer to it and carry its HTTP header only. The
text writer ends every record by ``\r\n\r\n``, so its part files are WARC files, with Spark's commit protocol.

Reading. Spark's text reader splits the files at the magic ``\r\nWARC/1.``, in as many blocks as it likes. Each
piece is a candidate record: its header's Content-Length gives the offset of its successor. Payloads may hold the
magic too (an archive of archives), so only candidates on the chain that starts at offset 0 of the file are
records. Chains are followed by pointer jumping, first inside each block (numpy, offsets only), where a candidate
gets the offset at which its chain leaves the block, then across blocks by joins whose steps double each round.
A record whose payload holds the magic is put together again from its pieces.

Defined cases: null html is an empty payload; a null page id stands as ``null`` and is the smallest, and where a
group has no other id all its records are responses; all rows that repeat the largest id of a group are responses;
a null URL has no target header; line ends in a URL are percent-encoded; an empty table gives no records; other
columns are ignored. A payload is one row, however long. A chain that breaks (damaged file) keeps the records
before the break; ``broken`` lists such files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

MAGIC = "\r\nWARC/1."
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 1000
#: Groups of equal payloads (28 bytes each) that are sent to every task; more are joined in a shuffle.
MAX_SENT_GROUPS = 2_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
ID = r"<urn:page:(-?[0-9]+|null)>"


# ------------------------------------------------------------------ writing

def _length(c: str | Column) -> Column:
    return F.octet_length(c).cast("string")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, top``: ``top`` is the id to which a revisit refers, null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    bytes_ = F.octet_length("payload")
    groups = materialize(rows.filter(bytes_ >= min_revisit).groupBy("digest")
                         .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1 and top is not null").select(F.unhex("digest").alias("key"), "top"), "payloads")
    if groups.count() <= MAX_SENT_GROUPS:
        groups = F.broadcast(groups)
    out = rows.withColumn("key", F.unhex("digest")).join(groups, "key", "left").drop("key")
    return out.withColumn("top", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))


def write_archives(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files into the folder ``path``."""
    rows = plan_records(pages, min_revisit)
    revisit = F.col("top").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    _length("payload"), F.lit(END + END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("top")))).otherwise(F.lit("")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), _length("block"), F.lit(END + END))
    rows.withColumn("block", block).select(F.concat(header, F.col("block")).alias("value")) \
        .write.option("lineSep", END + END).text(path)


# ------------------------------------------------------------------ candidates

def _field(head: str | Column, name: str, value: str = r"([^\r\n]*)") -> Column:
    """A header's value (empty if there is none); only \\n ends a line."""
    return F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*{value}", 1)


def _before(text: Column, times: int) -> Column:
    """``text`` up to its ``times``-th empty line."""
    return F.substring_index(text, END + END, times)


def _bytes_from(text: Column, skip: Column, length: Column) -> Column:
    return F.substring(text.cast("binary"), skip.cast("int") + F.lit(1), length.cast("int"))


def parsed(text: Column) -> dict[str, Column]:
    """Columns of a record from its text after ``WARC/1.``."""
    head = _before(text, 1)
    head_bytes = F.octet_length(head).cast("long")
    declared = _field(head, "Content-Length", r"([0-9]{1,17})[ \t]*(?:\r?$)")
    length = F.when((head_bytes < F.octet_length(text)) & text.rlike(r"\A[01]\r\n") & (declared != ""), declared.cast("long"))
    block_at = head_bytes + 4
    http = _field(head, "Content-Type").startswith("application/http")
    # the payload starts after the HTTP header's empty line
    two = F.octet_length(_before(text, 2)).cast("long")
    http_head = _bytes_from(text, block_at, F.greatest(two - block_at, F.lit(0))).cast("string")
    skip = F.when(http, F.least(two + 4 - block_at, length)).otherwise(F.lit(0))
    payload = _bytes_from(text, block_at + skip, length - skip)
    digest = F.regexp_replace(F.lower(_field(head, "WARC-Payload-Digest")), "^sha1:", "")
    return {"head": head, "length": length, "size": head_bytes + 4 + length + 4,
            "complete": F.octet_length(text) - block_at >= length, "payload": payload, "declared_digest": digest,
            "http_length": _field(http_head, "Content-Length", "([0-9]{1,17})").try_cast("long")}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, file_size, block, at, value``: what stands between magics, in order of ``at`` within a block."""
    return spark.read.text(path, lineSep=MAGIC).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")


def candidates(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every piece with its offset and, if it can be a record, its successor's offset.

    Offsets come from running sums inside a block and over the blocks of a file.
    """
    p = pieces(spark, path)
    start = (F.col("block") == 0) & F.col("value").startswith(MAGIC[2:])
    text = F.when(start, F.substring("value", len(MAGIC) - 1, 1 << 30)).otherwise(F.col("value"))
    p = p.withColumn("text", text)
    fields = parsed(F.col("text"))
    record = F.when(fields["length"].isNotNull(), F.struct(
        fields["head"].alias("head"), fields["length"].alias("length"), fields["complete"].alias("complete"),
        F.when(fields["complete"], F.struct(
            F.sha1(fields["payload"]).alias("sha1"), F.octet_length(fields["payload"]).cast("long").alias("bytes"),
            fields["http_length"].alias("http_length"),
            (fields["payload"] if payload else F.lit(None).cast("binary")).alias("payload"))).alias("body")))
    p = p.select("file", "path", "file_size", "block", "at", start.alias("start"), F.octet_length("value").cast("long").alias("bytes"),
                 F.sha1("value").alias("sha"), fields["size"].alias("size"), record.alias("record"))
    p = materialize(p, "warc-pieces")  # payloads end here; what follows is small rows
    in_block = Window.partitionBy("file", "block").orderBy("at")
    p = p.withColumn("before", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = p.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("all"))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("base"))
    p = p.join(blocks, ["file", "block"]).withColumn("from", F.col("base") + F.col("before"))
    first = F.col("from") == 0
    off = F.when(first, F.lit(0)).otherwise(F.col("from") - (len(MAGIC) - 2))
    after = F.when(F.col("start") == first, off + len(MAGIC) - 2 + F.col("size"))
    return materialize(p.select("file", "path", "file_size", "block", off.alias("off"), after.alias("next"), "sha", "record"),
                       "warc-candidates")


# ------------------------------------------------------------------ pointer jumping

def follow(off: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Positions in sorted ``off`` that ``after`` points to; ``len(off)`` where it points elsewhere."""
    at = np.searchsorted(off, after)
    return np.where((at < len(off)) & (off[np.minimum(at, len(off) - 1)] == after), at, len(off))


def exits(off: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The offset at which each candidate's chain leaves the block, by doubling steps."""
    jump = np.append(follow(off, after), len(off))
    out = np.append(after, 0)
    while (jump[:-1] < len(off)).any():
        out = np.where(jump < len(off), out[jump], out)
        jump = jump[jump]
    return out[:-1]


def reached(off: np.ndarray, after: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Candidates on a chain from those marked in ``entry``, by doubling steps."""
    jump = np.append(follow(off, after), len(off))
    on = np.append(entry, False)
    while True:
        step = np.zeros_like(on)
        step[jump[on]] = True
        step[-1] = False
        if (jump[:-1] == len(off)).all():
            return on[:-1]
        on |= step
        jump = jump[jump]


def _block_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off")
    out = exits(pdf["off"].to_numpy(), pdf["next"].to_numpy())
    return pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "off": pdf["off"], "out": out})


def _block_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off")
    on = reached(pdf["off"].to_numpy(), pdf["next"].to_numpy(), pdf["entry"].to_numpy(bool))
    return pdf.loc[on, ["file", "off"]]


def chain(found: DataFrame) -> DataFrame:
    """``file, off`` of the candidates reachable from the start of their file."""
    links = found.filter("next is not null").select("file", "block", "off", "next")
    leave = materialize(links.groupBy("file", "block").applyInPandas(_block_exits, "file long, block long, off long, out long"), "warc-exits")
    # the nodes of the jumps across blocks: file starts, and candidates to which a chain of another block leads
    entered = leave.select("file", F.col("out").alias("off")).distinct()
    nodes = materialize(leave.join(entered, ["file", "off"], "left_semi").unionByName(leave.filter("off = 0"))
                        .select("file", "off", "out").distinct(), "warc-entries")
    on, jump, n = nodes.filter("off = 0").select("file", "off"), nodes, -1
    while True:
        step = on.join(jump, ["file", "off"]).select("file", F.col("out").alias("off")).join(nodes, ["file", "off"], "left_semi")
        on = materialize(on.unionByName(step.select("file", "off")).distinct(), "warc-reached")
        was, n = n, on.count()
        if n == was:
            break
        twice = jump.select("file", F.col("off").alias("a"), F.col("out").alias("off")).join(jump, ["file", "off"])
        jump = materialize(twice.select("file", F.col("a").alias("off"), "out"), "warc-jumps")
    entry = on.withColumn("entry", F.lit(True))
    marked = links.join(entry, ["file", "off"], "left").select("file", "block", "off", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInPandas(_block_chain, "file long, off long")


# ------------------------------------------------------------------ records

def _put_together(spark: SparkSession, path: str, found: DataFrame, payload: bool) -> DataFrame:
    """``file, off, body`` of the records whose payload holds the magic, from their pieces.

    A piece belongs to the last record that starts at or before it: a running maximum inside each block, and over
    the blocks of a file.
    """
    in_block = Window.partitionBy("file", "block").orderBy("off")
    last = F.last(F.when(F.col("on"), F.col("off")), ignorenulls=True)
    p = found.select("file", "block", "off", "sha", "on", "record.complete").withColumn("mine", last.over(in_block))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = p.groupBy("file", "block").agg(F.max("mine").alias("m")).select(
        "file", "block", F.last("m", ignorenulls=True).over(over).alias("carried"))
    p = p.join(carried, ["file", "block"]).withColumn("mine", F.coalesce("mine", "carried"))
    many = found.filter("on and not record.complete").select("file", F.col("off").alias("mine"))
    need = materialize(p.join(many, ["file", "mine"], "left_semi").select("file", "mine", "off", "sha"), "warc-parts")
    if need.isEmpty():
        return None
    keys = need.select("sha").distinct()
    if keys.count() <= MAX_SENT_GROUPS:
        keys = F.broadcast(keys)
    again = pieces(spark, path).select(F.sha1("value").alias("sha"), "value", "block")
    again = again.join(keys, "sha", "left_semi").groupBy("sha").agg(F.first("value").alias("value"))
    rows = need.join(again, "sha").groupBy("file", "mine").agg(
        F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    start = (F.col("mine") == 0) & whole.startswith(MAGIC[2:])
    rows = rows.withColumn("text", F.when(start, F.substring(whole, len(MAGIC) - 1, 1 << 30)).otherwise(whole))
    fields = parsed(F.col("text"))
    body = F.struct(F.sha1(fields["payload"]).alias("sha1"), F.octet_length(fields["payload"]).cast("long").alias("bytes"),
                    fields["http_length"].alias("http_length"),
                    (fields["payload"] if payload else F.lit(None).cast("binary")).alias("payload"))
    return rows.select("file", F.col("mine").alias("off"), F.when(fields["complete"], body).alias("body"))


def _checked(spark: SparkSession, path: str, payload: bool) -> DataFrame:
    found = candidates(spark, path, payload)
    on = chain(found).withColumn("on", F.lit(True))
    return materialize(found.join(on, ["file", "off"], "left").withColumn("on", F.coalesce("on", F.lit(False))), "warc-checked")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """``path, at``: files whose chain stops before the file's end, and the offset where it stops."""
    found = _checked(spark, path, False)
    ends = found.groupBy("path", "file_size").agg(F.coalesce(F.max(F.when(F.col("on"), F.col("next"))), F.lit(0)).alias("at"))
    return ends.filter("at <> file_size").select("path", "at")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the uncompressed WARC files in ``path``.

    ``path, off, record_type, record_id, target_uri, refers_to, payload_bytes, payload_digest, digest_ok`` and, if asked
    for, ``payload`` (binary). Size and digest are those of the full payload: a revisit's come from the headers
    that it carries, all others' from the payload itself, whose digest ``digest_ok`` compares with the header's.
    """
    found = _checked(spark, path, payload)
    rows = found.filter("on").select("file", "path", "off", "record")
    joined = _put_together(spark, path, found, payload)
    body = F.col("record.body")
    if joined is not None:
        rows = rows.join(joined, ["file", "off"], "left")
        body = F.coalesce(body, F.col("body"))
    rows = rows.select("path", "off", "record.head", body.alias("body"))
    kind = _field("head", "WARC-Type")
    declared = F.regexp_replace(F.lower(_field("head", "WARC-Payload-Digest")), "^sha1:", "")
    revisit = kind == "revisit"

    def optional(name: str) -> Column:
        return F.when(F.col("head").rlike(rf"(?imd)^{name}:"), _field("head", name))

    out = rows.select(
        "path", "off", kind.alias("record_type"), _field("head", "WARC-Record-ID").alias("record_id"),
        optional("WARC-Target-URI").alias("target_uri"), optional("WARC-Refers-To").alias("refers_to"),
        F.when(revisit, F.col("body.http_length")).otherwise(F.col("body.bytes")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("body.sha1")).alias("payload_digest"),
        F.when(~revisit & (declared != ""), declared == F.col("body.sha1")).alias("digest_ok"), "body.payload")
    return out if payload else out.drop("payload")


def page_of(record_id: str) -> Column:
    """The page id that a record id of ``write_archives`` names."""
    return F.regexp_extract(record_id, ID, 1).try_cast("long")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into scratch archives, read them back: one row per record."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    got = read_archives(pages.sparkSession, path, payload=False)
    return got.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      page_of("refers_to").alias("refers_to"))
