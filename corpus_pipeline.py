"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame, which ``run`` writes as Parquet in the
shared folder and reads again as the next stage's documents. All but the last return the columns of
``documents`` (and any others they were given).

Null or empty texts are rejected by the language stage; later stages defend themselves anyway and keep
rows whose id is null. An empty table goes through every stage and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import language_id, pii_crf
from cadence.llm.common import free_name, materialize, scratch, small_batches, table
from cadence.llm.decontaminate import is_contaminated
from cadence.llm.jaccard_join import jaccard_components, word_hash
from cadence.llm.mixing import emit, mix
from cadence.operators.ranking import delete_with_scope, materialized_scope

#: A document stays if some language has at least this calibrated probability.
MIN_LANGUAGE_SCORE = 0.3
#: Ids of dropped documents that are sent to every task (16 bytes each); more are joined in a shuffle.
MAX_SENT_IDS = 4_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or any likely language go."""
    name = free_name(docs.columns, "language")
    told = language_id.with_language(docs, language_id.fit(docs), out=name)
    keep = (F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE)
    return told.filter(keep).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of rows with equal id and text, one.

    Where an id stands on several rows, each of its texts is judged by its own group.
    The ids that go are sent to the tasks while there are at most ``MAX_SENT_IDS`` of them, so texts aren't
    shuffled; beyond that they are joined by id.
    """
    found = materialize(jaccard_components(docs, with_rid=True).filter("doc_id is not null")
                        .select("doc_id", "rid", "component_id"), "components")
    ids = (found.groupBy("doc_id")
           .agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("times")))
    changed = materialize(ids.filter("doc_id <> least or times > 1"), "changed")
    gone = changed.select("doc_id")
    kept = docs.join(F.broadcast(gone) if gone.count() <= MAX_SENT_IDS else gone, "doc_id", "left_anti")
    again = changed.filter("times > 1").select("doc_id")
    if not again.isEmpty():
        small_batches(spark)
        name = free_name(docs.columns, "rid")
        stays = found.filter("doc_id = component_id").join(again, "doc_id", "left_semi").select(
            "doc_id", F.col("rid").alias(name)).distinct()
        rows = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        rows = rows.withColumn(name, word_hash(F.col("text"))).join(stays, ["doc_id", name], "left_semi")
        kept = kept.select(docs.columns).unionByName(rows.select(docs.columns))
    return kept.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return docs.filter(~is_contaminated(table(spark, sf_dir, "benchmark"), F.col("text")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and n_chars of the new text."""
    out = pii_crf.masked(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, numbered in ``mix_copy``."""
    return emit(mix(docs, carry=True))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can express neither the language model nor the random field; tests/llm compares every stage
#: with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. Each stage's documents are written for the next one; what a stage materialises on the way is deleted
    when they are, and so are the documents before them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with materialized_scope(spark):
            if before:
                delete_with_scope(before)
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
