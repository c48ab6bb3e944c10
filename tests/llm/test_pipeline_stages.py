"""The pipeline's stages on planted cases, and that the rest does without this package."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline as cp
from cadence.llm import oracle, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_on_planted_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = docs.filter("lang = 'en' and n_chars between 1500 and 4000").orderBy("doc_id").first()["text"]
    words = base.split(" ")
    near = " ".join([*words[:40], "changed", *words[41:]])
    planted = [(100001, base), (100002, near), (100003, base.upper()), (100004, "some words before " + item + " and after"),
               (100005, "write to jane.doe@example.org or +49 30 123 456 78 today please"), (100006, None), (100007, "12 34 !!"),
               (None, "the and of with that is a document without an id but of some words")]
    extra = spark.createDataFrame([(i, t, "en", "plant", len(t or ""), "x") for i, t in planted],
                                  "doc_id long, text string, lang string, source string, n_chars long, mix_copy string")
    rows = docs.withColumn("mix_copy", F.lit("y")).unionByName(extra)
    cols = rows.columns
    ids = {}
    for name, stage in cp.STAGES:
        rows = cp.materialize(stage(spark, rows, SF), name)
        ids[name] = [r["doc_id"] for r in rows.select("doc_id").collect()]
        if name != "mixing":
            assert rows.columns == cols
        if name == "pii":
            t = rows.filter("doc_id = 100005").first()
            assert t["text"] == "write to [EMAIL] or [PHONE] today please" and t["n_chars"] == len(t["text"])
    first = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert first <= set(ids["language_id"])  # clean documents stay
    assert not {100006, 100007} & set(ids["language_id"]) and {100001, 100005, None} <= set(ids["language_id"])
    assert not {100001, 100002, 100003} & set(ids["jaccard_near_duplicates"])  # the original has a smaller id
    assert {100004, 100005, None} <= set(ids["jaccard_near_duplicates"])
    assert len(ids["jaccard_near_duplicates"]) == len(set(ids["jaccard_near_duplicates"]))
    assert 100004 not in ids["decontamination"] and 100005 in ids["decontamination"]
    assert set(ids["pii"]) == set(ids["decontamination"])


def test_repeated_rows_and_empty_table(spark):
    row = (1, "the quick brown fox jumps over the lazy dog again", "en", "s", 49)
    docs = spark.createDataFrame([row, row, (1, "quite another text with the same id as before here", "en", "s", 50)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.drop_near_duplicates(spark, docs, SF).count() == 2
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        empty = empty.select(docs.columns)


def test_each_text_of_a_repeated_id_is_judged_by_itself(spark):
    a, b, c = ("the quick brown fox jumps over the lazy dog again", "quite another text that has the same id as that before",
               "some third text of other words that is nobody's copy here")
    rows = [(1, a), (5, a.upper()), (5, b), (5, b), (9, b), (9, c), (9, None), (12, c), (None, a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rid string")
    out = cp.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
        [(1, a), (5, b), (9, c), (9, None), (None, a)], key=repr)


def test_thirteen_operators_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle.oracle_sql()) <= set(names)


def test_rest_imports_without_the_package(tmp_path):
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('cadence.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert e.queries() and not any(k.startswith('op') for k in e.queries() if k[2:3].isdigit())\n"
            "assert 'pipeline' not in e.queries()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_run_deletes_what_stages_materialise(spark):
    from cadence.operators.ranking import materialized_scope
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    with materialized_scope(spark):
        out = cp.run(spark, SF)
        kept = {n.split("-")[0] for n in set(os.listdir(base)) - before}
        assert kept == {"pii", "mix"}, kept  # the last stage's documents and its own table
        assert out.count() > 0
    assert set(os.listdir(base)) == before


def test_stages_on_very_long_and_odd_documents(spark):
    """A megabyte of words, of digits and of letters, empty and null texts go through every stage."""
    long = "the house and the river with water from the old hill " * 20_000
    rows = [(1, long, "en", "a"), (2, "1" * 300_000 + " the end of the house", "en", "a"), (3, "a" * 300_000, "en", "b"), (4, None, "en", "a"),
            (5, "", None, None), (6, long + "x", "en", "b"), (7, "the house and the river", "en", None), (None, "the old hill and the water", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").limit(100).withColumn("doc_id", F.col("doc_id") + 1000))
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF), name)
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert not {4, 5} & left and docs.count() > 50, name
    assert not {1, 6} <= left  # near copies
