"""End-to-end: clinical CSV export -> declared-schema load -> pipeline -> export."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadence.operators import export as ex
from cadence.plans.pipeline import PipelineConfig, run_pipeline
from cadence.sources import sinks
from cadence.sources.tables import load_all_tables, parse_ts, patient_slices, roles_from_clinical


def _write_export(d: str, n: int = 24) -> None:
    rnd = random.Random(5)
    t0 = dt.datetime(2020, 3, 1, 6, 0)
    pats, obs, cond, enc, med, proc, dev = [], [], [], [], [], [], []
    for i in range(n):
        pid = f"pt-{i:03d}"
        pats.append({"Id": pid, "BIRTHDATE": f"{1940 + i}-05-0{1 + i % 9}", "DEATHDATE": "2020-04-01" if i % 5 == 0 else "",
                     "GENDER": "MF"[i % 2] if i % 7 else "", "RACE": ["white", "black", "asian", "martian"][i % 4],
                     "ETHNICITY": "hispanic" if i % 3 else "nonhispanic", "SSN": f"999-{i}",
                     "INCOME": "oops" if i == 3 else str(20000 + 1000 * i)})
        start = t0 + dt.timedelta(hours=rnd.randint(0, 48))
        for k in range(20):
            ts = start + dt.timedelta(minutes=37 * k)
            obs.append({"DATE": ts.isoformat() + "Z", "PATIENT": pid, "DESCRIPTION": rnd.choice(
                ["Body temperature", "Heart rate", "Oxygen saturation in Arterial blood", "C reactive protein",
                 "Respiratory rate", "Platelets [#/volume] in Blood"]), "VALUE": rnd.choice(["37.2", "88", "n/a", "95"])})
        cond.append({"START": start.date().isoformat(), "STOP": "", "PATIENT": pid,
                     "DESCRIPTION": "COVID-19" if i % 4 else "Suspected COVID-19"})
        if i % 3 == 0:
            cond.append({"START": (start + dt.timedelta(hours=5)).isoformat(), "STOP": "", "PATIENT": pid,
                         "DESCRIPTION": "Acute respiratory failure"})
        for e in range(5):
            enc.append({"START": (start + dt.timedelta(hours=e)).isoformat(),
                        "STOP": (start + dt.timedelta(days=6)).isoformat(), "PATIENT": pid,
                        "DESCRIPTION": "Admission to intensive care unit" if i % 4 == 1 else "Hospital admission",
                        "TOTAL_CLAIM_COST": 100.0 * (1 + e) if e < 4 else 99999.0})
        med.append({"START": (start + dt.timedelta(hours=3)).isoformat(), "STOP": "", "PATIENT": pid,
                    "DESCRIPTION": "Heparin sodium 5000 UNT/ML" if i % 2 else "Acetaminophen 500 MG"})
        if i % 4 == 1:
            proc.append({"DATE": (start + dt.timedelta(hours=8)).isoformat(), "PATIENT": pid,
                         "DESCRIPTION": "Intubation, respiratory tract"})
            dev.append({"START": (start + dt.timedelta(hours=8)).isoformat(), "STOP": (start + dt.timedelta(days=3)).isoformat(),
                        "PATIENT": pid, "DESCRIPTION": "Mechanical ventilator (physical object)"})
    for name, rows in (("patients", pats), ("observations", obs), ("conditions", cond), ("encounters", enc),
                       ("medications", med), ("procedures", proc), ("devices", dev)):
        pd.DataFrame(rows).to_csv(os.path.join(d, f"{name}.csv"), index=False)


def test_pipeline_end_to_end(spark, tmp_path):
    src = tmp_path / "export"
    src.mkdir()
    _write_export(str(src))
    tables, status = load_all_tables(spark, str(src))
    st = {r["table"]: (r["rows"], r["corrupt_rows"]) for r in status.collect()}
    assert st["patients"] == (24, 1) and st["observations"][0] == 480  # INCOME 'oops' -> corrupt, row kept
    roles = roles_from_clinical(tables)
    for name, df in roles.frames().items():  # no time of any table is lost
        for c in ("ts", "start"):
            if c in df.columns:
                assert df.where(F.col(c).isNull()).count() == 0, (name, c)
    assert roles.encounters.where("stop IS NULL").count() == 0
    bad = {r["table"]: r["bad_dates"] for r in status.collect()}
    assert all(n == 0 for m in bad.values() for n in m.values())
    out = tmp_path / "out"
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(base))
    res = run_pipeline(roles, str(out), PipelineConfig(min_pos_per_label=1), raw=patient_slices(tables))
    assert set(os.listdir(base)) == before  # nothing is left behind
    issues = spark.read.json(res["reports"]["issues"])
    # the fifth encounter of every patient costs far more: one outlier each
    assert issues.where("code = 'outliers'").count() == 24
    sizes = {m["split"]: m["n_patients"] for m in res["splits"]}
    assert sum(sizes.values()) == 24 and res["split_strategy"] == "stratified"
    assert len(res["temporal_channels"]) == 26
    ready = spark.read.parquet(res["model_ready"])
    row = ready.orderBy("patient_id").first()
    assert len(row["static"]) == 15 and len(row["temporal"]) == 720 and len(row["temporal"][0]) == 26
    assert row["sequence_length"] == 720 and row["time_index"][719] == 719.0
    grid = ready.select("patient_id", F.posexplode("temporal").alias("h", "row")).select(
        "patient_id", F.posexplode("row").alias("ch", "v"))
    live = {r["ch"] for r in grid.groupBy("ch").agg(F.countDistinct("v").alias("n")).where("n > 1").collect()}
    kinds = {res["temporal_channels"][c].split(":")[0] for c in live}
    assert {"medications", "procedures", "devices"} <= kinds
    hard = {r["patient_id"]: (r["icu_admission"], r["ventilator_need"]) for r in ready.collect()}
    # intubation is an ICU procedure but no ventilator keyword
    assert {p for p, t in hard.items() if t[0] == 1.0} == {f"pt-{i:03d}" for i in range(24) if i % 4 == 1}
    assert all(t[1] == 0.0 for t in hard.values())
    state = sinks.load_state(spark, str(out / "pipeline_state"))
    assert set(state) == {"static", "temporal"} and len(state["temporal"]) == 26
    ids = [r["patient_id"] for r in ready.select("patient_id").collect()]
    assert len(ids) == len(set(ids)) == 24
    text = spark.read.text(str(out / "pipeline_results")).first()[0]
    assert json.loads(text)["split_strategy"] == "stratified"
    b = ex.batches(ready.select("patient_id", "split", "static"), 5).collect()
    assert all(r["batch_len"] <= 5 for r in b) and sum(r["batch_len"] for r in b) == 24


def test_split_fallback_chain(spark):
    from conftest import make_roles
    from cadence.plans.pipeline import choose_split
    roles = make_roles(spark, patients=[(f"p{i}", None, None, None, None, None) for i in range(20)],
                       observations=[(f"p{i}", None, "x", "1") for i in range(20)])
    valid = roles.patients.select("patient_id")
    split, strategy, skipped = choose_split(roles, valid, PipelineConfig(split_strategy="temporal"))
    assert strategy == "random" and skipped == {"temporal": "no dated observations"}
    assert {r["split"]: r["n"] for r in split.groupBy("split").count().withColumnRenamed("count", "n").collect()} == \
        {"test": 2, "validation": 3, "train": 15}


def test_folder_by_uri_and_missing_folder(spark, tmp_path):
    src = tmp_path / "export"
    src.mkdir()
    _write_export(str(src), 4)
    rows = [{r["table"]: (r["rows"], r["corrupt_rows"]) for r in load_all_tables(spark, d)[1].collect()}
            for d in (str(src), f"file://{src}")]
    assert rows[0] == rows[1] and rows[0]["observations"][0] == 80
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_all_tables(spark, str(tmp_path / "nowhere"))


def test_bad_dates_are_counted(spark, tmp_path):
    (tmp_path / "observations.csv").write_text(
        "DATE,PATIENT,DESCRIPTION,VALUE\n2020-01-02T03:04:05Z,a,x,1\nsoon,a,x,1\n,a,x,1\n2020-13-01,b,x,1\n")
    _, status = load_all_tables(spark, str(tmp_path))
    assert {r["table"]: r["bad_dates"] for r in status.collect()}["observations"] == {"DATE": 2}


def test_timestamp_forms_keep_the_wall_clock(spark):
    forms = {"2020-01-02T03:04:05": (3, 4, 5, 0), "2020-01-02T03:04:05Z": (3, 4, 5, 0),
             "2020-01-02T03:04:05.123Z": (3, 4, 5, 123000), "2020-01-02 03:04:05.5": (3, 4, 5, 500000),
             "2020-01-02T03:04": (3, 4, 0, 0), "2020-01-02T03:04:05+02:00": (3, 4, 5, 0),
             "2020-01-02T03:04:05-0530": (3, 4, 5, 0), "2020-01-02": (0, 0, 0, 0)}
    df = spark.createDataFrame([(k,) for k in [*forms, "", "x", "2020-02-31"]], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", parse_ts(F.col("t")).alias("p")).collect()}
    for k, (h, m, s, us) in forms.items():
        assert got[k] == dt.datetime(2020, 1, 2, h, m, s, us), k
    assert got[""] is None and got["x"] is None and got["2020-02-31"] is None


PROBES = [["a", "Heart rate, \"resting\"", "80"], ["b", "two\nlines", "90"], ["c", "a, b \\", "95"], ["d", "cr\rinside", "1"],
          ["e", "plain\\n", "NA"], ["f", "", "null"], ["g", "5\" pipe, \"\"", " x "], ["h", "größe 日本", "n/a"]]


def _csv(path, header, rows, eol="\r\n"):
    q = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\r\n') else v
    path.write_bytes(eol.join(",".join(map(q, r)) for r in [header, *rows]).encode() + eol.encode())


@pytest.mark.parametrize("eol,keep", [("\n", "abcdefgh"), ("\r\n", "abcdefgh"), ("\n", "acefgh"), ("\r\n", "acegh")])
def test_csv_fields_as_pandas_reads_them(spark, tmp_path, eol, keep):
    rows = [r for r in PROBES if r[0] in keep]
    _csv(tmp_path / "observations.csv", ["PATIENT", "DESCRIPTION", "VALUE"], rows, eol)
    want = pd.read_csv(tmp_path / "observations.csv").astype(object)
    want = want.where(want.notna(), None).values.tolist()
    tables, status = load_all_tables(spark, str(tmp_path))
    got = [list(r) for r in tables["observations"].drop("_corrupt_record").collect()]
    assert got == want and len(got) == len(keep)
    st = {r["table"]: r for r in status.collect()}["observations"]
    assert (st["rows"], st["corrupt_rows"], st["absent_columns"], st["error"]) == (len(keep), 0, ["DATE"], None)
    from cadence.sources.tables import breaks_in_quotes
    assert breaks_in_quotes(spark, str(tmp_path / "observations.csv")) == ("b" in keep)


def test_wrong_rows_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "patients.csv").write_text("Id,BIRTHDATE,INCOME,LAT\np1,1980-01-01,oops,1.5\np2,1980-01-01,NaN,2\np3,1980-01-01\n"
                                           "p4,1980-01-01,10,3,extra\n\np5,,1e3,\n")
    tables, status = load_all_tables(spark, str(tmp_path))
    rows = {r["Id"]: r for r in tables["patients"].collect()}
    assert set(rows) == {"p1", "p2", "p3", "p4", "p5"}
    assert rows["p1"]["INCOME"] is None and rows["p1"]["LAT"] == 1.5 and rows["p1"]["_corrupt_record"] == "p1,1980-01-01,oops,1.5"
    assert rows["p2"]["INCOME"] is None and rows["p2"]["_corrupt_record"] is None and rows["p5"]["INCOME"] == 1000.0
    st = {r["table"]: r for r in status.collect()}["patients"]
    assert (st["rows"], st["corrupt_rows"]) == (5, 3)  # p1, p3 (short), p4 (long)


def test_only_the_folder_itself_is_read(spark, tmp_path):
    (tmp_path / "archive" / "old.csv").mkdir(parents=True)
    (tmp_path / "archive" / "patients.csv").write_text("Id\nold\n")
    (tmp_path / "archive" / "old.csv" / "part-0.csv").write_text("Id\nold\n")
    (tmp_path / "patients.csv").write_text("Id\nnew\n")
    (tmp_path / "parts.csv").mkdir()
    for i in range(2):
        (tmp_path / "parts.csv" / f"part-{i}.csv").write_text(f"Id\n{i}\n")
    from cadence.sources.tables import csv_files
    found = csv_files(spark, str(tmp_path))
    assert sorted(found) == ["parts", "patients"]
    tables, _ = load_all_tables(spark, str(tmp_path))
    assert [r["Id"] for r in tables["patients"].collect()] == ["new"]
    assert sorted(r["Id"] for r in tables["parts"].collect()) == ["0", "1"]


def test_pipeline_on_files_that_lack_columns(spark, tmp_path):
    src = tmp_path / "export"
    src.mkdir()
    _write_export(str(src))
    pats = pd.read_csv(src / "patients.csv").drop(columns=["DEATHDATE", "ETHNICITY", "SSN"])
    pats.to_csv(src / "patients.csv", index=False)
    pd.read_csv(src / "procedures.csv").drop(columns=["DESCRIPTION"]).to_csv(src / "procedures.csv", index=False)
    (src / "medications.csv").write_text("START,STOP,PATIENT,DESCRIPTION\n")  # header only
    (src / "devices.csv").write_bytes(b"")  # unreadable: no header
    (src / "encounters.csv").write_text("PATIENT\n" + "".join(f"pt-{i:03d}\n" for i in range(24)))
    tables, status = load_all_tables(spark, str(src))
    st = {r["table"]: r for r in status.collect()}
    assert st["patients"]["absent_columns"] == ["DEATHDATE", "ETHNICITY", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE", "LAT", "LON"]
    assert st["devices"]["error"] == "no header" and st["devices"]["rows"] == 0
    assert st["medications"]["rows"] == 0 and st["medications"]["error"] is None and st["procedures"]["absent_columns"] == ["DESCRIPTION", "BASE_COST"]
    res = run_pipeline(roles_from_clinical(tables), str(tmp_path / "out"), PipelineConfig(), raw=patient_slices(tables))
    ready = spark.read.parquet(res["model_ready"])
    assert ready.count() == 24 and sum(m["n_patients"] for m in res["splits"]) == 24
    assert res["split_strategy"] != "stratified" or res["split_skipped"] == {}
