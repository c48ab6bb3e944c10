"""Sources: declared schemas, CSV/Parquet scans, and the normalised role frames.

The clinical export is one CSV per table. We never infer schemas on big
CSVs: each known table has a declared ``StructType``; unknown extra columns
are kept as strings by reading the header first. A table that is absent
becomes an *empty frame with the declared schema*, so operator code never
branches on table presence.

Operators work on normalised *role frames* (``Roles``):

================  ============================================================
patients          patient_id, birthdate DATE, deathdate DATE, gender, race, ethnicity
observations      patient_id, ts, description, value (text or number)
conditions        patient_id, ts (START), description
encounters        patient_id, start, stop, description
medications       patient_id, start, stop, description
procedures        patient_id, ts (DATE), description
devices           patient_id, start, stop, description
================  ============================================================
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------------------
# Clinical CSV export: declared schemas (only the columns operators read are
# typed; timestamps are parsed after the scan so bad text becomes NULL).
# ---------------------------------------------------------------------------

S = T.StringType()
D = T.DoubleType()
CLINICAL_SCHEMAS: dict[str, list[tuple[str, T.DataType]]] = {
    "patients": [("Id", S), ("BIRTHDATE", S), ("DEATHDATE", S), ("GENDER", S), ("RACE", S), ("ETHNICITY", S),
                 ("HEALTHCARE_EXPENSES", D), ("HEALTHCARE_COVERAGE", D), ("INCOME", D), ("LAT", D), ("LON", D)],
    "observations": [("DATE", S), ("PATIENT", S), ("DESCRIPTION", S), ("VALUE", S)],
    "conditions": [("START", S), ("STOP", S), ("PATIENT", S), ("DESCRIPTION", S)],
    "encounters": [("START", S), ("STOP", S), ("PATIENT", S), ("DESCRIPTION", S), ("BASE_ENCOUNTER_COST", D),
                   ("TOTAL_CLAIM_COST", D), ("PAYER_COVERAGE", D)],
    "medications": [("START", S), ("STOP", S), ("PATIENT", S), ("DESCRIPTION", S), ("BASE_COST", D),
                    ("PAYER_COVERAGE", D), ("DISPENSES", D), ("TOTALCOST", D)],
    "procedures": [("DATE", S), ("PATIENT", S), ("DESCRIPTION", S), ("BASE_COST", D)],
    "devices": [("START", S), ("STOP", S), ("PATIENT", S), ("DESCRIPTION", S)],
}
# Every column is read as text (no schema inference on large CSVs) and a
# declared number is cast after the scan: text that is no number yields NULL and
# the row in ``_corrupt_record``; the row is kept.

#: Texts that the reference's CSV reader takes for a missing value.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _declared(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, t, True) for c, t in CLINICAL_SCHEMAS[name]])


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line of a CSV file ends inside quotes. Quotes of a field that ends on its line are
    even in number (a quote inside is doubled), so a line ends inside quotes only if some line has an odd
    number. One pass over the text, in any number of splits."""
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).select(F.lit(1)).limit(1).isEmpty()


def load_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read one CSV file (or folder of part files) as RFC 4180 describes it: a quote inside quotes is
    doubled, a quoted field may hold line ends, a backslash is a character like any other.

    A file without line ends inside quotes is split among tasks; another is read whole by one task, as
    a stream of records. Missing texts are NULL. Rows of another length than the header, or with text in a
    declared number, are kept with their text in ``_corrupt_record`` (PERMISSIVE), never dropped.
    Raises if the file has no header.
    """
    reader = (spark.read.option("header", True).option("escape", '"').option("multiLine", breaks_in_quotes(spark, path)))
    columns = reader.csv(path).columns  # header only: all strings
    if not columns:
        raise ValueError("no header")
    schema = T.StructType([T.StructField(c, S, True) for c in [*columns, "_corrupt_record"]])
    df = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
          .option("maxCharsPerColumn", -1).csv(path))
    numbers = {c for c, t in CLINICAL_SCHEMAS.get(name, []) if isinstance(t, T.DoubleType)} & set(columns)
    q = {c: F.col(f"`{c}`") for c in columns}
    text = {c: F.when(~q[c].isin(*MISSING_TEXTS), q[c]) for c in columns}
    value = {c: text[c].try_cast("double") if c in numbers else text[c] for c in columns}
    wrong = reduce(lambda a, b: a | b, [text[c].isNotNull() & value[c].isNull() for c in sorted(numbers)], F.lit(False))
    row = F.to_csv(F.struct(*[q[c].alias(c) for c in columns]))
    return df.select(*[value[c].alias(c) for c in columns],
                     F.coalesce("_corrupt_record", F.when(wrong, row)).alias("_corrupt_record"))


# Columns of the declared tables that hold dates or times.
TIME_COLUMNS = {"patients": ("BIRTHDATE", "DEATHDATE"), "observations": ("DATE",), "conditions": ("START", "STOP"),
                "encounters": ("START", "STOP"), "medications": ("START", "STOP"), "procedures": ("DATE",),
                "devices": ("START", "STOP")}


def csv_files(spark: SparkSession, directory: str) -> dict[str, str]:
    """Stem -> path of every ``*.csv`` file, or folder of part files as Spark
    writes them, that lies in a folder itself (not below it), in any file
    system Spark reads. A missing folder raises."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(f"PATH_NOT_FOUND: {directory}")
    found = {f.getPath().getName(): f.getPath().toString() for f in fs.listStatus(folder)}
    return {name[:-4]: found[name] for name in sorted(found) if name.endswith(".csv")}


def load_status(name: str, df: DataFrame, file: bool) -> DataFrame:
    """One row about a loaded table; see ``load_all_tables``."""
    data_cols = [c for c in df.columns if c != "_corrupt_record"]
    col = {c: F.col(f"`{c}`") for c in data_cols}
    lacking = [c for c, _ in CLINICAL_SCHEMAS.get(name, []) if c not in data_cols]
    times = [x for c in TIME_COLUMNS.get(name, ()) if c in data_cols for x in (
        F.lit(c), F.count_if((F.trim(col[c]) != "") & parse_ts(col[c]).isNull()))]
    # The CSV reader parses only the columns a query reads, so a malformed
    # field is noticed only if its column is read: ``non_empty_rows`` reads
    # every data column (this also satisfies Spark's rule against scans
    # that read the corrupt-record column alone).
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count(F.coalesce(*[col[c].cast("string") for c in data_cols])).alias("non_empty_rows"),
                  F.count_if(F.col("_corrupt_record").isNotNull()).alias("corrupt_rows"),
                  F.create_map(*times).cast("map<string,bigint>").alias("bad_dates")).select(
        F.lit(name).alias("table"), "rows", "non_empty_rows", "corrupt_rows", "bad_dates",
        F.array(*[F.lit(c) for c in lacking]).cast("array<string>").alias("absent_columns"),
        F.lit(None if file else "no file").cast("string").alias("error"))


def load_all_tables(spark: SparkSession, directory: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """S1 + S2: every ``*.csv`` in ``directory`` as a table named by its stem,
    plus a ``load_status(table, rows, non_empty_rows, corrupt_rows, bad_dates,
    absent_columns, error)`` frame (lazy; ``bad_dates``: column -> non-empty
    values that are no date; ``absent_columns``: declared columns that the file
    lacks). A file that can't be read becomes a status row with its error.
    Declared tables that are absent or unreadable are empty frames with their
    schema; a table keeps the columns of its file (``reconciled`` adds those
    that operators expect)."""
    tables: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, path in csv_files(spark, directory).items():
        try:
            tables[name] = load_csv_table(spark, path, name)
        except (AnalysisException, Py4JError, PySparkException, ValueError) as e:
            failed[name] = str(e).split("\n")[0][:500] or type(e).__name__
    status = [load_status(n, df, True) for n, df in tables.items()]
    for n in CLINICAL_SCHEMAS:
        if n not in tables:
            tables[n] = empty_frame(spark, T.StructType(_declared(n).fields + [T.StructField("_corrupt_record", S, True)]))
            if n not in failed:
                status.append(load_status(n, tables[n], False))
    lost = [(n, 0, 0, 0, {}, [c for c, _ in CLINICAL_SCHEMAS.get(n, [])], why) for n, why in failed.items()]
    status.append(spark.createDataFrame(lost, "table string, rows long, non_empty_rows long, corrupt_rows long, "
                                              "bad_dates map<string,bigint>, absent_columns array<string>, error string"))
    return tables, reduce(DataFrame.unionByName, status)


def reconciled(df: DataFrame, name: str) -> DataFrame:
    """A table with every declared column: those its file lacks are typed NULLs (all values missing)."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in CLINICAL_SCHEMAS[name] if c not in df.columns})


def parse_ts(c) -> F.Column:
    """ISO text -> TIMESTAMP_NTZ: a date, or a date and a time (``T`` or a space
    between; seconds and fractions optional) with or without a zone. The wall
    clock is kept and the zone dropped, as the reference does (P5); anything
    else -> NULL."""
    zone = r"(?i)(:\d{2}(?:\.\d+)?)\s*(?:Z|UTC|[+-]\d{2}(?::?\d{2})?)$"
    return F.regexp_replace(F.trim(c), zone, "$1").try_cast("timestamp_ntz")


@dataclass
class Roles:
    patients: DataFrame
    observations: DataFrame
    conditions: DataFrame
    encounters: DataFrame
    medications: DataFrame
    procedures: DataFrame
    devices: DataFrame
    value_is_numeric: bool = False

    def with_(self, **kw) -> "Roles":
        return replace(self, **kw)

    def frames(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "value_is_numeric"}


def patient_slices(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw tables keyed by ``patient_id`` (``Id`` in patients, ``PATIENT``
    elsewhere), every CSV column kept: the unit the missing-value and outlier
    scans run on. Tables without a patient column are left out."""
    out = {}
    for name, df in tables.items():
        cols = [c for c in df.columns if c != "_corrupt_record"]
        key = "Id" if name == "patients" and "Id" in cols else ("PATIENT" if "PATIENT" in cols else None)
        if key is None:
            continue
        out[name] = df.select(*cols).withColumnRenamed(key, "patient_id")
    return out


def roles_from_clinical(tables: dict[str, DataFrame]) -> Roles:
    """Normalise the clinical export's column names onto role frames; a column
    that a file lacks is missing in every row."""
    tables = {n: reconciled(tables[n], n) for n in CLINICAL_SCHEMAS}
    p = tables["patients"]
    pick = lambda t, *cs: tables[t].select(*cs)
    return Roles(
        patients=p.select(F.col("Id").alias("patient_id"),
                          F.try_to_date(F.col("BIRTHDATE")).alias("birthdate"),
                          F.try_to_date(F.col("DEATHDATE")).alias("deathdate"),
                          F.col("GENDER").alias("gender"), F.col("RACE").alias("race"),
                          F.col("ETHNICITY").alias("ethnicity")),
        observations=pick("observations", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("DATE")).alias("ts"),
                          F.col("DESCRIPTION").alias("description"), F.col("VALUE").alias("value")),
        conditions=pick("conditions", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("START")).alias("ts"),
                        F.col("DESCRIPTION").alias("description")),
        encounters=pick("encounters", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("START")).alias("start"),
                        parse_ts(F.col("STOP")).alias("stop"), F.col("DESCRIPTION").alias("description")),
        medications=pick("medications", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("START")).alias("start"),
                         parse_ts(F.col("STOP")).alias("stop"), F.col("DESCRIPTION").alias("description")),
        procedures=pick("procedures", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("DATE")).alias("ts"),
                        F.col("DESCRIPTION").alias("description")),
        devices=pick("devices", F.col("PATIENT").alias("patient_id"), parse_ts(F.col("START")).alias("start"),
                     parse_ts(F.col("STOP")).alias("stop"), F.col("DESCRIPTION").alias("description")),
        value_is_numeric=False,
    )
