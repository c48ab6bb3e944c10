"""Bind the driver's test tables onto the clinical roles.

The test tables carry no clinical text, so every binding below is a plain,
documented projection of real columns; the operators themselves are the
same ones that run on the clinical export.

events binding (timeline roles; all timestamps are in one month of 2024)
  observations  every event: description = event_type, value = value
  conditions    events of type 'error' (START = ts)
  encounters    events of type 'signup' (START = ts, open STOP)
  medications   every event as an interval [ts, next ts of the same user and
  devices       type), open for the last one
  procedures    events of type 'purchase' or 'error'

customer/orders binding (static, quality and split roles)
  patients      customer: birth date = date of the customer's first order less
                (key mod 80) years, unknown for every 37th key;
                death date = first order date + 30 days when the account
                balance is negative, gender/race/ethnicity from segment/nation
  conditions    orders: description = "<priority> <status>" (priority
                '4-NOT SPECIFIED' is treated as missing text)
  observations  orders: ts = order date, description = priority, value = total
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vocab import Vocab
from ..operators.ranking import checkpointed, next_in_group
from .tables import Roles, read_table

# ---------------------------------------------------------------------------
# Fixed binding values: vocabularies and keyword lists over the test tables'
# event_type / order-priority text.
# ---------------------------------------------------------------------------

EVENT_VITALS = Vocab.of("event_vitals", [
    ("engagement", ["click", "view"]),
    ("conversion", ["purchase", "signup"]),
    ("failure", ["error", "err"]),
])
EVENT_MEDICATIONS = Vocab.of("event_medications", [
    ("browsing", ["view"]),
    ("clicking", ["click"]),
    ("buying", ["purchase"]),
])
EVENT_PROCEDURES = Vocab.of("event_procedures", [
    ("checkout", ["purchase"]),
    ("failure", ["error"]),
])
EVENT_DEVICES = Vocab.of("event_devices", [
    ("session", ["signup", "view"]),
    ("alarm", ["error"]),
])
EVENT_TARGETS = {
    "severe_condition": ("error",),
    "critical_procedure": ("purchase",),
    "icu_encounter": ("signup",),
    "icu_procedure": ("error",),
    "ventilator_procedure": ("purch",),
}
EVENT_SPLIT_FLAGS = {"icu": ("signup",), "ventilator": ("error", "purchase")}

ORDER_COMORBIDITIES = Vocab.of("order_comorbidities", [
    ("diabetes", ["1-urgent p"]),
    ("hypertension", ["2-high p"]),
    ("obesity", ["3-medium p"]),
    ("copd", ["not specified p"]),
    ("heart_disease", ["5-low p"]),
])
ORDER_COHORT_KEYWORDS = ("urgent",)
EVENT_COHORT_KEYWORDS = ("err", "purch")
SEGMENT_GENDER = {"BUILDING": "F", "AUTOMOBILE": "M", "HOUSEHOLD": "F", "FURNITURE": "X"}  # MACHINERY -> NULL
RACE_BY_NATION_MOD7 = ("white", "black", "asian", "native", "other", "martian", None)
ETHNICITY_BY_NATION_MOD3 = ("nonhispanic", "hispanic", None)


def _empty(spark: SparkSession, cols: list[tuple[str, T.DataType]]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(c, t, True) for c, t in cols]))


def event_intervals(ev: DataFrame) -> DataFrame:
    """[ts, next ts of the same user and event type); the last one is open."""
    base = ev.select(F.col("user_id").alias("patient_id"), "event_type", "event_id", "ts")
    nxt = next_in_group(base, ["patient_id", "event_type"], ["ts", "event_id"], "ts", "stop")
    # read three times (extent start, extent stop, channels): materialise once
    return checkpointed(nxt.select("patient_id", F.col("ts").alias("start"), "stop",
                                   F.col("event_type").alias("description")))


def event_roles(spark: SparkSession, sf_dir: str, with_intervals: bool = True) -> Roles:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    pts = lambda cond: ev.where(cond).select(F.col("user_id").alias("patient_id"), "ts",
                                            F.col("event_type").alias("description"))
    ivl = event_intervals(ev) if with_intervals else _empty(
        spark, [("patient_id", T.LongType()), ("start", T.TimestampNTZType()), ("stop", T.TimestampNTZType()),
                ("description", T.StringType())])
    return Roles(
        patients=customer_patients(spark, sf_dir),
        observations=ev.select(F.col("user_id").alias("patient_id"), "ts", F.col("event_type").alias("description"),
                               "value"),
        conditions=pts(F.col("event_type") == "error"),
        encounters=ev.where(F.col("event_type") == "signup").select(
            F.col("user_id").alias("patient_id"), F.col("ts").alias("start"),
            F.lit(None).cast("timestamp_ntz").alias("stop"), F.col("event_type").alias("description")),
        medications=ivl,
        procedures=pts(F.col("event_type").isin("purchase", "error")),
        devices=ivl,
        value_is_numeric=True,
    )


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate"])
    return o.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.min("o_orderdate").alias("first_order"))


def _case_map(c, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v)))
    return out


def customer_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    fo = first_orders(spark, sf_dir)
    x = c.join(fo.hint("merge"), c.c_custkey == fo.patient_id, "left")
    race = F.element_at(F.array(*[F.lit(r) for r in RACE_BY_NATION_MOD7]), (F.col("c_nationkey") % 7 + 1).cast("int"))
    eth = F.element_at(F.array(*[F.lit(r) for r in ETHNICITY_BY_NATION_MOD3]), (F.col("c_nationkey") % 3 + 1).cast("int"))
    first = F.to_date("first_order")
    birth = F.add_months(first, -12 * (F.col("c_custkey") % 80).cast("int"))
    return x.select(
        F.col("c_custkey").alias("patient_id"),
        F.when(F.col("c_custkey") % 37 != 0, birth).alias("birthdate"),
        F.when(F.col("c_acctbal") < 0, F.date_add(first, 30)).alias("deathdate"),
        _case_map(F.col("c_mktsegment"), SEGMENT_GENDER).alias("gender"),
        race.alias("race"), eth.alias("ethnicity"))


def order_roles(spark: SparkSession, sf_dir: str) -> Roles:
    """Customer-level roles for static features, quality and splits."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderdate", "o_orderpriority"])
    prio = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    cond = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("ts"),
                    F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_orderstatus")).alias("description"))
    obs = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("ts"),
                   prio.alias("description"), F.col("o_totalprice").alias("value"))
    e = lambda cols: _empty(spark, cols)
    ivl_cols = [("patient_id", T.LongType()), ("start", T.TimestampNTZType()), ("stop", T.TimestampNTZType()),
                ("description", T.StringType())]
    return Roles(
        patients=customer_patients(spark, sf_dir),
        observations=obs,
        conditions=cond,
        encounters=e(ivl_cols),
        medications=e(ivl_cols),
        procedures=e([("patient_id", T.LongType()), ("ts", T.TimestampNTZType()), ("description", T.StringType())]),
        devices=e(ivl_cols),
        value_is_numeric=True,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions table ``(patient_id, split, task, prediction, target)``:
    document scores n_chars / 20000 against the quality / toxic labels (the
    ventilator task gets an unbounded score so the logistic step applies),
    and a regression pair from line items: price estimate vs extended price
    (both / 1000). Some rows lack a prediction (documents and orders by key) or
    a target (toxic labels), as rows of patients without a score do."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    doc = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    x = lab.join(doc, "doc_id")
    s = F.when(F.col("doc_id") % 29 != 0, F.col("n_chars") / F.lit(20000.0))
    x = x.withColumn("toxic", F.when(F.col("doc_id") % 37 != 0, F.col("toxic")))
    base = lambda task, p, t: x.select(F.col("doc_id").alias("patient_id"), F.lit("test").alias("split"),
                                       F.lit(task).alias("task"), p.cast("double").alias("prediction"),
                                       F.col(t).cast("double").alias("target"))
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                 "l_extendedprice"])
    pt = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    reg = li.join(pt, li.l_partkey == pt.p_partkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("patient_id"), F.lit("test").alias("split"),
        F.lit("length_of_stay").alias("task"),
        F.when(F.col("l_orderkey") % 31 != 0, F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("prediction"),
        (F.col("l_extendedprice") / 1000.0).alias("target"))
    return (base("mortality_risk", s, "quality")
            .unionByName(base("icu_admission", s, "toxic"))
            .unionByName(base("ventilator_need", (s - F.lit(0.5)) * F.lit(4.0), "quality"))
            .unionByName(reg))


def coverage_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as encounters: START = order date, STOP = last ship date of its lines."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop"))
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("start"), "stop")
