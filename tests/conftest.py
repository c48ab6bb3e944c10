from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from cadence.session import ensure_checkpoint_dir, session_defaults  # noqa: E402
from cadence.sources.tables import Roles  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    b = SparkSession.builder.master("local[4]").appName("cadence-tests")
    for k, v in session_defaults(4).items():
        b = b.config(k, v)
    s = b.config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


T0 = dt.datetime(2024, 3, 1, 8, 0, 0)

PAT = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("birthdate", T.DateType()),
                    T.StructField("deathdate", T.DateType()), T.StructField("gender", T.StringType()),
                    T.StructField("race", T.StringType()), T.StructField("ethnicity", T.StringType())])
OBS = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                    T.StructField("description", T.StringType()), T.StructField("value", T.StringType())])
PTS = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                    T.StructField("description", T.StringType())])
IVL = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("start", T.TimestampNTZType()),
                    T.StructField("stop", T.TimestampNTZType()), T.StructField("description", T.StringType())])


def make_roles(spark, patients=(), observations=(), conditions=(), encounters=(), medications=(),
               procedures=(), devices=()) -> Roles:
    c = spark.createDataFrame
    return Roles(patients=c(list(patients), PAT), observations=c(list(observations), OBS),
                 conditions=c(list(conditions), PTS), encounters=c(list(encounters), IVL),
                 medications=c(list(medications), IVL), procedures=c(list(procedures), PTS),
                 devices=c(list(devices), IVL), value_is_numeric=False)


def h(hours: float = 0, minutes: float = 0, seconds: float = 0) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours, minutes=minutes, seconds=seconds)
