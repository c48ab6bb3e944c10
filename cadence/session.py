"""Spark session defaults and the checkpoint directory contract.

Every operator is lazy; the only session state we depend on is
* a UTC session time zone (timestamp arithmetic on TIMESTAMP_NTZ goes
  through the session zone),
* AQE on, so joins against per-entity tables become broadcast joins only
  when the runtime-measured size is under the threshold, and skewed join
  partitions are split,
* a reliable checkpoint directory (``spark.checkpoint.dir``) for the
  operators that cut lineage (ranking, prefix sums).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Broadcast is only ever chosen by AQE from *measured* shuffle sizes; this is
# the ceiling for those runtime decisions (per broadcast side).
AQE_BROADCAST_BYTES = 64 * 1024 * 1024


def session_defaults(shuffle_partitions: int) -> dict[str, str]:
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(AQE_BROADCAST_BYTES),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "cadence") -> SparkSession:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in session_defaults(parts).items():
        b = b.config(k, v)
    b = b.config("spark.driver.memory", os.environ.get("CADENCE_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder; we refuse
    to invent a machine-local one there. In local mode (tests, bench) an unset
    directory is replaced by a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: configure a shared folder for reliable checkpoints")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cadence-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
