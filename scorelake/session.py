"""Session defaults and the one shared scratch location the engine writes to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only what the engine's results depend on; sizing stays with the cluster.
_NEEDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites are not recorded for every column: building wide plans takes half the time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Rows can hold long texts; smaller batches keep a Python worker's memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def engine_session(app_name: str = "scorelake", **overrides: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_NEEDED, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local master, whose tasks share this machine, gets a
    folder of our own where it is unset; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scorelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"scorelake-{purpose}-{uuid.uuid4().hex}")


def stored_once(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back, for results that several plans read."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
