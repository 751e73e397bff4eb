"""Sinks. Writes go through Spark's commit protocol; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.text import safe_name
from scorelake.sources.readers import path_exists
from scorelake.sources.versions import TableGroup


def append_results(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").format(fmt).save(path)


def write_by_model(rows: DataFrame, folder: str) -> None:
    """Results split by task and model; marks unsafe in file names become ``-``. Pairs not written stay as they were.

    The rebalance groups each pair's rows into few files, and at run time splits a pair that is too big for
    one task, so a dominant model is written by many.
    """
    safe = rows.withColumn("model_id", safe_name(F.col("model_id")))
    safe.hint("rebalance", F.col("task_name"), F.col("model_id")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("task_name", "model_id").json(folder)


def write_csv(df: DataFrame, path: str, *order: Column | str) -> None:
    """CSV with a header, blanks for null. Sorted output stays in several ordered part files."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_summary(summaries: list[DataFrame], path: str) -> bool:
    """CSV with the union of all columns; nothing is written for zero rows."""
    merged = summaries[0]
    for more in summaries[1:]:
        merged = merged.unionByName(more, allowMissingColumns=True)
    if merged.isEmpty():
        return False
    write_csv(merged, path, "task_name", "step_id", "model_id")
    return True


def write_samples(samples: DataFrame, path: str) -> None:
    """JSONL samples; an absent optional value leaves its key out."""
    samples.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def append_run(run: DataFrame, snapshot: DataFrame, folder: str) -> None:
    """One row per run (settings, environment, fingerprint) and its masked model snapshot, a row per model."""
    run.write.mode("append").parquet(f"{folder}/runs")
    snapshot.write.mode("append").parquet(f"{folder}/model_snapshots")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` plus the rows of ``old`` whose key ``new`` does not bring."""
    touched = new.select(key).distinct()
    return old.join(touched, key, "left_anti").unionByName(new, allowMissingColumns=True)


BUCKETS = 64


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, changed: DataFrame | None = None,
           buckets: int = BUCKETS) -> None:
    """Replace by key in a parquet table kept in hash buckets; only buckets that ``changed`` keys touch are rewritten.

    ``changed`` names the replaced keys (so a parent without children still clears its old ones); by default
    they are the keys of ``new``. The number of buckets is a partition level of the table; another one is refused.
    """
    fresh = _bucketed(new, key, buckets)
    if path_exists(spark, path):
        keys = _bucketed((changed if changed is not None else new).select(key).distinct(), key, buckets)
        stored = spark.read.parquet(path)
        kept_in = [row[0] for row in stored.select("buckets").distinct().limit(2).collect()]
        if kept_in not in ([], [buckets]):
            raise ValueError(f"the table is kept in {kept_in} buckets, not {buckets}")
        stored = stored.where(F.col(key).isNotNull())
        kept = (
            stored.join(keys.select("bucket").distinct(), "bucket", "left_semi").join(keys.select(key), key, "left_anti")
        )
        # A touched bucket that ends up empty must still be overwritten: a row without a key stands for it.
        markers = keys.select("bucket").distinct()
        fresh = kept.select(*fresh.columns).unionByName(fresh).unionByName(markers, allowMissingColumns=True)
    # Rebalanced: few files per bucket, and a bucket with a dominant key is split over tasks.
    writer = fresh.withColumn("buckets", F.lit(buckets)).hint("rebalance", F.col("bucket")).write.partitionBy("buckets", "bucket").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def read_upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).drop("buckets", "bucket").where(F.col(key).isNotNull())


def upsert_plates(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int:
    """One payload's rows per plate into the four tables, in one commit: parents by id, children by plate, each replacing what was there.

    A fault on the way, or another writer that was faster, leaves all four tables as they were. The version's number is returned. Several payloads of a plate
    are cut to the newest before they are split, see ``readers.newest_payloads``.
    """
    parents = tables["plates"].select("id")
    changes = {"plates": (tables["plates"], "id", None)}
    for child in ("stocks", "industrial_chains", "question_answers"):
        changes[child] = (tables[child], "plate_id", parents)
    return TableGroup(spark, folder).replace(changes)


def read_plates(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The four tables as one version has them, by default the newest."""
    group = TableGroup(spark, folder)
    version = group.newest() if version is None else version
    return {name: group.read(name, version) for name in group.states(version)}


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (columns ``pos`` and ``line``) as ordered text part files."""
    lines.orderBy("pos").select("line").write.mode("overwrite").text(path)
