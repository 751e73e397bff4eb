"""Incremental forms: rows arriving in a results folder, summed, de-duplicated, cached or watched.

Every query takes its checkpoint location from the caller, and restarts continue from it. State that grows with keys is held by the disk-backed
state store, unless the session names another one.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scorelake.operators.aggregates import EXACT, keyed_results, summable
from scorelake.operators.grid import cache_bucket, new_cache_entries
from scorelake.operators.order_stats import nearest_rank, sketch_bucket, sketch_bounds
from scorelake.operators.ranking import last_progress
from scorelake.schemas import RESULT_ROW, RESUME_KEYS, SUMMARY_KEYS
from scorelake.sources.readers import path_exists


def stream_folder(
    spark: SparkSession, folder: str, schema: str | T.StructType = RESULT_ROW, fmt: str = "json",
    name_glob: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def append_stream(rows: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append arriving rows to a table; a restart goes on after the last committed file."""
    return (
        rows.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(out)
    )


_SUMS = ["request_count", "success_count", "parse_applicable_count", "parse_success_count", "total_tokens_sum", "retry_count", "latency_count"]
_EXACT_SUMS = ["latency_ms_sum", "cost_sum"]


def running_summary(rows: DataFrame) -> DataFrame:
    """Sums and counts per task, model, step and latency bucket as they grow.

    The buckets are the rank sketch that :func:`summary_rates` takes p95 from: their counts add up like the sums beside them, so the state of any
    split of the rows merges to the same table. A group has some hundreds of buckets, whatever the number of its rows.
    """
    latency = summable(F.col("latency_ms"))
    exact = lambda c: F.sum(F.coalesce(summable(c), F.lit(0.0)).cast(EXACT)).cast(EXACT)
    measures = [
        F.count("*"), F.count_if("success"), F.count_if("parse_applicable"), F.count_if(F.col("parse_applicable") & F.col("parse_success")),
        F.sum(F.col("total_tokens").cast("bigint")), F.sum(F.col("retry_count").cast("bigint")), F.count(latency), exact(F.col("latency_ms")),
        exact(F.col("cost_estimate")), F.min(latency), F.max(latency),
    ]
    names = [*_SUMS, *_EXACT_SUMS, "latency_lo", "latency_hi"]
    keyed = keyed_results(rows).withColumn("bucket", sketch_bucket(latency))
    return keyed.groupBy(*SUMMARY_KEYS, "bucket").agg(*[m.alias(n) for m, n in zip(measures, names)])


def merged_summaries(states: DataFrame) -> DataFrame:
    """States of :func:`running_summary` over separate rows, as one."""
    exact = [F.sum(c).cast(EXACT).alias(c) for c in _EXACT_SUMS]
    return states.groupBy(*SUMMARY_KEYS, "bucket").agg(
        *[F.sum(c).alias(c) for c in _SUMS], *exact, F.min("latency_lo").alias("latency_lo"), F.max("latency_hi").alias("latency_hi"))


def summary_rates(running: DataFrame) -> DataFrame:
    """The state rolled up per task, model and step. ``p95_low`` and ``p95_high`` are the least and greatest latency of the bucket that holds the exact
    p95: the value of rank ceil(0.95 n) lies between them, and they are at most one part in 32 apart (a thousandth of a millisecond near zero)."""
    n = F.col("request_count")
    whole = running.groupBy(*SUMMARY_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.sum(c).cast("double").alias(c) for c in _EXACT_SUMS])
    p95 = sketch_bounds(running.where("bucket is not null"), SUMMARY_KEYS, "latency_count", "latency_lo", "latency_hi", nearest_rank("0.95"))
    return whole.join(p95, SUMMARY_KEYS, "left").select(
        *SUMMARY_KEYS, "request_count", "success_count",
        F.round(F.col("success_count") / n, 4).alias("success_rate"),
        F.round(F.coalesce(F.col("latency_ms_sum") / F.nullif("latency_count", F.lit(0)), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.col("low").alias("p95_low"), F.col("high").alias("p95_high"),
        F.round(F.col("total_tokens_sum") / n, 2).alias("avg_total_tokens"),
        F.round(F.coalesce(F.col("parse_success_count") / F.nullif("parse_applicable_count", F.lit(0)), F.lit(0.0)), 4).alias("parse_rate"),
        "retry_count", F.round("cost_sum", 6).alias("cost_estimate"),
    )


def write_complete(agg: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of an aggregate as a table, one folder a batch; readers take the newest whole one with :func:`read_newest`.

    A batch that fails on the way leaves the last one readable; a repeated batch writes its own folder again.
    """
    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:012d}")

    return (
        agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(store).start()
    )


def read_newest(spark: SparkSession, out: str) -> DataFrame:
    """The last committed batch under ``out``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(f.getPath()) for f in fs.listStatus(root) if path_exists(spark, f"{f.getPath()}/_SUCCESS")]
    return spark.read.parquet(max(done))


_STORE = "spark.sql.streaming.stateStore.providerClass"
_DISK_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """State on the executors' disks instead of their heaps, and progress of many batches kept, unless the session says otherwise."""
    if spark.conf.get(_STORE, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_STORE, _DISK_STORE)
    if int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")) < 10_000:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10000")


def dedup_stream(rows: DataFrame, out: str, checkpoint: str, keys: list[str] = RESUME_KEYS, time: str = "ts", delay: str | None = "7 days") -> StreamingQuery:
    """Append the first row of every key; repeats whose event time is within ``delay`` of it are dropped.

    Without a delay a key is held for good: whenever it comes again it is dropped, no row is late, and ``time`` is not looked at. The state then has one entry a
    key, on the executors' disks.

    With one, a key is held in keyed state until the watermark (the greatest event time less ``delay``) has passed its row's time plus ``delay``, so state is bounded by what
    arrives within that span and not by the history; what was stored is never read again. Rows behind the watermark that the batch before theirs started with are left
    out, as what they repeat may be gone: :func:`stream_counts` has their number. A row without a time is remembered for its own batch only.
    """
    use_disk_state(rows.sparkSession)
    first = rows.dropDuplicates(keys) if delay is None else rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return append_stream(first, out, checkpoint)


def stream_counts(query: StreamingQuery) -> dict[str, int]:
    """Of a finished run: rows read, rows left out as late, and keys in state at the end and at most."""
    batches = [dict(p) if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    states = [(op["numRowsTotal"], op["numRowsDroppedByWatermark"]) for b in batches for op in b["stateOperators"]]
    return {
        "rows": sum(b["numInputRows"] for b in batches), "late": sum(late for _, late in states),
        "keys": states[-1][0] if states else 0, "most_keys": max((n for n, _ in states), default=0),
    }


def fill_cache(calls: DataFrame, cache_path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's successful calls whose key the cache does not hold yet.

    The cache is kept in folders by the first two letters of the key (a hex digest, so 256 at most), and by batch within them;
    only the folders that a batch has keys for are read. A repeated batch replaces what it wrote.
    """
    columns = calls.columns

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("success").withColumn("bucket", cache_bucket(F.col("cache_key")))
        if path_exists(spark, cache_path):
            touched = [row[0] for row in fresh.select("bucket").distinct().collect()]
            known = spark.read.schema("cache_key string, bucket string, batch bigint").parquet(cache_path)
            known = known.where((F.col("batch") < number) & F.col("bucket").isin(touched))
            fresh = new_cache_entries(fresh, known, ["bucket", "cache_key"])
        else:
            fresh = new_cache_entries(fresh, None, ["bucket", "cache_key"])
        fresh.select(*columns, "bucket").withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(cache_path)

    return (
        calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    )


def watch_progress(lines: DataFrame, keys: list[str], sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand the progress over all log lines so far to ``sink`` after each batch that brings some."""
    return (
        last_progress(lines, keys).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(lambda state, _: sink(state)).start()
    )


def finish(query: StreamingQuery) -> None:
    """Wait for an available-now query; its failure is raised here."""
    query.awaitTermination()
