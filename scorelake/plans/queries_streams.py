"""Incremental forms run to their end over the whole events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators.grid import literal_rows
from scorelake.plans.adapters import Tables, results_from_events
from scorelake.plans.queries_stats import _RATE
from scorelake.plans.registry import query
from scorelake.session import shared_dir
from scorelake.streaming import increments as I


def _events(t: Tables):
    """The events table as an arriving folder."""
    schema = t.table("events").schema
    return I.stream_folder(t.spark, t.folder, schema, "parquet", name_glob="events.parquet")


def _arriving(t: Tables, parts):
    """The events table arriving in batches, one after the other; a trigger takes as many files as the largest batch has."""
    landing = shared_dir(t.spark, "landing")
    events, files = t.table("events"), [0]
    for part in parts:
        events.where(part).write.mode("append").parquet(landing)
        files.append(len(t.spark.read.schema(events.schema).parquet(landing).inputFiles()))
    most = max(b - a for a, b in zip(files, files[1:]))
    return I.stream_folder(t.spark, landing, events.schema, "parquet", files_per_trigger=max(1, most))


def _batches(t: Tables):
    """Three batches, each a third of the rows."""
    return _arriving(t, [F.col("event_id") % 3 == part for part in range(3)])


def _in_time(t: Tables):
    """Batches of ten days in the order of their days; rows without a time come last."""
    day = F.dayofmonth("ts")
    return _arriving(t, [day <= 10, (day > 10) & (day <= 20), (day > 20) | day.isNull()])


@query("stm_results", "SELECT sample_id, repeat_idx, success, error FROM v_results", ("v_results",))
def stm_results(t: Tables):
    rows = results_from_events(_events(t)).select("sample_id", "repeat_idx", "success", "error")
    out = shared_dir(t.spark, "stream-out")
    I.finish(I.append_stream(rows, out, shared_dir(t.spark, "stream-state")))
    return t.spark.read.schema(rows.schema).parquet(out)


_BUCKET = "CASE WHEN u < 32 THEN u ELSE (length(bin(u)) - 1 - 4) * 32 + ((u >> (length(bin(u)) - 1 - 5)) & 31) END"


@query("stm_running_summary", f""", b AS (SELECT *, {_BUCKET} bucket FROM (SELECT *, floor(latency_ms*1000)::BIGINT u FROM v_results)),
 q AS (SELECT *, row_number() OVER (PARTITION BY task_name, model_id, step_id ORDER BY latency_ms) rnk, count(*) OVER (PARTITION BY task_name, model_id, step_id) n FROM b),
 p AS (SELECT task_name, model_id, step_id, bucket, latency_ms exact FROM q WHERE rnk = ceil(0.95::DECIMAL(6,4)*n)),
 e AS (SELECT p.task_name, p.model_id, p.step_id, min(b.latency_ms) p95_low, max(b.latency_ms) p95_high, min(b.latency_ms) <= any_value(p.exact) AND any_value(p.exact) <= max(b.latency_ms) AS holds FROM p JOIN b USING (task_name, model_id, step_id, bucket) GROUP BY 1,2,3)
 SELECT task_name, model_id, step_id, count(*) request_count, count(*) FILTER (success) success_count, round(count(*) FILTER (success)/count(*)::DOUBLE,4) success_rate,
 round(sum(latency_ms::DECIMAL(38,10))::DOUBLE/count(*),2) avg_latency_ms, any_value(p95_low) p95_low, any_value(p95_high) p95_high, any_value(holds) p95_close, round(sum(total_tokens)::DOUBLE/count(*),2) avg_total_tokens, {_RATE} parse_rate, sum(retry_count)::BIGINT retry_count, 0.0::DOUBLE cost_estimate
 FROM v_results JOIN e USING (task_name, model_id, step_id) GROUP BY 1,2,3""", ("v_results",))
def stm_running_summary(t: Tables):
    """The state after three batches; the SQL takes p95's bucket from the exact p95."""
    out = shared_dir(t.spark, "stream-out")
    I.finish(I.write_complete(I.running_summary(results_from_events(_batches(t))), out, shared_dir(t.spark, "stream-state")))
    rates = I.summary_rates(I.read_newest(t.spark, out))
    return rates.withColumn("p95_close", F.col("p95_high") - F.col("p95_low") <= F.greatest(F.col("p95_high") / 32, F.lit(0.001)))


@query("stm_dedup", "SELECT DISTINCT sample_id, task_name, model_id FROM v_results", ("v_results",))
def stm_dedup(t: Tables):
    """One row of each sample, task and model from batches in time; a key is held for good, however late it comes again."""
    keys = ["sample_id", "task_name", "model_id"]
    rows = results_from_events(_in_time(t)).select(*keys)
    out = shared_dir(t.spark, "stream-out")
    I.finish(I.dedup_stream(rows, out, shared_dir(t.spark, "stream-state"), keys, delay=None))
    return t.spark.read.schema(rows.schema).parquet(out)


@query("stm_dedup_counts", """WITH d AS (SELECT (day(ts)-1)//10 batch, ts FROM events), s AS (SELECT max(ts) seen FROM d WHERE batch=0)
 SELECT (SELECT count(*) FROM d) + count(*) AS "rows", count(*) FILTER (ts <= date_trunc('millisecond', seen) - INTERVAL 2 DAY) late FROM d, s WHERE batch=0""")
def stm_dedup_counts(t: Tables):
    """The first ten days arrive once more after the second batch: what of them is behind the watermark, which the batch before started with, is late."""
    day = F.dayofmonth("ts")
    stream = _arriving(t, [day <= 10, (day > 10) & (day <= 20), day <= 10, day > 20])
    rows = results_from_events(stream).withColumn("day", F.to_date("ts")).select("sample_id", "task_name", "model_id", "day", "ts")
    run = I.dedup_stream(rows, shared_dir(t.spark, "stream-out"), shared_dir(t.spark, "stream-state"), ["sample_id", "task_name", "model_id", "day"], "ts", "2 days")
    I.finish(run)
    counts = I.stream_counts(run)
    return literal_rows(t.spark, [(counts["rows"], counts["late"])], "rows bigint, late bigint")


@query("stm_resume", "SELECT event_type, count(*) n FROM events GROUP BY 1")
def stm_resume(t: Tables):
    """Two runs over one checkpoint; the second finds files that came later and nothing twice."""
    landing, out, state = (shared_dir(t.spark, p) for p in ("landing", "stream-out", "stream-state"))
    events = t.table("events").select("event_id", "event_type")
    for part in (events.where("event_type = 'click'"), events.where("event_type <> 'click'")):
        part.write.mode("append").parquet(landing)
        rows = I.stream_folder(t.spark, landing, events.schema, "parquet")
        I.finish(I.append_stream(rows, out, state))
    return t.spark.read.schema(events.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm_progress", "SELECT event_type, max(event_id) FILTER (event_id%5<>0 AND event_id%7<>0) AS \"current\", count(*) FILTER (event_id%5<>0 AND event_id%7<>0) success, count(*) FILTER (event_id%5=0) fail FROM events GROUP BY 1")
def stm_progress(t: Tables):
    from scorelake.plans.queries_stats import _log_lines

    class Arriving(Tables):
        def table(self, name):
            return _batches(t)

    out = shared_dir(t.spark, "stream-out")
    lines = _log_lines(Arriving(t.spark, t.folder))
    I.finish(I.watch_progress(lines, ["event_type"], lambda df: df.write.mode("overwrite").parquet(out), shared_dir(t.spark, "stream-state")))
    return t.spark.read.parquet(out).select("event_type", "current", "success", "fail")


@query("stm_cache_fill", "SELECT sample_id||':'||task_name cache_key, count(DISTINCT event_id%3)>0 AS held, 1::BIGINT entries FROM v_results WHERE success GROUP BY 1", ("v_results",))
def stm_cache_fill(t: Tables):
    """Over three batches: one entry a key, and its content is that of one of the key's calls."""
    text = F.concat(F.col("sample_id"), F.lit("/"), F.col("event_id").cast("string"))
    calls = results_from_events(_batches(t)).select(F.concat_ws(":", "sample_id", "task_name").alias("cache_key"), text.alias("content"), "success")
    out = shared_dir(t.spark, "cache")
    I.finish(I.fill_cache(calls, out, shared_dir(t.spark, "stream-state")))
    made = t.results.where("success").select(F.concat_ws(":", "sample_id", "task_name").alias("cache_key"), text.alias("content"), F.lit(True).alias("held"))
    stored = t.spark.read.parquet(out).select("cache_key", "content").join(made, ["cache_key", "content"], "left")
    return stored.groupBy("cache_key").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held"), F.count("*").alias("entries"))
