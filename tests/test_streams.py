"""Keyed state with a watermark, and the mergeable sketch of the running summary."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from scorelake.operators.order_stats import sketch_bucket
from scorelake.session import shared_dir
from scorelake.streaming import increments as I

ROW = "sample_id string, ts timestamp"
HOUR = 3600


def land(spark, folder, rows):
    df = spark.createDataFrame([(k, 1_700_000_000 + t) for k, t in rows], "sample_id string, s long")
    df.select("sample_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").json(folder)


def run(spark, folder, out, state, delay="2 hours"):
    query = I.dedup_stream(I.stream_folder(spark, folder, ROW), out, state, ["sample_id"], "ts", delay)
    I.finish(query)
    return I.stream_counts(query)


def kept(spark, out):
    return sorted(r.sample_id for r in spark.read.schema(ROW).parquet(out).collect())


def test_dedup_over_restarts_with_late_rows(spark):
    landing, out, state = (shared_dir(spark, p) for p in ("l", "o", "s"))
    land(spark, landing, [("a", 0), ("b", HOUR), ("a", HOUR)])
    assert run(spark, landing, out, state)["late"] == 0 and kept(spark, out) == ["a", "b"]
    # A new run of the same query: what it knows comes from the state, not from the stored rows.
    land(spark, landing, [("b", 2 * HOUR), ("c", 2 * HOUR), ("c", 2 * HOUR)])
    run(spark, landing, out, state)
    assert kept(spark, out) == ["a", "b", "c"]
    land(spark, landing, [("d", 40 * HOUR)])
    run(spark, landing, out, state)
    land(spark, landing, [("a", 0), ("e", HOUR), ("f", 41 * HOUR)])
    counts = run(spark, landing, out, state)
    assert kept(spark, out) == ["a", "b", "c", "d", "f"] and counts["late"] == 2


def test_keys_without_a_delay_are_held_for_good(spark):
    landing, out, state = (shared_dir(spark, p) for p in ("l", "o", "s"))
    for rows in ([("a", 0), ("b", HOUR)], [("c", 4000 * HOUR), (None, 0)], [("a", 9000 * HOUR), ("d", -HOUR), (None, 1)], [("b", 9001 * HOUR)]):
        land(spark, landing, rows)
        counts = run(spark, landing, out, state, None)
    got = [r.sample_id for r in spark.read.schema(ROW).parquet(out).collect()]
    assert sorted(got, key=str) == [None, "a", "b", "c", "d"] and counts["late"] == 0 and counts["keys"] == 5


def test_stm_dedup_over_all_days(spark, tmp_path):
    """A key comes once, however many days it has, and rows without a time or an id count too."""
    rows = [(1, 0, 7, "a"), (5, 20 * 24 * HOUR, 7, "a"), (9, None, 7, "a"), (2, None, 8, "b"), (None, HOUR, 9, "c"), (13, 27 * 24 * HOUR, 7, "a")]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string")
    events.select("event_id", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), "user_id", "event_type", F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["stm_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("7", "a", "m1"), ("8", "b", "m2"), ("9", "c", None)]


def test_state_is_bounded_by_the_watermark(spark):
    landing, out, state = (shared_dir(spark, p) for p in ("l", "o", "s"))
    most = []
    for batch in range(6):
        land(spark, landing, [(f"{batch}-{k % 50}", (batch * 10 + k // 50) * HOUR) for k in range(100)])
        counts = run(spark, landing, out, state, "1 hour")
        most.append(counts["keys"])
    assert len(kept(spark, out)) == 300 and max(most) <= 50
    # A key that was forgotten is new again once its time is ahead of the watermark.
    land(spark, landing, [("0-1", 100 * HOUR)])
    run(spark, landing, out, state, "1 hour")
    assert kept(spark, out).count("0-1") == 2


RESULT = "task_name string, model_id string, step_id string, success boolean, parse_applicable boolean, parse_success boolean, latency_ms double, total_tokens int, retry_count int, cost_estimate double"


def results(n, seed):
    rng = random.Random(seed)
    latency = lambda: rng.choice([None, 0.0, rng.random() / 50, rng.lognormvariate(3, 3), -rng.random() * 9, float("inf"), float("nan"), 250.0])
    return [(rng.choice("ab"), "m", "s", rng.random() < 0.8, True, rng.random() < 0.5, latency(), rng.randrange(99), 1, rng.random()) for _ in range(n)]


def test_state_merges_over_any_split(spark):
    rows = results(600, 1)
    state = lambda part: I.running_summary(spark.createDataFrame(part, RESULT))
    order = ["task_name", "bucket"]
    whole = state(rows).orderBy(*order).collect()
    for seed in range(3):
        rng = random.Random(seed)
        cuts = sorted(rng.sample(range(1, 600), 3))
        shuffled = rng.sample(rows, len(rows))
        parts = [state(shuffled[a:b]) for a, b in zip([0, *cuts], [*cuts, 600])]
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        assert I.merged_summaries(union).orderBy(*order).select(*state(rows).columns).collect() == whole


def test_p95_stands_in_its_bucket(spark):
    rows = results(3000, 2)
    got = {r.task_name: r for r in I.summary_rates(I.running_summary(spark.createDataFrame(rows, RESULT))).collect()}
    for task in "ab":
        # A missing latency counts as 0, as in the batch summary; one that is no finite number does not count.
        values = sorted(r[6] or 0.0 for r in rows if r[0] == task and math.isfinite(r[6] or 0.0))
        exact = values[math.ceil(0.95 * len(values)) - 1]
        low, high = got[task].p95_low, got[task].p95_high
        assert low <= exact <= high and high - low <= max(high / 32, 0.001)
    none = I.summary_rates(I.running_summary(spark.createDataFrame([("t", "m", "s", True, True, True, float("nan"), 1, 0, 0.0)], RESULT))).first()
    assert none.p95_low is None and none.avg_latency_ms == 0.0 and none.request_count == 1


def test_buckets_grow_with_the_value(spark):
    rng = random.Random(3)
    values = sorted([0.0, 0.031, 0.032, 0.0639, 0.064, 1e15, -1e15, -0.5, *[rng.lognormvariate(0, 9) for _ in range(300)], *[-rng.lognormvariate(0, 5) for _ in range(100)]])
    got = [r.b for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(sketch_bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)
    for bucket in set(got):
        own = [abs(v) for v, b in zip(values, got) if b == bucket]
        assert max(own) - min(own) <= max(max(own) / 32, 0.001)
