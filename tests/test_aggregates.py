"""Roll-ups and exact order statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import aggregates as A
from scorelake.operators import order_stats as S
from scorelake.operators import ranking as R
from scorelake.operators import workflow as W

ROW = "task_name string, model_id string, step_id string, success boolean, parse_applicable boolean, parse_success boolean, latency_ms double, total_tokens int, retry_count int, cost_estimate double, task_metrics array<struct<name:string,value:double>>"


def test_summary_of_two_rows(make):
    rows = [("t", "m1", None, True, True, True, 100.0, 40, 1, 0.01, [("a", 1.0), ("b", None)]), ("t", "m1", None, False, None, False, 200.0, 60, 2, 0.02, [("a", 0.0)])]
    got = A.summarize(make(rows, ROW)).first().asDict()
    assert got == {
        "schema_version": "summary_row.v1", "task_name": "t", "model_id": "m1", "step_id": "__task__", "request_count": 2, "success_count": 1,
        "success_rate": 0.5, "avg_latency_ms": 150.0, "p95_latency_ms": 200.0, "avg_total_tokens": 50.0, "p95_total_tokens": 60.0,
        "parse_rate": 0.5, "retry_count": 3, "cost_estimate": 0.03,
    }
    long = {r.metric: r.avg_value for r in A.task_metric_averages(make(rows, ROW)).collect()}
    assert long == {"a": 0.5, "b": None}
    wide = A.wide_metrics(A.task_metric_averages(make(rows, ROW)), ["a", "b"]).first()
    assert (wide.tm_a_avg, wide.tm_b_avg) == (0.5, None)


def test_parse_rate_is_zero_without_applicable_rows(make):
    rows = [("t", "m", "s", True, False, False, 1.0, 1, 0, 0.0, [])]
    assert A.summarize(make(rows, ROW)).first().parse_rate == 0.0


def test_results_do_not_hang_on_row_order(make):
    rng = random.Random(3)
    rows = [("t", f"m{i % 3}", "s", i % 4 > 0, True, i % 5 > 0, rng.random() * 1e4, rng.randrange(999), 0, rng.random() / 7, []) for i in range(2000)]
    one = A.sort_summary(A.summarize(make(rows, ROW).repartition(1))).collect()
    rng.shuffle(rows)
    assert A.sort_summary(A.summarize(make(rows, ROW).repartition(7))).collect() == one


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics_match_sorting(spark, seed):
    """Skewed groups (one key holds most rows, one value most of those), negatives, ties and tiny groups."""
    rng = random.Random(seed)
    data = {"hot": [rng.choice([0.0, 0.0, 5.5, rng.uniform(-1e6, 1e6), rng.random()]) for _ in range(3000)]}
    data |= {f"k{n}": [round(rng.uniform(-3, 3), 1) for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 100)}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    x = F.col("v")
    got = {r.k: r for r in S.values_at_ranks(df, ["k"], {
        "p95": (x, S.nearest_rank("0.95")), "p99": (x, S.floor_rank("0.99")), "mid": (x, S.upper_median), "lo": (-x, S.nearest_rank("0.95")),
    }).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        s, n = sorted(vs), len(vs)
        assert got[k].p95 == s[min(n - 1, max(0, math.ceil(n * 95 / 100) - 1))]
        assert got[k].p99 == s[min(int(n * 0.99), n - 1)]
        assert got[k].mid == s[n // 2]
        assert got[k].lo == sorted(-v for v in vs)[math.ceil(n * 95 / 100) - 1]


def test_nearest_rank_for_every_small_n(spark):
    ranks = spark.range(1, 1501).select("id", S.nearest_rank("0.95")(F.col("id")).alias("r")).collect()
    assert all(r.r == -(-r.id * 95 // 100) for r in ranks)


def test_percentiles_and_medians(spark):
    values = [3.0, 1.0, 2.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)], "k string, v double")
    got = {r.k: (r.q, r.h) for r in S.percentiles(df, ["k"], F.col("v"), {"q": "0.25", "h": "0.5"}).collect()}
    assert got == {"a": (1.75, 2.5), "b": (7.0, 7.0)}
    assert S.medians(df, [], {"m": F.col("v")}).first().m == 3.0


def test_minmax_constant_and_null(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 3.0)], "id int, a double, b double")
    out = R.min_max_scale(df, {"sa": "a", "sb": "b"}).orderBy("id").collect()
    assert [(r.sa, r.sb) for r in out] == [(0.0, 0.0), (0.0, None), (0.0, 1.0)]


def test_minmax_plan_has_no_join_and_no_global_window(spark):
    plan = R.min_max_scale(spark.range(9), {"s": "id"})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert [r.n for r in A.histogram(df, "x", 2).orderBy("bin").collect()] == [1, 2]
    assert sum(r.n for r in A.histogram(df.where("x = 1"), "x", 4).collect()) == 1


def test_first_names_cuts_before_gathering(spark):
    df = spark.createDataFrame([("s", f"n{i % 9}") for i in range(900)] + [("t", None)], "s string, n string")
    out = R.first_names(df, "s", "n", 5, "names")
    assert [tuple(r) for r in out.collect()] == [("s", "n0, n1, n2, n3, n4")]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_end_to_end_rules(make):
    ddl = "sample_id string, ord int, executed boolean, success boolean, parse_applicable boolean, parse_success boolean, parsed string, latency_ms double, total_tokens int, retry_count int, cost_estimate double"
    rows = [
        ("good", 0, True, True, True, True, "a", 1.0, 10, 0, 0.1), ("good", 1, True, True, True, True, "b", 2.0, 20, 1, 0.2),
        ("skip", 0, True, True, False, False, None, 1.0, 10, 0, 0.1), ("skip", 1, False, False, True, False, None, 9.0, 99, 9, 9.9),
        ("noparse", 0, True, True, True, True, "a", 1.0, 1, 0, 0.0), ("noparse", 1, True, True, False, False, None, 1.0, 1, 0, 0.0),
    ]
    got = {r.sample_id: r for r in W.end_to_end(make(rows, ddl), ["sample_id"]).collect()}
    assert (got["good"].success, got["good"].parsed, got["good"].latency_ms, got["good"].total_tokens, got["good"].retry_count) == (True, "b", 3.0, 30, 1)
    s = got["skip"]
    assert (s.success, s.parsed, s.parse_applicable, s.parse_success, s.total_tokens, s.error) == (False, None, False, False, 10, "workflow_step_failed")
    n = got["noparse"]
    assert (n.success, n.parse_applicable, n.parse_success) == (True, False, False)


def test_progress(make):
    lines = ["noise", "[1/4] A(id=9) 成分股=3", "[2/4] 失败 id=3: x", "[3/4] B c(id=2) 成分股=7", "tail"]
    df = make([("log", i, t) for i, t in enumerate(lines)], "log string, line_no int, line string")
    row = R.with_eta(R.last_progress(df, ["log"]), F.lit(90.0)).first()
    assert (row.current, row.total, row.latest_plate, row.stock_count, row.success, row.fail, row.percent, row.eta) == (3, 4, "B c", 7, 2, 1, 75.0, "0m 30s")
    empty = R.with_eta(R.last_progress(df.where("line_no = 0"), ["log"]), F.lit(90.0)).first()
    assert (empty.current, empty.total, empty.eta) == (0, 589, "计算中...")


def test_close_values_are_spread_over_parts(spark):
    """100,000 distinct values near 1.7e9 are cut into many parts before any of them is put in order."""
    from scorelake.operators.order_stats import nearest_rank, values_at_ranks

    df = spark.range(100_000).select(F.lit("k").alias("k"), (F.lit(1.7e9) + F.col("id") / 1000).alias("v"))
    out = values_at_ranks(df, ["k"], {"p": (F.col("v"), nearest_rank("0.95"))})
    assert out.first().p == 1.7e9 + 94_999 / 1000
    ends = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    parts = df.groupBy(S._part(F.col("v"), F.lit(ends.lo), F.lit(ends.hi)).alias("p")).count()
    assert parts.count() == 4096 and parts.agg(F.max("count")).first()[0] <= 30


def test_means_leave_out_what_is_not_finite(spark):
    from scorelake.operators.aggregates import exact_mean, finite_mean, not_finite

    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    row = df.agg(finite_mean(F.col("x"), 4).alias("m"), exact_mean(F.col("x")).alias("e"), not_finite(F.col("x")).alias("n")).first()
    assert (row.m, row.e, row.n) == (1.5, 1.5, 2)
