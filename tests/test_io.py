"""Readers, writers, reports, plates and streams."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.operators import aggregates as A
from scorelake.operators.ranking import first_rows
from scorelake.plans import plates as PL
from scorelake.plans import reports as R
from scorelake.plans.adapters import Tables
from scorelake.schemas import NEWS_SAMPLE, RESULT_ROW
from scorelake.session import shared_dir
from scorelake.sources import readers as S
from scorelake.sources import writers as W
from scorelake.streaming import increments as I

RES = "sample_id string, task_name string, step_id string, model_id string, repeat_idx int, success boolean, parse_applicable boolean, parse_success boolean, latency_ms double, total_tokens int, retry_count int, cost_estimate double, error string, error_type string, error_stage string, output_text string, timestamp string, mode string, workflow_name string, workflow_version string"


def res(i, ok=True, mode="task", kind="", **kw):
    row = dict(sample_id=f"s{i}", task_name="t", step_id="__task__", model_id="m", repeat_idx=0, success=ok, parse_applicable=True, parse_success=ok, latency_ms=1.0,
               total_tokens=1, retry_count=0, cost_estimate=0.0, error="" if ok else "boom", error_type=kind, error_stage="", output_text="o" * 300, timestamp=f"2026-01-0{i}", mode=mode, workflow_name="w", workflow_version="v1")
    return tuple({**row, **kw}.values())


def test_samples_skip_blank_lines_and_reject_bad_ones(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"sample_id": "2", "news_items": []}\n\n{"sample_id": "1", "news_items": [{"title": "t"}]}\n')
    rows = S.read_samples(spark, str(good), NEWS_SAMPLE).collect()
    assert len(rows) == 2 and {len(r.news_items) for r in rows} == {0, 1}
    assert [r.sample_id for r in S.read_samples(spark, str(good), NEWS_SAMPLE, 1).collect()] == ["1"]
    assert S.read_samples(spark, str(good), NEWS_SAMPLE, 0).count() == 0
    with pytest.raises(ValueError):
        S.read_samples(spark, str(good), NEWS_SAMPLE, -1)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"sample_id": "1"}\n{broken\n')
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILFAST"):
        S.read_samples(spark, str(bad), NEWS_SAMPLE).collect()
    assert first_rows(spark.range(3), None, "id").count() == 3


def test_results_are_tolerant(spark, tmp_path):
    path = tmp_path / "results.jsonl"
    path.write_text('{"sample_id": "a", "repeat_idx": 1}\n{oops\n\n{"sample_id": "b"}\n')
    assert sorted(r.sample_id for r in S.read_results(spark, str(path)).collect()) == ["a", "b"]
    assert S.bad_line_count(spark, str(path)).first().bad_lines == 1
    none = S.read_results(spark, str(tmp_path / "absent"))
    assert none.count() == 0 and len(none.columns) == RESULT_ROW.count(", ") + 1 - RESULT_ROW.count("struct<name:string, ")


def test_model_file(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"active": "b", "models": {"a": {"provider": "p", "api_key": "${KEY}", "seed": 42, "price_config": {"input_per_1k": 0.1}}, "b": {}}}, indent=1))
    got = {r.model_id: r for r in S.read_models(spark, str(path)).collect()}
    assert got["a"].default_params == {"provider": "p", "api_key": "${KEY}", "seed": "42"} and got["a"].price_config.input_per_1k == 0.1
    assert (got["b"].provider, got["b"].is_active, got["a"].is_active, got["b"].price_config) == ("unknown", True, False, None)


def test_fingerprints(spark, tmp_path):
    import hashlib

    path = tmp_path / "d.jsonl"
    path.write_text("a\n\nb\n")
    assert S.file_fingerprints(spark, str(path)).first().sha256 == hashlib.sha256(b"a\n\nb\n").hexdigest()
    assert S.line_count(spark, str(path)).first().dataset_rows == 2
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, t string")
    one = S.content_fingerprint(df, ["i", "t"]).first()
    assert S.content_fingerprint(df.repartition(3).orderBy(F.desc("i")), ["i", "t"]).first() == one
    assert S.content_fingerprint(df.where("i < 3"), ["i", "t"]).first() != one


def test_summary_union_and_empty(spark):
    base = shared_dir(spark, "t")
    row = spark.createDataFrame([("t", "m", "s", 1)], "task_name string, model_id string, step_id string, n int")
    more = row.withColumn("step_id", F.lit("z")).withColumn("tm_x_avg", F.lit(0.5))
    assert W.write_summary([row, more], f"{base}/one")
    got = {r.step_id: r for r in S.read_summary_csv(spark, f"{base}/one").collect()}
    assert (got["s"].tm_x_avg, got["z"].tm_x_avg) == (None, "0.5")
    assert not W.write_summary([row.where("n > 1")], f"{base}/two") and not S.path_exists(spark, f"{base}/two")


def test_appends_do_not_lose_rows(spark):
    path = shared_dir(spark, "append")
    for i in range(4):
        W.append_results(spark.range(i * 50, i * 50 + 50).select(F.col("id").cast("string").alias("sample_id")), path)
    assert S.read_results(spark, path).select("sample_id").distinct().count() == 200


def test_optional_key_is_left_out(spark):
    path = shared_dir(spark, "jsonl")
    W.write_samples(spark.createDataFrame([("a", None), ("b", "x")], "sample_id string, plate_intro string"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ['{"sample_id":"a"}', '{"sample_id":"b","plate_intro":"x"}']


def test_upsert_rewrites_only_touched_buckets(spark):
    path = shared_dir(spark, "upsert")
    old = spark.range(200).select("id", F.lit("old").alias("v"))
    W.upsert(spark, path, old, "id", buckets=8)
    before = set(spark.read.parquet(path).inputFiles())
    W.upsert(spark, path, spark.createDataFrame([(7, "new")], "id long, v string"), "id", buckets=8)
    after = set(spark.read.parquet(path).inputFiles())
    assert len(before & after) >= 6
    got = W.read_upserted(spark, path, "id")
    assert got.count() == 200 and [r.v for r in got.where("id = 7").collect()] == ["new"]
    W.upsert(spark, path, spark.createDataFrame([], "id long, v string"), "id", changed=spark.range(200), buckets=8)
    assert W.read_upserted(spark, path, "id").count() == 0
    assert W.replace_by_key(old, spark.createDataFrame([(1, "n"), (1, "m")], "id long, v string"), "id").count() == 201


def lines(spark, df):
    return [r.line for r in R.report_lines(df, A.summarize(df)).orderBy("pos").collect()]


def test_report_sections(spark):
    rows = [res(1), res(2, False), res(3, False, kind="timeout"), res(4, True, "workflow_step"), res(5, True, "workflow_e2e", model_id="m+m")]
    got = lines(spark, spark.createDataFrame(rows, RES))
    assert got[0] == "# Evaluation report" and "### t" in got
    assert "| t | m | 4 | 0.5 | 0.5 | 1.0 | 1.0 | 0.0 |" in got
    assert "| unknown_error | 1 |" in got and "| timeout | 1 |" in got
    assert "| w | v1 | workflow_e2e | m+m | 1 | 1.0 | 1.0 | 1.0 | 0.0 |" in got
    assert [x for x in got if x.startswith("- sample_id")] == ["- sample_id: `s2`", "- sample_id: `s3`"]
    assert next(x for x in got if x.startswith("- output")) == "- output_excerpt: `" + "o" * 180 + "`"
    assert "No error cases found." not in got
    assert got.index("### t") < got.index("## 按 Workflow 维度概览") < got.index("### 失败类型分布")


def test_report_without_rows(spark):
    got = lines(spark, spark.createDataFrame([], RES))
    assert got[-1] == "No error cases found."


PLATE = "id long, name string, desc string"


def test_association_thresholds(spark):
    plates = spark.createDataFrame([(1, "four", "long enough text"), (2, "five", " long enough text "), (3, "fifty", "long enough text"), (4, "more", "long enough text"),
                                    (5, "short", "123456789"), (6, "none", None)], PLATE)
    sizes = {1: 4, 2: 5, 3: 50, 4: 51, 5: 9, 6: 9}
    stocks = spark.createDataFrame([(p, f"{i:06d}", 100) for p, n in sizes.items() for i in range(n)] + [(2, "999999", 1)], "plate_id long, symbol string, core_flag int")
    chains = spark.createDataFrame([(2, 1, "late", 9), (2, 2, "early", 1)], "plate_id long, chain_id long, name string, `order` long")
    answers = spark.createDataFrame([(2, "板块介绍", "<p>a&nbsp;b</p> " + "x" * 600), (3, "板块介绍", "<br>"), (2, "other", "no")], "plate_id long, question string, html_answer string")
    got = {r.sample_id: r for r in PL.association_set(plates, stocks, chains, answers).collect()}
    assert set(got) == {"SA_2", "SA_3"}
    two = got["SA_2"]
    assert (two.plate_desc, two.chains, two.core_stocks_count, two.gt_stocks[0]) == ("long enough text", ["early", "late"], 5, "000000")
    assert two.plate_intro.startswith("ab x") and len(two.plate_intro) == 500
    assert (got["SA_3"].plate_intro, got["SA_3"].chains) == (None, [])
    assert PL.skipped_plates(plates, stocks).first().skipped == 2


def test_news_conversion(spark):
    ddl = "news_id long, trade_date string, ticker string, sec_short_name string, exchange_cd string, news_publish_time string, news_title string, news_body string, news_summary string, sentiment int, sentiment_score double"
    row = lambda i, body, summary, s, score: (i, None, "T", None, None, None, None, body, summary, s, score)
    df = spark.createDataFrame([row(1, "b", "s", None, None), row(2, "b", "s", 5, 0.12345678), row(3, "", "s", 1, 1.0), row(4, "b", None, 1, 1.0), row(5, "b", "s", -1, 1.0)], ddl)
    got = [(r.sample_id, r.gt_sentiment, r.gt_sentiment_score, r.trade_date) for r in PL.news_set(df).orderBy("sample_id").collect()]
    assert got == [("1", "neutral", 0.0, ""), ("2", "neutral", 0.123457, ""), ("5", "negative", 1.0, "")]


def test_cache_fill_keeps_one_row_per_key(spark):
    landing, cache, state = (shared_dir(spark, p) for p in ("l", "c", "s"))
    ddl = "cache_key string, content string, success boolean"
    for rows in ([("a", "1", True), ("b", "x", False)], [("a", "2", True), ("c", "3", True)]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(landing)
        I.finish(I.fill_cache(I.stream_folder(spark, landing, ddl), cache, state))
    assert sorted((r.cache_key, r.content) for r in spark.read.parquet(cache).collect()) == [("a", "1"), ("c", "3")]


def test_payloads_are_parsed_in_many_tasks_and_picked_in_one_pass(spark, tmp_path):
    """Parts in one row group: their payloads are landed as several files, and the newest are picked without a join of payloads."""
    parts = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(i if i else None, f"n{i}", "b", "t", i % 7, 1.0) for i in range(400)], parts).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    payloads = Tables(spark, str(tmp_path)).payloads
    assert len(payloads.inputFiles()) > 1 and payloads.count() == 400
    both = payloads.withColumn("landed", F.lit(1)).unionByName(payloads.withColumns({"landed": F.lit(2), "data": F.col("data").withField("name", F.lit("new"))}))
    newest = S.newest_payloads(both.unionByName(both.where("landed = 1")), "landed")
    plan = newest._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    got = newest.select("data.id", "data.name", "landed").collect()
    assert sorted(r.id for r in got) == [i for i in range(400) if i % 10] and {(r.name, r.landed) for r in got} == {("new", 2)}
