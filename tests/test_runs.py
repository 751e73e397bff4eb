"""Grid, resume, cache, task runs and workflow runs on small fixtures."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scorelake.operators import checks as K
from scorelake.operators import grid as G
from scorelake.operators import projections as P
from scorelake.plans import runs as RUN
from scorelake.schemas import RESULT_ROW
from scorelake.spec import TASKS, TaskSpec, WorkflowSpec, WorkflowStep

CALL = "content string, prompt_tokens int, completion_tokens int, latency_ms double, success boolean, error string, retry_count int, error_type string, error_stage string, error_code string"
MODELS = [("m1", "p", {"seed": "1", "api_key": "k"}, (0.001, 0.002)), ("m2", "p", {}, None), ("m3", "p", {}, (0.001, 0.002))]


@pytest.fixture(scope="module")
def models(spark):
    return G.literal_models(spark, MODELS)


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(
        [(s, "AAPL", [(f"title {s}", "x")]) for s in ("a", "b", "c")], "sample_id string, ticker string, news_items array<struct<title:string,content:string>>")


def call(content, ok=True, error="", latency=12.345, kind=("", "", "")):
    return (content, 10, 20, latency, ok, error, 1, *kind)


IE = TASKS["ie_json"]
GOOD = json.dumps({"ticker": "AAPL", "event_type": "product", "sentiment": "positive", "impact_score": 9, "summary": "s"})


def test_grid_has_no_join_and_right_size(samples):
    grid = G.work_grid(samples, "ie_json", ["m1", "m2"], 3)
    assert grid.count() == 18
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        G.work_grid(samples, "t", [], 1)


def test_task_run(spark, samples, models):
    calls = spark.createDataFrame([
        ("a", "m1", 0, *call(GOOD)), ("b", "m1", 0, *call("no json")), ("c", "m1", 0, *call("", False, "gateway_error: timeout")),
        ("a", "m2", 0, *call(GOOD)),
    ], f"sample_id string, model_id string, repeat_idx int, {CALL}")
    out = RUN.task_run(samples, models, calls, IE, ["m1", "m2"], run_id="r", params={"temperature": "0"})
    assert out.columns == [f.split(" ")[0] for f in RESULT_ROW.replace("struct<name:string,value:double>", "x").split(", ")]
    rows = {(r.sample_id, r.model_id): r for r in out.collect()}
    assert len(rows) == 6
    a = rows["a", "m1"]
    assert (a.success, a.parse_success, a.error_type, a.latency_ms, a.total_tokens, a.cost_estimate) == (True, True, "", 12.35, 30, 0.00005)
    assert json.loads(a.parsed)["impact_score"] == 5 and a.params == {"temperature": "0"}
    assert [(m.name, m.value) for m in a.task_metrics] == [("field_completeness", 1.0)]
    assert (rows["b", "m1"].success, rows["b", "m1"].error_type) == (True, "schema_mismatch")
    c = rows["c", "m1"]
    assert (c.success, c.error_type, c.error_code, c.error_detail) == (False, "timeout", "gateway_timeout", "gateway_error: timeout")
    assert [m.value for m in c.task_metrics] == [0.0]
    assert rows["a", "m2"].cost_estimate == 0.0
    lost = rows["b", "m2"]
    assert (lost.success, lost.error_type, lost.total_tokens, lost.task_metrics) == (False, "gateway_failure", 0, [])


def test_resume_skips_done_work(spark, samples, models):
    calls = spark.createDataFrame([("a", "m1", 0, *call(GOOD))], f"sample_id string, model_id string, repeat_idx int, {CALL}")
    first = RUN.task_run(samples, models, calls, IE, ["m1"])
    done = G.completed_keys(first.where("sample_id <> 'b'"))
    rest = RUN.task_run(samples, models, calls, IE, ["m1", "m2"], done=done)
    assert sorted((r.sample_id, r.model_id) for r in rest.collect()) == [("a", "m2"), ("b", "m1"), ("b", "m2"), ("c", "m2")]
    assert [r.sample_id for r in G.unfinished_samples(samples, done, "ie_json", ["m1"], 1).collect()] == ["b"]
    assert G.completed_keys(first, retry_failed=True).count() == 1


def test_completed_keys_default_bad_repeats(spark):
    rows = spark.createDataFrame([("a", "t", "s", "m", "x"), ("a", "t", "s", "m", None), ("a", "t", "s", "m", "2")], "sample_id string, task_name string, step_id string, model_id string, repeat_idx string")
    assert sorted(r.repeat_idx for r in G.completed_keys(rows).collect()) == [0, 2]


def test_cache_hits_cost_nothing(spark, samples, models):
    none = spark.createDataFrame([], f"sample_id string, model_id string, repeat_idx int, {CALL}")
    requests = RUN.pending_requests(samples, models, IE, ["m1"])
    keys = {r.sample_id: r.cache_key for r in requests.collect()}
    assert len(set(keys.values())) == 3
    cache = spark.createDataFrame([(keys["a"], *call(GOOD)), (keys["b"], *call(None))], f"cache_key string, {CALL}")
    rows = {r.sample_id: r for r in RUN.task_run(samples, models, none, IE, ["m1"], cache=cache).collect()}
    assert (rows["a"].from_cache, rows["a"].success, rows["a"].cost_estimate) == (True, True, 0.0)
    assert (rows["b"].from_cache, rows["b"].success) == (False, False)
    assert K.cache_cost_violations(spark.createDataFrame(rows.values(), RESULT_ROW)).count() == 0
    changed = RUN.pending_requests(samples, models, IE, ["m1"], params={"seed": "2"})
    assert not set(keys.values()) & {r.cache_key for r in changed.collect()}


def test_cached_row_with_cost_fails(spark):
    df = spark.createDataFrame([("s", True, 0.001)], "sample_id string, from_cache boolean, cost_estimate double")
    assert K.cache_cost_violations(df).count() == 1
    with pytest.raises(PySparkException):
        K.enforce_cache_cost(df).collect()
    assert K.enforce_cache_cost(df.withColumn("from_cache", F.lit(False))).count() == 1


def test_unknown_model_and_missing_label_fail(spark, models):
    rows = spark.createDataFrame([("x",)], "model_id string")
    with pytest.raises(PySparkException):
        G.with_price(rows, models).collect()
    assert G.flag_unknown_models(rows, models).count() == 1
    with pytest.raises(PySparkException):
        G.join_truth(spark.createDataFrame([("s",)], "sample_id string"), spark.createDataFrame([("t", 1)], "sample_id string, y int")).collect()


def test_active_model(spark):
    df = spark.createDataFrame([("$active", None), ("m2", None), ("m2", "m9")], "d string, o string")
    assert [r[0] for r in df.select(P.active_model(F.col("d"), "m1", F.col("o"))).collect()] == ["m1", "m2", "m9"]
    with pytest.raises(PySparkException):
        df.select(P.active_model(F.col("d"), "")).collect()


def test_requests_take_step_input_first(spark, samples):
    rows = samples.withColumn("step", F.struct(F.array(F.lit("kept")).alias("news_items")))
    text = P.build_requests(rows, IE, step_input="step").first().messages[-1].content
    assert '["kept"]' in text and "AAPL" in text
    plain = P.build_requests(samples, IE).orderBy("sample_id").first()
    assert '[{"title":"title a","content":"x"}]' in plain.messages[-1].content and plain.prompt_version == "ie_json.scorelake1"
    assert "[]" in P.build_requests(samples.drop("news_items"), IE).first().messages[-1].content


FLOW = WorkflowSpec("flow", "v1", (
    WorkflowStep("s1", "news_dedup", "m1", "sample", {"temperature": "0.1"}), WorkflowStep("s2", "ie_json", "m2", "s1"), WorkflowStep("s3", "stock_score", "m3", "s2")))
BY_STEP = {"s1": "m1", "s2": "m2", "s3": "m3"}
OUT = {"s1": '{"deduped_titles": ["t"], "removed_count": 1}', "s2": GOOD, "s3": '{"score": -40, "rationale": "r"}'}


def flow(spark, samples, models, change=None, cached=False, spec=FLOW, tasks=TASKS, **kw):
    rows = []
    for s in ("a", "b"):
        for step, text in OUT.items():
            content = (change or {}).get((s, step), call(text))
            if content is not None:
                rows.append((s, step, *content, cached))
    calls = spark.createDataFrame(rows, f"sample_id string, step_id string, {CALL}, from_cache boolean")
    dear = G.literal_models(spark, [(m, "p", {}, (0.001, 0.002)) for m in ("m1", "m2", "m3")])
    out = RUN.workflow_run(samples.where("sample_id <> 'c'"), dear, calls, spec, BY_STEP, tasks, params={"seed": "7"}, **kw)
    return {(r.sample_id, r.step_id): r for r in out.collect()}


def test_workflow_all_good(spark, samples, models):
    got = flow(spark, samples, models)
    assert len(got) == 8
    e = got["a", "__e2e__"]
    assert (e.success, e.parse_success, e.error_type, e.model_id, e.total_tokens, e.prompt_tokens, e.retry_count, e.mode) == (True, True, "", "m1+m2+m3", 90, 0, 3, "workflow_e2e")
    assert e.cost_estimate == pytest.approx(0.00015) and e.latency_ms == pytest.approx(37.03, abs=0.01) and json.loads(e.parsed)["score"] == -40
    assert {m.name: m.value for m in got["a", "s3"].task_metrics} == {"field_completeness": 1.0, "score_abs_normalized": 0.4}
    assert {m.name: m.value for m in got["a", "s1"].task_metrics} == {"dedup_ratio": 1.0}
    assert got["a", "s1"].params == {"seed": "7", "temperature": "0.1"} and got["a", "s2"].workflow_name == "flow"


def test_workflow_first_step_unparsable(spark, samples, models):
    got = flow(spark, samples, models, {("a", "s1"): call("nothing")})
    assert (got["a", "s1"].success, got["a", "s1"].parse_success, got["a", "s1"].error_type) == (True, False, "schema_mismatch")
    for step, source in (("s2", "s1"), ("s3", "s2")):
        r = got["a", step]
        assert (r.success, r.error_type, r.task_version, r.total_tokens) == (False, "upstream_parse_failed", "skipped", 0)
        assert r.error == f"upstream_parse_failed: upstream_{source}_parse_failed"
    e = got["a", "__e2e__"]
    assert (e.success, e.parsed, e.error, e.error_type, e.total_tokens) == (False, None, "workflow_step_failed", "unknown_error", 30)
    assert got["b", "__e2e__"].success is True


def test_workflow_last_step_unparsable(spark, samples, models):
    e = flow(spark, samples, models, {("a", "s3"): call("{")})["a", "__e2e__"]
    assert (e.success, e.parse_success, e.parsed, e.parse_applicable) == (False, False, None, True)


def test_workflow_lost_call_blocks_readers(spark, samples, models):
    got = flow(spark, samples, models, {("a", "s2"): None})
    assert got["a", "s2"].error_type == "gateway_failure" and got["a", "s3"].error_type == "upstream_parse_failed"
    assert got["a", "__e2e__"].total_tokens == 30


def test_workflow_cached_costs_nothing(spark, samples, models):
    assert {r.cost_estimate for r in flow(spark, samples, models, cached=True).values()} == {0.0}


def test_workflow_skipped_step_without_parsing_and_later_input(spark, samples, models):
    tasks = {**TASKS, "plain": TaskSpec.from_dict({"name": "plain", "user": "x"})}
    spec = WorkflowSpec("flow", "v1", (WorkflowStep("s1", "news_dedup"), WorkflowStep("s2", "plain", input_from="s1"), WorkflowStep("s3", "stock_score", input_from="s4"),))
    got = flow(spark, samples, models, {("a", "s1"): call("x")}, spec=spec, tasks=tasks)
    assert got["a", "s2"].parse_applicable is False
    assert got["b", "s3"].error == "upstream_missing: upstream_s4_missing"
    assert (got["b", "__e2e__"].success, got["b", "__e2e__"].parse_applicable) == (False, False)


def test_workflow_resume(spark, samples, models):
    done = spark.createDataFrame([("a", "flow", "__e2e__")], "sample_id string, task_name string, step_id string")
    assert {k[0] for k in flow(spark, samples, models, done=done)} == {"b"}


def test_newest_rows(spark):
    rows = [("a", "t", "s", "m", 0, "2026-01-01", 1), ("a", "t", "s", "m", 0, "2026-01-02", 2), ("b", "t", "s", "m", 0, "2026-01-01", 3)]
    df = spark.createDataFrame(rows, "sample_id string, task_name string, step_id string, model_id string, repeat_idx int, timestamp string, v int")
    assert sorted(r.v for r in G.newest_rows(df).collect()) == [2, 3]
