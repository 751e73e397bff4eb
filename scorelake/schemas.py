"""Fixed schemas of the tables the engine reads and writes, as DDL text."""

from __future__ import annotations

from pyspark.sql import types as T

RESULT_SCHEMA_VERSION = "result_row.v1"
SUMMARY_SCHEMA_VERSION = "summary_row.v1"
SCORER_VERSION = "v1"
STEP_TASK = "__task__"
STEP_E2E = "__e2e__"

RESUME_KEYS = ["sample_id", "task_name", "step_id", "model_id", "repeat_idx"]
SUMMARY_KEYS = ["task_name", "model_id", "step_id"]

def as_struct(schema: str | T.StructType) -> T.StructType:
    """A DDL text as a StructType; it is parsed by the running session."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


NEWS_SAMPLE = (
    "sample_id string, ticker string, cutoff_time string, "
    "news_items array<struct<title:string,content:string,publish_time:string,source:string>>"
)
SUMMARY_SAMPLE = (
    "sample_id string, ticker string, sec_short_name string, exchange_cd string, trade_date string, "
    "news_publish_time string, news_title string, news_body string, gt_summary string, "
    "gt_sentiment string, gt_sentiment_score double"
)
ASSOCIATION_SAMPLE = (
    "sample_id string, plate_name string, plate_desc string, chains array<string>, "
    "core_stocks_count int, gt_stocks array<string>, plate_intro string"
)
METRIC_LIST = "array<struct<name:string,value:double>>"
RESULT_ROW = (
    "schema_version string, run_id string, timestamp string, mode string, sample_id string, "
    "task_name string, task_version string, step_id string, prompt_version string, model_id string, "
    "params map<string,string>, repeat_idx int, success boolean, error string, error_type string, "
    "error_stage string, error_code string, error_detail string, parse_applicable boolean, "
    "parse_success boolean, latency_ms double, prompt_tokens int, completion_tokens int, "
    "total_tokens int, retry_count int, cost_estimate double, from_cache boolean, "
    f"output_text string, parsed string, task_metrics {METRIC_LIST}, "
    "workflow_name string, workflow_version string"
)
CALL_ROW = (
    "content string, usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, "
    "latency_ms double, success boolean, error string, retry_count int, from_cache boolean, "
    "error_type string, error_stage string, error_code string"
)
MODEL_FILE = "active string, models map<string,variant>"
PLATE_PAYLOAD = (
    "code int, message string, data struct<id:bigint,name:string,desc:string,subject_id:bigint,"
    "create_name:string,update_name:string,avg_pcp:double,core_avg_pcp:double,rise_count:bigint,"
    "fall_count:bigint,stay_count:bigint,fund_flow:double,has_north:boolean,core_stocks_count:bigint,"
    "hang_ye_long_tou_stocks_count:bigint,"
    "stocks:array<struct<symbol:string,desc:string,desc_url:string,industrial_chain_id:bigint,"
    "is_new:boolean,need_pay:boolean,core_flag:bigint>>,"
    "industrial_chains:array<struct<id:bigint,name:string,`order`:bigint>>,"
    "question_answers:array<struct<question:string,html_answer:string>>>"
)
