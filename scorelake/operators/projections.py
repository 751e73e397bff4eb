"""Row shaping: field mapping, requests, parameters, result rows."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.errors import derive_error
from scorelake.functions.keys import call_cost, redact_map
from scorelake.functions.text import sentiment_text, strip_ws, to_timestamp_or_null, zero_fill
from scorelake.schemas import RESULT_ROW, RESULT_SCHEMA_VERSION, STEP_TASK, as_struct
from scorelake.spec import TaskSpec

_MESSAGE = "struct<role:string,content:string>"


def map_fields(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Overlay canonical names ``{source: canonical}``; originals stay, absent sources are skipped."""
    return df.withColumns({dst: F.col(src) for src, dst in mapping.items() if src in df.columns})


def serialized(df: DataFrame, field: str, step_input: str | None = None) -> Column:
    """JSON text of a field: taken from the step input, else from the sample, else an empty list."""
    choices = []
    if step_input and field in getattr(df.schema[step_input].dataType, "names", []):
        choices.append(F.to_json(F.struct(F.col(f"{step_input}.{field}").alias("v"))))
    if field in df.columns:
        choices.append(F.to_json(F.struct(F.col(field).alias("v"))))
    bare = [F.nullif(F.regexp_extract(c, r'^\{"v":([\s\S]*)\}$', 1), F.lit("")) for c in choices]
    return F.coalesce(*bare, F.lit("[]"))


def optional_section(df: DataFrame, field: str, lead: str, joiner: str = "、") -> Column:
    """Lead plus content when the field is non-empty, else nothing; a list is joined."""
    if field not in df.columns:
        return F.lit("")
    c = F.col(field)
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return F.when(F.size(c) > 0, F.concat(F.lit(lead), F.concat_ws(joiner, c))).otherwise(F.lit(""))
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(lead), c)).otherwise(F.lit(""))


def _user_text(df: DataFrame, task: TaskSpec, step_input: str | None) -> Column:
    """The user text as one concat: literals between the slots, columns in them; an absent field is blank."""
    sections = dict(task.optional_sections)
    parts: list[Column] = []
    for literal, slot, _, _ in Formatter().parse(task.user):
        if literal:
            parts.append(F.lit(literal))
        if not slot:
            continue
        if slot.endswith("_json") and slot[:-5] in task.serialize_fields:
            parts.append(serialized(df, slot[:-5], step_input))
        elif slot.endswith("_section") and slot[:-8] in sections:
            parts.append(optional_section(df, slot[:-8], sections[slot[:-8]]))
        elif slot in df.columns:
            parts.append(F.coalesce(F.col(slot).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def few_shot_messages(pairs) -> list[Column]:
    out = []
    for user, assistant in pairs:
        out += [_message("user", F.lit(user.strip())), _message("assistant", F.lit(assistant.strip()))]
    return out


def build_requests(df: DataFrame, task: TaskSpec, step_input: str | None = None, few_shot: bool = True) -> DataFrame:
    """Add ``messages`` (system, examples, user) and ``prompt_version``."""
    rows = map_fields(df, task.field_mapping)
    messages = F.array(
        _message("system", F.lit(task.system)),
        *(few_shot_messages(task.few_shot) if few_shot else []),
        _message("user", _user_text(rows, task, step_input)),
    ).cast(f"array<{_MESSAGE}>")
    added = rows.withColumns({"messages": messages, "prompt_version": F.lit(task.prompt_version)})
    return added.select(*df.columns, "messages", "prompt_version")


def map_literal(values: dict[str, str]) -> Column:
    items = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def _without_keys(left: Column, right: Column) -> Column:
    return F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))


def merge_maps(*maps: Column) -> Column:
    """Later maps win. Entries are folded so the result does not hang on a session setting."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    merged = F.coalesce(maps[0], empty)
    for m in maps[1:]:
        right = F.coalesce(m, empty)
        merged = F.map_concat(_without_keys(merged, right), right)
    return merged


def active_model(declared: Column, default: str | None, overrides: Column | None = None) -> Column:
    """Step override, else the declared id, with ``$active`` standing for the default; unresolved fails the job."""
    own = F.when(declared == "$active", F.lit(default or None)).otherwise(declared)
    picked = F.nullif(F.coalesce(*([F.nullif(overrides, F.lit(""))] if overrides is not None else []), own), F.lit(""))
    return F.coalesce(picked, F.raise_error(F.lit("no model for this step: none given and no active one")).cast("string"))


def convert_news(df: DataFrame) -> DataFrame:
    """News table to evaluation samples: rename, null to blank, sentiment number to text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(
        F.col("news_id").cast("string").alias("sample_id"),
        *[text(c).alias(c) for c in (
            "ticker", "sec_short_name", "exchange_cd", "trade_date", "news_publish_time", "news_title", "news_body")],
        text("news_summary").alias("gt_summary"),
        sentiment_text(F.coalesce(F.col("sentiment"), F.lit(0))).alias("gt_sentiment"),
        F.coalesce(F.round(F.col("sentiment_score").cast("double"), 6), F.lit(0.0)).alias("gt_sentiment_score"),
    )


def derive_plates(df: DataFrame) -> DataFrame:
    """Percent and hundred-million columns, stock totals and ratios, trimmed names, parsed update time."""
    total = F.col("rise_count") + F.col("fall_count") + F.col("stay_count")
    ratio = lambda c: F.col(c) / F.nullif(F.col("total_stocks"), F.lit(0))
    return (
        df.withColumns({
            "updated_at": to_timestamp_or_null(F.col("updated_at")),
            "avg_pcp_pct": F.col("avg_pcp") * 100,
            "core_avg_pcp_pct": F.col("core_avg_pcp") * 100,
            "fund_flow_yi": F.col("fund_flow") / F.lit(1e8),
            "total_stocks": total,
            "name": strip_ws(F.col("name")),
            "desc": strip_ws(F.col("desc")),
        })
        .withColumns({"rise_ratio": ratio("rise_count"), "core_ratio": ratio("core_stocks_count")})
    )


def model_snapshot(models: DataFrame, params: dict[str, str]) -> DataFrame:
    """Per model, its defaults overlaid by the run's parameters, secrets masked."""
    return models.select("model_id", redact_map(merge_maps(F.col("default_params"), map_literal(params))).alias("params"))


def step_snapshot(steps: DataFrame, models: DataFrame, params: dict[str, str]) -> DataFrame:
    """Per workflow step and its model: model defaults < run parameters < step overrides, masked."""
    rows = steps.join(models.select("model_id", "default_params"), "model_id")
    merged = merge_maps(F.col("default_params"), map_literal(params), F.col("params_override"))
    return rows.select(F.concat_ws(":", "step_id", "model_id").alias("key"), redact_map(merged).alias("params"))


# --- result rows -----------------------------------------------------------------------------------------

def result_rows(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Select to the result schema: a given expression, else the column of that name, else a typed default."""
    defaults = {T.StringType(): F.lit(""), T.DoubleType(): F.lit(0.0), T.IntegerType(): F.lit(0), T.BooleanType(): F.lit(False)}
    nullable = {"parsed", "workflow_name", "workflow_version", "timestamp"}
    out = []
    for field in as_struct(RESULT_ROW).fields:
        if field.name in values:
            c = values[field.name]
        elif field.name in df.columns:
            c = F.col(field.name)
        elif field.name in nullable:
            c = F.lit(None)
        elif field.name == "params":
            c = F.create_map().cast("map<string,string>")
        elif field.name == "task_metrics":
            c = F.array().cast(field.dataType)
        else:
            c = defaults[field.dataType]
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)


def utc_now_text() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def called_rows(df: DataFrame, fixed: dict[str, Column]) -> DataFrame:
    """Result rows of answered or failed calls.

    ``df`` has the call columns (content, tokens, latency, success, error, retry_count, from_cache and the
    recorded error triple), ``price``, ``parsed_json``, ``parse_applicable``, ``parse_success``, ``task_metrics``.
    """
    error = F.coalesce("error", F.lit(""))
    derived = derive_error(
        F.col("success"), F.col("parse_applicable"), F.col("parse_success"), error,
        F.col("error_type"), F.col("error_stage"), F.col("error_code"),
    )
    return result_rows(df.withColumn("_e", derived), {
        "schema_version": F.lit(RESULT_SCHEMA_VERSION),
        "timestamp": utc_now_text(),
        "error": error,
        **{k: F.col(f"_e.{k}") for k in ("error_type", "error_stage", "error_code", "error_detail")},
        "latency_ms": F.round("latency_ms", 2),
        "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
        "cost_estimate": call_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price"), F.col("from_cache")),
        "output_text": F.coalesce("content", F.lit("")),
        "parsed": F.col("parsed_json"),
        **fixed,
    })


def error_rows(df: DataFrame, fixed: dict[str, Column], message: Column,
               kind: Column, stage: Column, code: Column) -> DataFrame:
    """Result rows for work that never reached a call: zero usage, the given error."""
    return result_rows(df, {
        "schema_version": F.lit(RESULT_SCHEMA_VERSION),
        "timestamp": utc_now_text(),
        "step_id": F.lit(STEP_TASK),
        "error": message, "error_detail": message,
        "error_type": kind, "error_stage": stage, "error_code": code,
        **fixed,
    })
