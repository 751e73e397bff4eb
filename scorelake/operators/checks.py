"""Filters of the reports and checks that return their violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import strip_ws
from scorelake.operators.grid import literal_rows
from scorelake.spec import PRESETS, MetricRule

# Answer types of the contract, core mark, and builder thresholds.
ANSWER_TYPES = ("choice", "number", "list", "text", "reasoning")
CORE_FLAG = 100
MIN_CORE, MAX_CORE, MIN_DESC_LEN, INTRO_LEN = 5, 50, 10, 500
INTRO_QUESTION = "板块介绍"


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def long_enough(c: Column, n: int = MIN_DESC_LEN) -> Column:
    return F.length(strip_ws(F.coalesce(c, F.lit("")))) >= n


def core_only(stocks: DataFrame) -> DataFrame:
    return stocks.where(F.col("core_flag") == CORE_FLAG)


def workflow_rows(results: DataFrame) -> DataFrame:
    return results.where(F.startswith("mode", F.lit("workflow_")))


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def scored_rows(results: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Rows that succeeded and have a non-empty parsed object (kept as JSON text)."""
    text = F.regexp_replace(F.col(parsed), r"\s", "")
    return results.where(F.col("success") & text.isNotNull() & ~text.isin("", "{}", "null"))


def cache_cost_violations(results: DataFrame) -> DataFrame:
    return results.where(F.col("from_cache") & (F.coalesce("cost_estimate", F.lit(0.0)) != 0.0))


def enforce_cache_cost(results: DataFrame) -> DataFrame:
    """The same rows, but a cached row with a cost fails the job when it is reached."""
    bad = F.col("from_cache") & (F.coalesce("cost_estimate", F.lit(0.0)) != 0.0)
    message = F.concat(F.lit("a cached row must cost nothing: sample "), F.coalesce("sample_id", F.lit("?")))
    checked = F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("cost_estimate"))
    return results.withColumn("cost_estimate", checked)


def answer_contract_violations(answers: DataFrame) -> DataFrame:
    """Rows breaking the answer contract, one row per reason."""
    required = ["task_id", "sample_id", "answer_type", "prediction", "ground_truth"]
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    reasons.append(F.when(~F.col("answer_type").isin(*ANSWER_TYPES), F.lit("unknown answer_type")))
    # meta may be absent, but where present it must name its version.
    reasons.append(F.when(
        F.col("meta").isNotNull() & F.element_at("meta", "schema_version").isNull(), F.lit("missing meta.schema_version")
    ))
    return answers.select("task_id", "sample_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def rule_table(spark, presets=PRESETS, extra: dict[str, tuple[MetricRule, ...]] | None = None) -> DataFrame:
    rows = [(t, m.type, m.name or "") for t, p in presets.items() for m in p.metrics]
    rows += [(t, m.type, m.name or "") for t, rules in (extra or {}).items() for m in rules]
    return literal_rows(spark, rows, "owner string, metric_type string, metric_name string")


def unknown_metric_types(rules: DataFrame, known: list[str]) -> DataFrame:
    return rules.where(~F.col("metric_type").isin(*known))


def unresolved_keys(models: DataFrame, column: str = "api_key") -> DataFrame:
    """Models whose key still holds a ``${NAME}`` placeholder."""
    return models.where(F.contains(F.col(column), F.lit("${")))
