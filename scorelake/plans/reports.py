"""Run reports: each section is its own small DataFrame, and the text is made of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import number_text
from scorelake.operators.aggregates import error_type_counts, failed_rows, workflow_summary
from scorelake.operators.ranking import top_failures
from scorelake.schemas import SUMMARY_KEYS

OVERVIEW = ["task_name", "model_id", "request_count", "success_rate", "parse_rate", "avg_latency_ms", "avg_total_tokens", "cost_estimate"]
COMPARE = ["model_id", "success_rate", "parse_rate", "avg_latency_ms", "cost_estimate"]


def overview(summary: DataFrame) -> DataFrame:
    return summary.select(*OVERVIEW)


def task_compare(summary: DataFrame, wide: DataFrame) -> DataFrame:
    """Per task, the models side by side with the task's averaged metrics (columns in name order)."""
    metrics = sorted(c for c in wide.columns if c.startswith("tm_"))
    return (
        summary.join(wide, SUMMARY_KEYS, "left").select("task_name", *COMPARE, *metrics).orderBy("task_name", "model_id")
    )


def failures(results: DataFrame) -> dict[str, DataFrame]:
    failed = failed_rows(results)
    return {"types": error_type_counts(results).orderBy("error_type"), "cases": top_failures(failed)}


# --- text ------------------------------------------------------------------------------------------------

def _cells(values: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), F.lit(" |"))


def _head(spark, section: int, lines: list[str], part: str = "") -> DataFrame:
    literal = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("line")) for i, t in enumerate(lines)]))
    return spark.range(1).select(literal.alias("x")).select(
        F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), F.col("x.i").alias("i"), F.lit("").alias("row")).alias("pos"),
        "x.line",
    )


def _body(df: DataFrame, section: int, fields: list[str], order: list[str], part: Column | None = None) -> DataFrame:
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    return df.select(
        F.struct(F.lit(section).alias("section"), (part if part is not None else F.lit("")).alias("part"),
                 F.lit(1_000).alias("i"), key.alias("row")).alias("pos"),
        _cells([number_text(F.col(f)) if dict(df.dtypes)[f] == "double" else F.col(f) for f in fields]).alias("line"),
    )


def _table_head(title: list[str], fields: list[str]) -> list[str]:
    return [*title, "| " + " | ".join(fields) + " |", "| " + " | ".join(["---"] * len(fields)) + " |"]


def report_lines(results: DataFrame, summary: DataFrame, wide: DataFrame | None = None, run_dir: str = "") -> DataFrame:
    """All report lines as rows (pos, line): overview, one table per task, workflows, failure types and cases."""
    spark = results.sparkSession
    parts = [
        _head(spark, 0, ["# Evaluation report", "", f"Run Dir: `{run_dir}`", "", *_table_head(["## 总表：Model x Metric", ""], OVERVIEW)]),
        _body(overview(summary), 0, OVERVIEW, ["task_name", "model_id"]),
    ]
    tm = sorted(c for c in wide.columns if c.startswith("tm_")) if wide is not None else []
    compare = task_compare(summary, wide) if wide is not None else summary.select("task_name", *COMPARE)
    parts.append(_head(spark, 1, ["", "## 按任务维度模型对比", ""]))
    titles = summary.select("task_name").distinct()
    heads = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), t.alias("line"))
        for i, t in enumerate([F.concat(F.lit("### "), F.col("task_name")), F.lit(""), *map(F.lit, _table_head([], COMPARE + tm))])
    ]))
    parts.append(titles.select("task_name", heads.alias("x")).select(
        F.struct(F.lit(1).alias("section"), F.col("task_name").alias("part"), F.col("x.i").alias("i"), F.lit("").alias("row")).alias("pos"), "x.line"))
    parts.append(_body(compare, 1, COMPARE + tm, ["model_id"], F.col("task_name")))
    flows = workflow_summary(results)
    parts += [
        _head(spark, 2, _table_head(["", "## 按 Workflow 维度概览", ""], flows.columns)),
        _body(flows, 2, flows.columns, ["workflow_name", "workflow_version", "mode", "model_id"]),
    ]
    failed = failures(results)
    parts += [
        _head(spark, 3, _table_head(["", "## 失败样本 (max 5)", "", "### 失败类型分布", ""], ["error_type", "count"])),
        _body(failed["types"], 3, ["error_type", "count"], ["error_type"]),
    ]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    case_lines = [
        F.concat(F.lit("- sample_id: `"), text("sample_id"), F.lit("`")),
        F.concat(F.lit("- task/step: `"), text("task_name"), F.lit("` / `"), text("step_id"), F.lit("`")),
        F.concat(F.lit("- model: `"), text("model_id"), F.lit("`")),
        F.concat(F.lit("- error_type: `"), text("error_type"), F.lit("` / stage: `"), text("error_stage"), F.lit("`")),
        F.concat(F.lit("- error: `"), text("error"), F.lit("`")),
        F.concat(F.lit("- output_excerpt: `"), text("output_excerpt"), F.lit("`")),
        F.lit(""),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("line")) for i, c in enumerate(case_lines)]))
    keys = F.concat_ws("\u0001", text("timestamp"), text("sample_id"), text("step_id"), text("model_id"), text("repeat_idx"))
    parts.append(failed["cases"].select(keys.alias("k"), each.alias("x")).select(
        F.struct(F.lit(4).alias("section"), F.col("k").alias("part"), F.col("x.i").alias("i"), F.lit("").alias("row")).alias("pos"), "x.line"))
    none = failed_rows(results).agg(F.count("*").alias("n")).where("n = 0").select(
        F.struct(F.lit(5).alias("section"), F.lit("").alias("part"), F.lit(0).alias("i"), F.lit("").alias("row")).alias("pos"),
        F.lit("No error cases found.").alias("line"))
    parts.append(none)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


Reporter = Callable[[dict[str, DataFrame]], DataFrame]


def default_reporter(tables: dict[str, DataFrame]) -> DataFrame:
    """A reporter takes named tables and returns report lines; users may pass their own."""
    return report_lines(tables["results"], tables["summary"], tables.get("metrics"))
