"""Workflow roll-up and gating over step records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.aggregates import exact_sum
from scorelake.schemas import RESULT_SCHEMA_VERSION, STEP_E2E


def model_labels(step_models: DataFrame) -> DataFrame:
    """``+``-joined model ids in step order, per workflow. Input: (workflow_name, ord, model_id), any repeats."""
    spec = step_models.select("workflow_name", "ord", "model_id").distinct()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "model_id"))), lambda x: x["model_id"])
    return spec.groupBy("workflow_name").agg(F.array_join(parts, "+").alias("model_label"))


def end_to_end(steps: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sample over its steps.

    ``steps`` has: ord, executed, success (of the row), parse_applicable, parse_success, parsed, latency_ms,
    total_tokens, retry_count, cost_estimate. Skipped steps add nothing to the sums but fail the whole; the
    output is that of the last step, the parse flag that of the last *executed* one. All parts combine on the
    map side, nothing is gathered.
    """
    ok = F.col("executed") & F.col("success") & (F.col("parse_success") | ~F.col("parse_applicable"))
    ran = lambda c: F.when(F.col("executed"), F.col(c))
    total = lambda c: F.coalesce(F.sum(ran(c).cast("bigint")), F.lit(0))
    out = steps.groupBy(*keys).agg(
        F.every(ok).alias("success"),
        F.coalesce(F.max_by("parse_applicable", ran("ord")), F.lit(True)).alias("parse_applicable"),
        F.max_by(F.struct(ran("parsed").alias("p")), "ord")["p"].alias("parsed"),
        F.round(exact_sum(ran("latency_ms")), 2).alias("latency_ms"),
        total("total_tokens").alias("total_tokens"),
        total("retry_count").alias("retry_count"),
        F.round(exact_sum(ran("cost_estimate")), 8).alias("cost_estimate"),
    )
    return out.withColumns({
        "parse_success": F.col("parse_applicable") & F.col("parsed").isNotNull(),
        "error": F.when(F.col("success"), "").otherwise("workflow_step_failed"),
        "step_id": F.lit(STEP_E2E),
        "mode": F.lit("workflow_e2e"),
        "schema_version": F.lit(RESULT_SCHEMA_VERSION),
    })


def gate(states: dict[str, Column], inputs: dict[str, str]) -> dict[str, Column]:
    """Which steps run, from each step's own recorded outcome.

    ``states`` maps a step, in listed order, to the boolean "its call was good enough for a reader";
    ``inputs`` maps it to the step it reads from. A step runs when it reads the sample, or when the step it
    reads from is listed earlier, ran, and was good.
    """
    runs: dict[str, Column] = {}
    for step in states:
        source = inputs[step]
        if source == "sample":
            runs[step] = F.lit(True)
        else:
            runs[step] = runs[source] & F.coalesce(states[source], F.lit(False)) if source in runs else F.lit(False)
    return runs
