"""Score cards and regression checks over ordered ``array<struct<name,value>>`` scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.aggregates import finite
from scorelake.operators.grid import literal_rows
from scorelake.spec import PRESETS, ScorerPreset

TOLERANCE = 0.02


@dataclass(frozen=True)
class TagRule:
    """Tag of a row: some sub-score whose whole name matches ``pattern`` is under ``under`` or over ``over``, or, with ``missing``, has no finite value."""

    tag: str
    pattern: str
    under: float | None = None
    over: float | None = None
    missing: bool = False

    def holds(self, scores: Column) -> Column:
        def hit(score: Column) -> Column:
            value, found = finite(score["value"]), F.lit(False)
            if self.missing:
                found = found | value.isNull()
            if self.under is not None:
                found = found | F.coalesce(value < F.lit(self.under), F.lit(False))
            if self.over is not None:
                found = found | F.coalesce(value > F.lit(self.over), F.lit(False))
            return score["name"].rlike(f"^(?:{self.pattern})$") & found

        return F.exists(scores, hit)


# What a low sub-score says about the answer. Rows without scores, and rows under their preset's threshold, have tags of their own.
TAG_RULES = (
    TagRule("missing_score", ".*", missing=True),
    TagRule("wrong_choice", ".*_acc", under=1.0),
    TagRule("out_of_tolerance", ".*_within_tol", under=1.0),
    TagRule("extra_items", ".*_precision", under=0.5),
    TagRule("missed_items", ".*_recall", under=0.5),
    TagRule("little_overlap", "rouge1|.*_f1", under=0.3),
    TagRule("answer_not_in_steps", ".*_consistency", under=1.0),
    TagRule("steps_out_of_order", ".*_order", under=1.0),
    TagRule("steps_missing", ".*_completeness", under=1.0),
)
NO_SCORE, BELOW = "no_score", "below_threshold"


def error_tags(scores: Column, below: Column, rules: tuple[TagRule, ...] = TAG_RULES) -> Column:
    """Tags of a row in the order of the rules; those without a score and those below the threshold come last."""
    named = [F.when(rule.holds(scores), F.lit(rule.tag)) for rule in rules]
    empty = F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, F.lit(NO_SCORE))
    return F.array_distinct(F.array_compact(F.array(*named, empty, F.when(below, F.lit(BELOW)))))


def preset_rows(spark, presets: dict[str, ScorerPreset] = PRESETS) -> DataFrame:
    """Presets as a dimension: answer type, primary metric, threshold and the names its type stands for."""
    rows = [
        (p.answer_type, p.primary_metric, p.pass_threshold,
         [m.name for m in p.metrics if m.type == p.primary_metric and m.name])
        for p in presets.values()
    ]
    return literal_rows(spark, rows, "answer_type string, primary_metric string, pass_threshold double, named_by_type array<string>")


def join_presets(df: DataFrame, presets: dict[str, ScorerPreset] = PRESETS) -> DataFrame:
    """Left join to the presets; the dimension has one row per configured answer type, so it is broadcast."""
    return df.join(F.broadcast(preset_rows(df.sparkSession, presets)), "answer_type", "left")


def primary_score(scores: Column, primary_metric: Column, named_by_type: Column) -> Column:
    """Exact name, else the first name ending in ``_<key>``, else a name listed for the type, else 0."""
    def first(test) -> Column:
        return F.get(F.filter(scores, test), F.lit(0))

    by_name = first(lambda m: m["name"] == primary_metric)
    by_suffix = first(lambda m: F.endswith(m["name"], F.concat(F.lit("_"), primary_metric)))
    listed = F.get(F.filter(named_by_type, lambda n: F.exists(scores, lambda m: m["name"] == n)), F.lit(0))
    by_type = first(lambda m: m["name"] == listed)
    found = F.when(by_name.isNotNull(), by_name["value"]).when(by_suffix.isNotNull(), by_suffix["value"]).otherwise(by_type["value"])
    return F.coalesce(found, F.lit(0.0))


def score_cards(df: DataFrame, presets: dict[str, ScorerPreset] = PRESETS, tags: tuple[TagRule, ...] | None = TAG_RULES) -> DataFrame:
    """Add primary_metric, primary_score, passed, sub_scores and error_tags; rows have ``answer_type`` and ordered ``raw_scores``. ``tags=None`` leaves all rows without tags."""
    rows = join_presets(df, presets)
    scores, known = F.col("raw_scores"), F.col("primary_metric").isNotNull()
    head = F.get(scores, F.lit(0))
    score = F.when(known, primary_score(scores, F.col("primary_metric"), F.col("named_by_type"))).otherwise(
        F.coalesce(head["value"], F.lit(0.0))
    )
    return rows.select(
        *df.columns,
        F.when(known, F.col("primary_metric")).otherwise(F.coalesce(head["name"], F.lit(""))).alias("primary_metric"),
        score.alias("primary_score"),
        F.coalesce(known & (score >= F.col("pass_threshold")), F.lit(False)).alias("passed"),
        scores.alias("sub_scores"),
        (F.array().cast("array<string>") if tags is None else error_tags(scores, F.coalesce(known & (score < F.col("pass_threshold")), F.lit(False)), tags)).alias("error_tags"),
        F.lit("").alias("explain"),
    )


def check_regression(joined: DataFrame, current: str, baseline: str, metric: Column, tolerance: float = TOLERANCE) -> DataFrame:
    """Add delta (6 digits, rounded before the comparison), regressed and details; null where a side is missing."""
    delta = F.round(F.col(current) - F.col(baseline), 6)
    regressed = delta < F.lit(-float(tolerance))
    text = F.when(
        regressed,
        F.concat(F.lit("REGRESSION: "), metric, F.format_string(" dropped by %.4f", F.abs(delta)), F.lit(f" (tolerance={tolerance})")),
    ).when(delta.isNotNull(), F.lit("OK"))
    return joined.withColumns({"delta": delta, "regressed": regressed, "details": text})


BASELINE_KEYS = ["task_name", "model_id", "prompt_version", "scorer_version"]


def compare_runs(baseline: DataFrame, current: DataFrame, keys: list[str] = BASELINE_KEYS, tolerance: float = TOLERANCE) -> DataFrame:
    """Full outer join of two score tables; rows on one side only are kept and marked."""
    b = baseline.select(*keys, F.col("primary_metric").alias("_bm"), F.col("primary_score").alias("baseline_score"))
    c = current.select(*keys, F.col("primary_metric").alias("_cm"), F.col("primary_score").alias("current_score"))
    joined = b.join(c, keys, "full")
    side = F.when(F.col("baseline_score").isNull(), "current_only").when(
        F.col("current_score").isNull(), "baseline_only"
    ).otherwise("both")
    checked = check_regression(joined, "current_score", "baseline_score", F.coalesce("_cm", "_bm"), tolerance)
    return checked.withColumn("side", side).drop("_bm", "_cm")


def metric_drift(baseline: DataFrame, current: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """The same comparison for every sub-score: long tables (keys, metric, avg_value)."""
    b = baseline.select(*keys, "metric", F.col("avg_value").alias("baseline_score"))
    c = current.select(*keys, "metric", F.col("avg_value").alias("current_score"))
    return check_regression(b.join(c, [*keys, "metric"], "full"), "current_score", "baseline_score", F.col("metric"), tolerance)
