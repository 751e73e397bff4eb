"""What follows a score card: gates on sub-scores, error tags, and comparison over many runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.aggregates import finite, finite_mean
from scorelake.operators.scorecards import BASELINE_KEYS, TOLERANCE, check_regression

# --- gates -----------------------------------------------------------------------------------------------

KINDS = ("range", "drop", "rise")


@dataclass(frozen=True)
class Gate:
    """A condition on all sub-scores whose whole name matches ``pattern``.

    ``range``: the score lies from ``low`` to ``high``, either of which may be open. ``drop`` and ``rise``: it is at most ``tolerance`` under, or over, its baseline
    (scores that should be high, errors that should be low). A ``required`` gate is also breached by a score that is missing or no finite number.
    """

    name: str
    pattern: str
    kind: str
    low: float | None = None
    high: float | None = None
    tolerance: float = TOLERANCE
    required: bool = True

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"gate {self.name}: kind is one of {', '.join(KINDS)}")

    def breach(self, current: Column, baseline: Column) -> Column:
        """Text of the breach, null where the gate holds. Differences have six digits, as in the regression check."""
        number = finite(current)
        shown = lambda c: F.format_string("%.4f", c)
        if self.kind == "range":
            under = number < F.lit(self.low) if self.low is not None else F.lit(False)
            over = number > F.lit(self.high) if self.high is not None else F.lit(False)
            text = F.when(under, F.concat(shown(number), F.lit(f" is under {self.low}"))).when(over, F.concat(shown(number), F.lit(f" is over {self.high}")))
        else:
            change = F.round(number - finite(baseline), 6) * (1 if self.kind == "rise" else -1)
            verb = "rose" if self.kind == "rise" else "dropped"
            text = F.when(change > F.lit(float(self.tolerance)), F.concat(F.lit(f"{verb} by "), shown(change), F.lit(f" (tolerance={self.tolerance})")))
        return F.when(number.isNull(), F.lit("missing") if self.required else F.lit(None)).otherwise(text)


# Shares lie between 0 and 1; the sub-scores that a regression shows in first may not move beyond the tolerance.
GATES = (
    Gate("share", r".*_(acc|precision|recall|f1|within_tol|consistency|support_coverage|order|completeness)|rouge1", "range", 0.0, 1.0),
    Gate("stable_share", r".*_(acc|f1|within_tol)|rouge1", "drop"),
    Gate("stable_error", r".*_mae", "rise"),
)


def check_gates(scores: DataFrame, gates: Iterable[Gate] = GATES, metric: str = "metric", current: str = "current_score", baseline: str = "baseline_score") -> DataFrame:
    """One row for every score and gate that concern each other: the columns of ``scores`` and ``gate_no``, ``gate``, ``breach`` (text, null where it holds).

    The rules are few and fixed, so they are columns of the row, and no join is made. A score that no gate concerns has no row.
    """
    checks = [
        F.when(F.col(metric).rlike(f"^(?:{g.pattern})$"), F.struct(F.lit(no).alias("gate_no"), F.lit(g.name).alias("gate"), g.breach(F.col(current), F.col(baseline)).alias("breach")))
        for no, g in enumerate(gates)
    ]
    return scores.select(*scores.columns, F.inline(F.array_compact(F.array(*checks))))


def gate_verdicts(checked: DataFrame, keys: list[str], metric: str = "metric") -> DataFrame:
    """Per key: gates checked and breached, whether all hold, and the first breach in the order of the gates, then of the metrics' names."""
    broken = F.col("breach").isNotNull()
    first = F.min(F.when(broken, F.struct("gate_no", F.col(metric).alias("metric"), "gate", "breach")))
    rows = checked.groupBy(*keys).agg(F.count("*").alias("checked"), F.count_if(broken).alias("breached"), first.alias("_first"))
    return rows.select(
        *keys, "checked", "breached", (F.col("breached") == 0).alias("passed"), F.col("_first.gate").alias("first_gate"),
        F.col("_first.metric").alias("first_metric"), F.col("_first.breach").alias("first_breach"))


# --- error tags ------------------------------------------------------------------------------------------

def tag_counts(cards: DataFrame, keys: list[str], tags: str = "error_tags") -> DataFrame:
    """(keys, tag, rows, share): how many of the key's rows have the tag."""
    rows = cards.select(*keys, F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>"))).alias("_tags"))
    each = rows.groupBy(*keys, "_tags").agg(F.count("*").alias("_n"))
    total = each.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    found = each.select(*keys, "_n", F.explode("_tags").alias("tag")).groupBy(*keys, "tag").agg(F.sum("_n").alias("rows"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = found.alias("a").join(total.alias("b"), same) if keys else found.alias("a").withColumn("_all", total.select("_all").scalar())
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], "tag", "rows", F.round(F.col("rows") / F.col("_all"), 4).alias("share"))


def tag_pair_counts(cards: DataFrame, keys: list[str], tags: str = "error_tags") -> DataFrame:
    """(keys, tag, other, rows): how often two tags stand on one row, ``tag`` before ``other``. Rows are counted by their list of tags first,
    so pairs are made once for every list that occurs: a list has no more tags than there are rules."""
    lists = cards.select(*keys, F.array_sort(F.array_distinct(F.col(tags))).alias("_tags")).where(F.size("_tags") > 1)
    each = lists.groupBy(*keys, "_tags").agg(F.count("*").alias("_n"))
    place = F.sequence(F.lit(0), F.size("_tags") - 2)
    pairs = F.flatten(F.transform(place, lambda i: F.transform(
        F.slice("_tags", i + 2, F.size("_tags") - i - 1), lambda other: F.struct(F.get("_tags", i).alias("tag"), other.alias("other")))))
    return each.select(*keys, "_n", F.inline(pairs)).groupBy(*keys, "tag", "other").agg(F.sum("_n").alias("rows"))


# --- many runs -------------------------------------------------------------------------------------------

RUN = ["run_id", "run_time"]


def run_scores(cards: DataFrame, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """(run, keys, metric, score, rows): mean of every sub-score of a run's cards over its finite values; the run's time is that of its first row."""
    long = cards.select("run_id", "run_time", *keys, F.inline("sub_scores"))
    grouped = long.groupBy("run_id", *keys, F.col("name").alias("metric"))
    return grouped.agg(F.min("run_time").alias("run_time"), finite_mean(F.col("value"), 6).alias("score"), F.count(finite(F.col("value"))).alias("rows"))


def as_of_baseline(current: DataFrame, baseline: DataFrame, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """Every score of ``current`` with the newest score that ``baseline`` has for its key and metric from an earlier time: columns ``current_score``,
    ``baseline_run``, ``baseline_time`` and ``baseline_score``, null where there is none.

    Both sides have run_id, run_time, the keys, metric and score; they may be the same table. They are put in one order of time per key and metric, and the
    last baseline value is carried forward, so no range of runs is joined; such a series has a row for each run. Scores that are null are no baseline. Of equal times the baseline
    is not the earlier one; of several baselines at one time the run with the greatest name counts.
    """
    series = [*keys, "metric"]
    none = F.lit(None)
    value = F.struct(F.col("run_id").alias("run"), F.col("run_time").alias("time"), F.col("score").alias("score"))
    left = current.select(*RUN, *series, "score", F.lit(0).alias("_side"), none.cast("struct<run:string,time:timestamp,score:double>").alias("_base"))
    right = baseline.where("score is not null").select(*RUN, *series, "score", F.lit(1).alias("_side"), value.cast("struct<run:string,time:timestamp,score:double>").alias("_base"))
    order = Window.partitionBy(*series).orderBy("run_time", "_side", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.unionByName(right).withColumn("_last", F.last_value("_base", ignoreNulls=True).over(order)).where("_side = 0")
    return carried.select(
        *RUN, *series, F.col("score").alias("current_score"), F.col("_last.run").alias("baseline_run"), F.col("_last.time").alias("baseline_time"),
        F.col("_last.score").alias("baseline_score"))


def compare_over_runs(scores: DataFrame, keys: list[str] = BASELINE_KEYS, baseline: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """All scores of any number of runs against their baselines as of the run, with delta, regressed and details. ``baseline`` defaults to the runs themselves."""
    return check_regression(as_of_baseline(scores, scores if baseline is None else baseline, keys), "current_score", "baseline_score", F.col("metric"), tolerance)


def cross_run_report(compared: DataFrame, keys: list[str] = BASELINE_KEYS) -> DataFrame:
    """Per run: scores, how many had a baseline, regressed or improved, and the largest drop with its metric and key."""
    worst = F.min(F.when(F.col("delta") < 0, F.struct("delta", "metric", *keys)))
    rows = compared.groupBy(*RUN).agg(
        F.count("*").alias("scores"), F.count("baseline_score").alias("compared"), F.count_if("regressed").alias("regressed"),
        F.count_if(F.col("delta") > 0).alias("improved"), worst.alias("_worst"))
    return rows.select(
        *RUN, "scores", "compared", "regressed", "improved", F.col("_worst.delta").alias("worst_delta"), F.col("_worst.metric").alias("worst_metric"),
        *[F.col(f"_worst.{k}").alias(f"worst_{k}") for k in keys])
