"""Roll-ups over result rows and the statistics the reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.order_stats import (
    floor_rank,
    join_on_keys,
    medians,
    nearest_rank,
    percentiles,
    upper_median,
    values_at_ranks,
)
from scorelake.schemas import STEP_TASK, SUMMARY_KEYS, SUMMARY_SCHEMA_VERSION

EXACT = "decimal(38,10)"


def summable(c: Column) -> Column:
    """The value if it can be summed exactly to ten digits after the point, else null: not finite, or beyond 1e20."""
    x = c.cast("double")
    return F.when(F.abs(x) < 1e20, x)


def exact_sum(c: Column) -> Column:
    """Sum of the summable values, whatever the order of rows; 0 for no rows. For money and latency."""
    return F.coalesce(F.sum(summable(c).cast(EXACT)).cast("double"), F.lit(0.0))


def exact_mean(c: Column) -> Column:
    """Mean of what is summed; 0 where nothing is."""
    return F.coalesce(exact_sum(c) / F.nullif(F.count(summable(c)), F.lit(0)), F.lit(0.0))


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    x = c.cast("double")
    return F.when(F.abs(x) <= 1.7976931348623157e308, x)


def finite_mean(c: Column, digits: int) -> Column:
    """Mean of the finite values only, null without any; digits after the tenth count."""
    return F.round(F.avg(finite(c)), digits)


def not_finite(c: Column) -> Column:
    """Number of values that are there but left out of the means."""
    return F.count_if(c.isNotNull() & finite(c).isNull())


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _rate(hit: Column, base: Column) -> Column:
    return F.round(F.coalesce(hit / F.nullif(base, F.lit(0)), F.lit(0.0)), 4)


_DEFAULTS = {
    "task_name": "", "model_id": "", "step_id": STEP_TASK, "success": False, "parse_applicable": True, "parse_success": False,
    "latency_ms": 0.0, "total_tokens": 0, "retry_count": 0, "cost_estimate": 0.0,
}


def keyed_results(results: DataFrame) -> DataFrame:
    """Group keys and measures with their defaults filled in; an absent column is all default."""
    return results.withColumns({
        name: _or(name, default) if name in results.columns else F.lit(default) for name, default in _DEFAULTS.items()
    })


def _base_measures() -> list[Column]:
    n = F.count("*")
    parsed = F.count_if(F.col("parse_applicable"))
    return [
        n.alias("request_count"),
        F.count_if("success").alias("success_count"),
        _rate(F.count_if("success"), n).alias("success_rate"),
        F.round(exact_mean(F.col("latency_ms")), 2).alias("avg_latency_ms"),
        F.round(F.sum(F.col("total_tokens").cast("bigint")) / n, 2).alias("avg_total_tokens"),
        _rate(F.count_if(F.col("parse_applicable") & F.col("parse_success")), parsed).alias("parse_rate"),
        F.sum(F.col("retry_count").cast("bigint")).alias("retry_count"),
        F.round(exact_sum(F.col("cost_estimate")), 6).alias("cost_estimate"),
    ]


SUMMARY_COLUMNS = [
    "schema_version", "task_name", "model_id", "step_id", "request_count", "success_count", "success_rate",
    "avg_latency_ms", "p95_latency_ms", "avg_total_tokens", "p95_total_tokens", "parse_rate", "retry_count",
    "cost_estimate",
]


def summarize(results: DataFrame) -> DataFrame:
    """One row per task, model and step: counts, rates, latency, tokens, retries and cost."""
    rows = keyed_results(results)
    base = rows.groupBy(*SUMMARY_KEYS).agg(*_base_measures())
    p95 = values_at_ranks(rows, SUMMARY_KEYS, {
        "p95_latency_ms": (F.col("latency_ms"), nearest_rank("0.95")),
        "p95_total_tokens": (F.col("total_tokens"), nearest_rank("0.95")),
    })
    return (
        base.join(p95, SUMMARY_KEYS, "left")
        .withColumn("schema_version", F.lit(SUMMARY_SCHEMA_VERSION))
        .withColumn("p95_latency_ms", F.round("p95_latency_ms", 2))
        .withColumn("p95_total_tokens", F.round("p95_total_tokens", 2))
        .select(*SUMMARY_COLUMNS)
    )


def sort_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy("task_name", "step_id", "model_id")


def p95(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    return values_at_ranks(df, keys, {out: (value, nearest_rank("0.95"))})


def task_metric_averages(results: DataFrame) -> DataFrame:
    """Long form (task, model, step, metric, avg over finite values); a metric no row has a number for stays, with null.

    Model output can put infinities and NaN into metrics; :func:`not_finite` counts them.
    """
    return (
        keyed_results(results)
        .select(*SUMMARY_KEYS, F.explode("task_metrics").alias("m"))
        .groupBy(*SUMMARY_KEYS, F.col("m.name").alias("metric"))
        .agg(finite_mean(F.col("m.value"), 4).alias("avg_value"))
    )


def wide_metrics(averages: DataFrame, names: list[str]) -> DataFrame:
    """``tm_<name>_avg`` columns for a given, ordered list of metrics."""
    columns = [F.max(F.when(F.col("metric") == m, F.col("avg_value"))).alias(f"tm_{m}_avg") for m in names]
    return averages.groupBy(*SUMMARY_KEYS).agg(*columns)


def failed_rows(results: DataFrame) -> DataFrame:
    return results.where(failed_condition())


def failed_condition() -> Column:
    return ~_or("success", False) | (_or("parse_applicable", True) & ~_or("parse_success", False))


def error_type_counts(results: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("error_type"), F.lit("")), F.lit("unknown_error"))
    return failed_rows(results).groupBy(kind.alias("error_type")).agg(F.count("*").alias("count"))


def workflow_summary(results: DataFrame) -> DataFrame:
    keys = ["workflow_name", "workflow_version", "mode", "model_id"]
    rows = keyed_results(results.where(F.startswith("mode", F.lit("workflow_")))).withColumns(
        {k: _or(k, "") for k in keys}
    )
    picked = [c for c in ("request_count", "success_rate", "parse_rate", "avg_latency_ms", "cost_estimate")]
    return rows.groupBy(*keys).agg(*_base_measures()).select(*keys, *picked)


def batch_stats(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Success count and token sums; latency spread over successful calls with a positive latency."""
    base = calls.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("success_count"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("prompt_tokens").cast("bigint"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("completion_tokens").cast("bigint"))), F.lit(0)).alias("output_tokens"),
    )
    timed = calls.where("success and latency_ms > 0")
    spread = timed.groupBy(*keys).agg(
        exact_mean(F.col("latency_ms")).alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    )
    ranked = values_at_ranks(timed, keys, {
        "_lo": (F.col("latency_ms"), lambda n: F.floor((n + 1) / 2).cast("bigint")),
        "_hi": (F.col("latency_ms"), lambda n: F.floor((n + 2) / 2).cast("bigint")),
        "p99_ms": (F.col("latency_ms"), floor_rank("0.99")),
    }).withColumn("p50_ms", (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi")
    return join_on_keys([base, spread, ranked], keys).select(
        *keys, "total", "success_count", "input_tokens", "output_tokens",
        F.round("avg_ms", 4).alias("avg_ms"), "p50_ms", "p99_ms", "min_ms", "max_ms",
    )


def overlap_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Spread of F1 (average, upper median, max, min) and average precision and recall."""
    base = scored.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.round(exact_mean(F.col("f1")), 6).alias("avg_f1"),
        F.max("f1").alias("max_f1"),
        F.min("f1").alias("min_f1"),
        F.round(exact_mean(F.col("precision")), 6).alias("avg_precision"),
        F.round(exact_mean(F.col("recall")), 6).alias("avg_recall"),
    )
    return base.join(values_at_ranks(scored, keys, {"median_f1": (F.col("f1"), upper_median)}), keys, "left")


def group_sizes(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def distinct_counts(df: DataFrame, keys: list[str], counted: dict[str, str], approx: bool = False) -> DataFrame:
    """Distinct non-null values of each column per key. One exact column is de-duplicated before it is counted."""
    if approx:
        return df.groupBy(*keys).agg(*[F.approx_count_distinct(c).alias(o) for o, c in counted.items()])
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(o) for o, c in counted.items()])


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(out)).orderBy(F.desc(out), column)
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form, one row per column: count, mean, std, min, exact quartiles, max (nulls left out)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    long = df.select(pairs.alias("x")).select("x.column", "x.value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        finite_mean(F.col("value"), 6).alias("mean"),
        F.round(F.stddev_samp(finite(F.col("value"))), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = percentiles(long, ["column"], F.col("value"), {"p25": "0.25", "p50": "0.5", "p75": "0.75"})
    return base.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min",
        *[F.round(q, 6).alias(q) for q in ("p25", "p50", "p75")], "max",
    )


def null_counts(df: DataFrame) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column", "nulls")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the whole range, the last one closed; empty bins are kept, with 0.

    The range is a one-row scalar subquery, so no join is needed to hand it to every row.
    """
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where("x is not null")
    span = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("r")).scalar()
    # One value only: a unit range centred on it.
    flat = span["hi"] == span["lo"]
    lo = F.when(flat, span["lo"] - 0.5).otherwise(span["lo"])
    width = F.when(flat, F.lit(1.0)).otherwise(span["hi"] - span["lo"]) / bins
    index = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1))
    counted = rows.select(index.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per whole-number value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("bin")).agg(
        F.count("*").alias("n")
    )


def column_medians(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return medians(df, [], values)


def sign_counts(df: DataFrame, column: str) -> DataFrame:
    x, n = F.col(column), F.count("*")
    return df.agg(
        F.count_if(x > 0).alias("up"),
        F.count_if(x < 0).alias("down"),
        F.count_if(x == 0).alias("flat"),
        F.round(F.count_if(x > 0) / F.nullif(n, F.lit(0)) * 100, 1).alias("up_pct"),
        F.round(F.count_if(x < 0) / F.nullif(n, F.lit(0)) * 100, 1).alias("down_pct"),
    )


def value_range(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{c}_{tag}") for c in columns for tag, f in (("min", F.min), ("max", F.max))])


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Count matrix with one column per given value, 0 where the pair is absent."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(row).agg(*cells)


def crosstab_long(counted: DataFrame, row: str, column: str, n: str = "n", most: int = 1_000) -> DataFrame:
    """Count matrix in long form, 0 filled, over the rows and columns that occur in the counted pairs.

    A row's cells, and the column names, travel as one map and one list, so more than ``most`` columns are refused.
    """
    listed = F.collect_list(column)
    few = F.when(F.count(F.lit(1)) <= most, listed).otherwise(F.raise_error(F.lit(f"more than {most} columns in the matrix")).cast("array<string>"))
    names = counted.select(F.col(column).cast("string").alias(column)).distinct().limit(most + 1).agg(few).scalar()
    cells = counted.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, n))).alias("_cells"))
    grid = cells.select(row, "_cells", F.explode(names).alias(column))
    return grid.select(row, column, F.coalesce(F.try_element_at("_cells", F.col(column)), F.lit(0)).alias(n))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ingest_outcome(log: DataFrame) -> DataFrame:
    """Totals of a load; the failed ids themselves stay rows, see :func:`failed_ids`."""
    return log.agg(
        F.count_if("ok").alias("success"),
        F.count_if(~F.coalesce("ok", F.lit(False))).alias("fail"),
    )


def failed_ids(log: DataFrame, key: str) -> DataFrame:
    return log.where(~F.coalesce("ok", F.lit(False))).select(key)


def parse_outcomes(parsed: DataFrame, column: str = "parse") -> DataFrame:
    return parsed.groupBy(F.col(f"{column}.reason").alias("reason"), F.col(f"{column}.strategy").alias("strategy")).agg(
        F.count("*").alias("rows")
    )


def dataset_stats(samples: DataFrame) -> DataFrame:
    count = F.col("core_stocks_count")
    return samples.agg(
        F.count("*").alias("samples"),
        F.min(count).alias("min_core"),
        F.max(count).alias("max_core"),
        F.round(F.avg(count), 1).alias("avg_core"),
        F.count_if(F.size("chains") > 0).alias("with_chains"),
        F.count_if(F.col("plate_intro").isNotNull()).alias("with_intro"),
    )
