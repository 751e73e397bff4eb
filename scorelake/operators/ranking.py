"""Top-k, scaling and row-picking operators. Every cut has a full tie key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import eta_text, progress_fields


def nlargest(df: DataFrame, k: int, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), tie).limit(k)


def nsmallest(df: DataFrame, k: int, column: str, tie: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), tie).limit(k)


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """First n rows in a stated order; null means all. A negative n is refused."""
    if n is None:
        return df.orderBy(*order)
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    return df.orderBy(*order).limit(n)


def top_failures(failed: DataFrame, k: int = 5, cut: int = 180) -> DataFrame:
    return (
        failed.orderBy("timestamp", "sample_id", "step_id", "model_id", "repeat_idx")
        .limit(k)
        .withColumn("output_excerpt", F.left(F.coalesce("output_text", F.lit("")), F.lit(cut)))
    )


def min_max_scale(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``{scaled: source}`` columns in [0, 1]; a constant column scales to 0 and nulls stay null.

    The fit is a one-row scalar subquery: no join, and no window over the whole table.
    """
    fit = df.agg(F.struct(*[
        f(F.col(src).cast("double")).alias(f"{tag}{i}")
        for i, src in enumerate(columns.values()) for tag, f in (("lo", F.min), ("hi", F.max))
    ]).alias("fit")).scalar()
    scaled = {}
    for i, (out, src) in enumerate(columns.items()):
        lo, span = fit[f"lo{i}"], fit[f"hi{i}"] - fit[f"lo{i}"]
        x = F.col(src).cast("double")
        scaled[out] = F.when(x.isNotNull(), F.when(span == 0, F.lit(0.0)).otherwise((x - lo) / span))
    return df.withColumns(scaled)


def weighted(parts: dict[str, float]) -> Column:
    total = None
    for name, weight in parts.items():
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return total


def latest_per_key(df: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """Newest row per key. ``max_by`` combines on the map side, so a much repeated key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*newest_first)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_names(df: DataFrame, key: str, name: str, k: int, out: str) -> DataFrame:
    """First k distinct names per key in order, joined with a comma.

    Names are de-duplicated first and cut to k by a ranked window, which Spark limits before its shuffle;
    only k names per key are ever put together.
    """
    ranked = (
        df.where(F.col(name).isNotNull()).select(key, name).distinct()
        .withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(name)))
        .where(F.col("_rn") <= k)
    )
    joined = F.array_join(F.array_sort(F.collect_list(name)), ", ")
    return ranked.groupBy(key).agg(joined.alias(out))


def ordered_children(df: DataFrame, key: str, name: str, order: list[str], out: str) -> DataFrame:
    """Child names in order as a list column."""
    row = F.struct(*[F.col(c) for c in order], F.col(name).alias("_name"))
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["_name"]).alias(out))


def last_progress(lines: DataFrame, keys: list[str], default_total: int = 589) -> DataFrame:
    """Last progress record of each log, with counts of good and failed lines.

    ``lines`` has ``line`` and an increasing ``line_no`` (and the keys).
    """
    rows = lines.withColumn("_p", progress_fields(F.col("line")))
    line = F.col("line")
    last = F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("line_no")))
    out = rows.groupBy(*keys).agg(
        last.alias("_last"),
        F.count_if(line.contains("成分股=") & ~line.contains("失败")).alias("success"),
        F.count_if(line.contains("失败")).alias("fail"),
    )
    current = F.coalesce("_last.current", F.lit(0))
    total = F.coalesce("_last.total", F.lit(default_total))
    return out.select(
        *keys,
        current.alias("current"),
        total.alias("total"),
        F.coalesce("_last.name", F.lit("")).alias("latest_plate"),
        F.coalesce("_last.stock_count", F.lit(0)).alias("stock_count"),
        "success",
        "fail",
        F.round(current / F.nullif(total, F.lit(0)) * 100, 1).alias("percent"),
    )


def with_eta(progress: DataFrame, elapsed_seconds: Column) -> DataFrame:
    return progress.withColumn("eta", eta_text(elapsed_seconds, F.col("current"), F.col("total")))
