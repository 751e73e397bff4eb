"""Concept-plate reports and the evaluation sets built from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.text import clip, strip_html, strip_ws
from scorelake.operators.aggregates import crosstab_long, distinct_counts, group_sizes
from scorelake.operators.checks import (
    CORE_FLAG, INTRO_LEN, INTRO_QUESTION, MAX_CORE, MIN_CORE, core_only, drop_nulls, long_enough,
)
from scorelake.operators.grid import name_join
from scorelake.operators.projections import convert_news
from scorelake.operators.ranking import first_names, first_per_key, min_max_scale, nlargest, ordered_children, weighted
from scorelake.sources.readers import select_news


def core_counts(plates: DataFrame, stocks: DataFrame, lo: int | None = MIN_CORE, hi: int | None = MAX_CORE) -> DataFrame:
    """Core and total stocks per plate. Stocks are counted before the join, so a huge plate arrives as one row."""
    per_plate = stocks.groupBy(F.col("plate_id").alias("id")).agg(
        F.count_if(F.col("core_flag") == CORE_FLAG).alias("core_count"), F.count("symbol").alias("total_count")
    )
    out = plates.select("id", "name", "desc").join(per_plate, "id", "left").na.fill(0, ["core_count", "total_count"])
    return out if lo is None else out.where(F.col("core_count").between(lo, hi))


def plate_intros(answers: DataFrame) -> DataFrame:
    """One intro per plate as plain text, cut to its length limit; blank ones are null."""
    intro = answers.where(F.col("question") == INTRO_QUESTION).select("plate_id", "html_answer")
    first = first_per_key(intro, ["plate_id"], F.col("html_answer"))
    return first.select("plate_id", F.nullif(strip_html(F.col("html_answer"), INTRO_LEN), F.lit("")).alias("plate_intro"))


def association_set(plates: DataFrame, stocks: DataFrame, chains: DataFrame, answers: DataFrame) -> DataFrame:
    """Evaluation samples: plates with 5 to 50 core stocks and a long enough description.

    Children are cut to the kept plates before they are put into lists, so a list of stocks has at most the
    upper bound of items.
    """
    kept = core_counts(plates, stocks).where(long_enough(F.col("desc"))).withColumnRenamed("id", "plate_id")
    ids = kept.select("plate_id")
    core = ordered_children(core_only(stocks).join(ids, "plate_id", "left_semi"), "plate_id", "symbol", ["symbol"], "gt_stocks")
    steps = ordered_children(chains.join(ids, "plate_id", "left_semi"), "plate_id", "name", ["order", "chain_id"], "chains")
    empty = F.array().cast("array<string>")
    return (
        kept.join(core, "plate_id", "left").join(steps, "plate_id", "left")
        .join(plate_intros(answers), "plate_id", "left")
        .select(
            F.concat(F.lit("SA_"), F.col("plate_id").cast("string")).alias("sample_id"),
            F.col("name").alias("plate_name"),
            strip_ws(F.col("desc")).alias("plate_desc"),
            F.coalesce("chains", empty).alias("chains"),
            F.coalesce(F.size("gt_stocks"), F.lit(0)).alias("core_stocks_count"),
            F.coalesce("gt_stocks", empty).alias("gt_stocks"),
            "plate_intro",
        )
    )


def skipped_plates(plates: DataFrame, stocks: DataFrame) -> DataFrame:
    short = core_counts(plates, stocks).where(~long_enough(F.col("desc")))
    return short.agg(F.count("*").alias("skipped"))


def news_set(news: DataFrame, max_rows: int | None = None) -> DataFrame:
    return convert_news(select_news(news, max_rows))


def heat_scores(derived: DataFrame) -> DataFrame:
    """Fund flow 40 %, share of rising stocks 35 %, core stocks 25 %, each scaled over plates that have all three."""
    cols = ["fund_flow_yi", "rise_ratio", "core_stocks_count"]
    rows = drop_nulls(derived.select("id", "name", *cols), "id", "name", *cols)
    scaled = min_max_scale(rows, {"s_fund": cols[0], "s_rise": cols[1], "s_core": cols[2]})
    return scaled.withColumn("heat_score", weighted({"s_fund": 0.4, "s_rise": 0.35, "s_core": 0.25}))


def core_pairs(stocks: DataFrame, derived: DataFrame) -> DataFrame:
    """Core stocks with what the leader reports need of their plates. Stored once, it serves measures, scaling and names."""
    return name_join(core_only(stocks).select("plate_id", "symbol"), derived, ["name", "avg_pcp_pct", "fund_flow_yi"])


def leader_measures(pairs: DataFrame) -> DataFrame:
    """Per core stock: plates, mean change and summed flow."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)"))
    return pairs.groupBy("symbol").agg(
        F.countDistinct("plate_id").alias("plate_count"),
        (exact("avg_pcp_pct").cast("double") / F.nullif(F.count("avg_pcp_pct"), F.lit(0))).alias("avg_plate_pcp"),
        F.coalesce(exact("fund_flow_yi").cast("double"), F.lit(0.0)).alias("total_fund_flow"),
    )


def with_plate_names(picked: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """Add the first plate names of the given stocks; other stocks' names are not looked at."""
    mine = pairs.join(picked.select("symbol"), "symbol", "left_semi")
    return picked.join(first_names(mine, "symbol", "name", k, "plates"), "symbol", "left")


def leader_scores(measures: DataFrame) -> DataFrame:
    """Stored measures scaled over all core stocks, and the weighted score."""
    scaled = min_max_scale(measures, {"s_cross": "plate_count", "s_pcp": "avg_plate_pcp", "s_fund": "total_fund_flow"})
    return scaled.withColumn("leader_score", weighted({"s_cross": 0.3, "s_pcp": 0.4, "s_fund": 0.3}))


def core_vs_all(derived: DataFrame) -> DataFrame:
    rows = drop_nulls(derived, "avg_pcp_pct", "core_avg_pcp_pct")
    return rows.select(
        "id", "avg_pcp_pct", "core_avg_pcp_pct", "fund_flow_yi", clip(F.col("total_stocks"), 5, 200).alias("marker_size")
    )


def plates_per_stock(stocks: DataFrame) -> DataFrame:
    return distinct_counts(stocks, ["symbol"], {"plate_count": "plate_id"})


def core_matrix(stocks: DataFrame, plates: DataFrame, k: int = 20) -> DataFrame:
    """Counts of the top core stocks against the top plates, long form, 0 filled.

    Pairs are counted once; both rankings and the matrix are read from the counted pairs.
    """
    rows = name_join(core_only(stocks).select("plate_id", "symbol"), plates, ["name"]).where(F.col("name").isNotNull())
    pairs = group_sizes(rows, ["symbol", "name"], "n")
    top_symbols = nlargest(pairs.groupBy("symbol").agg(F.count("*").alias("names")), k, "names", "symbol").select("symbol")
    top_names = nlargest(pairs.groupBy("name").agg(F.sum("n").alias("rows")), k, "rows", "name").select("name")
    cut = pairs.join(top_symbols, "symbol", "left_semi").join(top_names, "name", "left_semi")
    return crosstab_long(cut, "symbol", "name")


def chains_per_plate(chains: DataFrame, plates: DataFrame) -> DataFrame:
    named = name_join(chains.select("plate_id"), plates, ["name"]).where(F.col("name").isNotNull())
    return group_sizes(named, ["plate_id", "name"], "chain_count")


def chain_detail(chains: DataFrame, plates: DataFrame, k: int = 5) -> DataFrame:
    """Chain names of the plates with most chains; only their chains are put together."""
    top = nlargest(chains_per_plate(chains, plates), k, "chain_count", "plate_id")
    names = ordered_children(chains.join(top.select("plate_id"), "plate_id", "left_semi"), "plate_id", "name", ["order", "chain_id"], "_n")
    return top.join(names, "plate_id", "left").select(
        "plate_id", "name", "chain_count", F.array_join("_n", ", ").alias("chain_names")
    )


PLATE_SUMMARY = [
    "id", "name", "desc", "avg_pcp_pct", "core_avg_pcp_pct", "fund_flow_yi", "rise_count", "fall_count",
    "stay_count", "total_stocks", "core_stocks_count", "rise_ratio", "updated_at",
]


def plate_summary(derived: DataFrame) -> DataFrame:
    return derived.select(*PLATE_SUMMARY).orderBy(F.desc_nulls_last("fund_flow_yi"), "id")
