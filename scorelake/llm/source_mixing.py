"""Temperature mixing of sources, realised as budgeted block permutations.

A source's natural share of tokens is raised to an exponent and the results are normalised to weights. The exponent is bisected:
the largest one whose weights reach the target entropy (a share of the natural-to-uniform range), then raised as far as
needed until no source is repeated more often than the limit. Every bisection step is one small aggregate over the stored source table;
four steps are taken per job. Budgets are weight times total. Documents are dealt into 256 blocks a source by hash; a pass takes the
blocks of its source in a keyed random order, another order for each pass, and the last pass ends inside one block. That
cut is found through sums of 4,096 finer hash ranges of that block only, and then through single documents of one range. So every
window holds a bounded number of rows, whatever the size of a source.

Defined cases: null sources are one source of their own. Null and empty texts have no tokens and go with their block. Rows without
an id are dealt by the hash of their text; repeated rows lie at the same place and are taken together. A source without tokens
gets no weight and none of its documents. A document that would pass the end of a budget is left out, so no
source is over its budget. With one source, or none, the exponent is 1. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, fresh, quoted, stored, text_of

BLOCKS, RANGES = 256, 4096


def place(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """A document's keyed place, 0 to 2^63 - 1, by its id, or by its text where it has none. The first 8 bits are its block, the next 12 its range."""
    own = F.xxhash64(F.lit(seed), doc_id)
    if text is not None:
        own = F.when(doc_id.isNull(), F.xxhash64(F.lit(seed), F.lit("text"), text)).otherwise(own)
    return F.call_function("shiftrightunsigned", own, F.lit(1))


def block_of(at: Column) -> Column:
    return F.call_function("shiftright", at, F.lit(55)).cast("int")


def range_of(at: Column) -> Column:
    return F.call_function("shiftright", at, F.lit(43)).bitwiseAND(F.lit(RANGES - 1)).cast("int")


def mixing_exponent(shares: DataFrame, target: float = 0.9, most_repeats: float = 4.0, budget_ratio: float = 1.0, rounds: int = 10) -> float:
    """The exponent for a stored table with the column ``share`` (positive, summing to 1).

    ``target``: 0 asks for the natural entropy, 1 for that of equal weights. ``most_repeats`` wins over ``target``; where even natural
    shares pass it (``budget_ratio`` above it), they are used.
    """
    row = shares.agg(F.count(F.lit(1)).alias("n"), F.sum(-F.col("share") * F.ln("share")).alias("h")).first()
    if row["n"] < 2:
        return 1.0
    wanted = row["h"] + target * (math.log(row["n"]) - row["h"])

    def measures(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, highest repetition) for each exponent."""
        aims = []
        for i, a in enumerate(exponents):
            power = F.exp(F.lit(a) * F.ln("share"))
            aims += [F.sum(power).alias(f"z{i}"), F.sum(power * F.lit(a) * F.ln("share")).alias(f"s{i}"), F.max(power / F.col("share")).alias(f"m{i}")]
        got = shares.agg(*aims).first()
        return [(math.log(got[f"z{i}"]) - got[f"s{i}"] / got[f"z{i}"], budget_ratio * got[f"m{i}"] / got[f"z{i}"]) for i in range(len(exponents))]

    def bisect(passes) -> float:
        """Between a good and a bad exponent, the good end; the other end is tried first."""
        good, bad = ends[passes]
        for _ in range(rounds):
            inner = [good + (bad - good) * i / 16 for i in range(1, 16)]
            fine = [passes(m) for m in measures(inner)]
            last = next((i for i, ok in enumerate(fine) if not ok), 15)
            good, bad = ([good, *inner][last], [*inner, bad][last])
        return good

    high_entropy = lambda m: m[0] >= wanted - 1e-12
    few_repeats = lambda m: m[1] <= most_repeats + 1e-9
    ends = {high_entropy: (0.0, 1.0)}
    exponent = 1.0 if target <= 0 else bisect(high_entropy)
    if few_repeats(measures([exponent])[0]) or not few_repeats(measures([1.0])[0]):
        return exponent if few_repeats(measures([exponent])[0]) else 1.0
    ends[few_repeats] = (1.0, exponent)
    return bisect(few_repeats)


def source_weights(rows: DataFrame, target: float = 0.9, most_repeats: float = 4.0, budget: float | None = None) -> DataFrame:
    """(source, tokens, share, weight, budget, exponent), stored. ``rows`` has source and n_tokens; ``budget`` defaults to all their tokens."""
    totals = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "source-tokens")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    whole = float(total if budget is None else budget)
    shares = stored(totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).coalesce(1), "source-shares")
    exponent = mixing_exponent(shares.select("share"), target, most_repeats, whole / max(total, 1))
    power = F.exp(F.lit(exponent) * F.ln("share"))
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(norm)
    return stored(shares.select("source", "tokens", "share", weight.alias("weight"), F.floor(weight * whole).alias("budget"), F.lit(exponent).alias("exponent")), "source-weights")


def block_plan(rows: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """What is drawn: (source, block, pass, opening, cut, budget), stored.

    ``opening`` is how many of the source's drawn tokens come before the block. ``cut`` is null for a whole block, else the last place taken.
    """
    blocks = stored(rows.groupBy("source", block_of(F.col("at")).alias("block")).agg(F.sum("n_tokens").alias("n")), "block-tokens")
    same = weights.select(F.col("source").alias("s2"), "tokens", "budget")
    passes = (
        blocks.join(same, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.floor(F.col("budget") / F.col("tokens")).cast("int"))))
    )
    # One source and pass has 256 blocks at most.
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed), "pass", "block"), "block")
    dealt = stored(passes.withColumn("opening", F.col("pass") * F.col("tokens") + F.sum("n").over(order) - F.col("n")).where("opening < budget"), "dealt-blocks")
    whole = dealt.where("opening + n <= budget").withColumn("cut", F.lit(None).cast("long"))
    part = dealt.where("opening + n > budget").select(F.col("source").alias("cs"), F.col("block").alias("cb"), (F.col("budget") - F.col("opening")).alias("room"))
    inside = rows.withColumn("block", block_of(F.col("at"))).join(part, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
    fine = inside.groupBy("cs", "cb", "room", range_of(F.col("at")).alias("fine")).agg(F.sum("n_tokens").alias("n"), F.max("at").alias("last"))
    upto = Window.partitionBy("cs", "cb").orderBy("fine")
    fine = stored(fine.withColumn("before", F.sum("n").over(upto) - F.col("n")), "cut-ranges")
    full = fine.where("before + n <= room").groupBy("cs", "cb").agg(F.max("last").alias("full_cut"))
    # The first range that does not fit is searched by documents; rows at one place are one step.
    edge = fine.where("before + n > room and before <= room").groupBy("cs", "cb", "room").agg(F.min(F.struct("fine", "before")).alias("edge"))
    edge = edge.select(F.col("cs").alias("es"), F.col("cb").alias("eb"), F.col("edge.fine").alias("ef"), (F.col("room") - F.col("edge.before")).alias("left"))
    at_edge = (
        rows.withColumn("block", block_of(F.col("at"))).withColumn("fine", range_of(F.col("at")))
        .join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")) & (F.col("fine") == F.col("ef")))
        .groupBy("es", "eb", "left", "at").agg(F.sum("n_tokens").alias("n"))
        .withColumn("taken", F.sum("n").over(Window.partitionBy("es", "eb").orderBy("at"))).where("taken <= left")
        .groupBy("es", "eb").agg(F.max("at").alias("edge_cut"))
    )
    cuts = dealt.where("opening + n > budget").join(full, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")), "left").drop("cs", "cb").join(
        at_edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("block") == F.col("eb")), "left").drop("es", "eb")
    cuts = cuts.withColumn("cut", F.greatest("full_cut", "edge_cut")).where("cut is not null").drop("full_cut", "edge_cut")
    return stored(whole.unionByName(cuts).select("source", "block", "pass", "opening", "cut", "budget").coalesce(1), "block-plan")


def token_rows(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, at), stored; a token is a run of anything but ASCII white space."""
    return stored(docs.select(
        col("doc_id").alias("doc_id"), col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"), place(col("doc_id"), seed, text_of()).alias("at")), "doc-tokens")


def drawn(placed: DataFrame, plan: DataFrame, source: str, at: str) -> DataFrame:
    """``placed`` joined with its draws: one row for each pass that takes it, with ``_pass``, ``_opening`` and ``_budget`` of its block.
    A stored plan of small size is broadcast by Spark; the block in the key spreads a dominant source in any case."""
    steps = plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("pass").alias("_pass"), F.col("opening").alias("_opening"), F.col("cut").alias("_cut"), F.col("budget").alias("_budget"))
    hit = col(source).cast("string").eqNullSafe(F.col("_s")) & (block_of(F.col(at)) == F.col("_b"))
    return placed.join(steps, hit).where(F.col("_cut").isNull() | (F.col(at) <= F.col("_cut"))).drop("_s", "_b", "_cut")


def mixed(docs: DataFrame, target: float = 0.9, most_repeats: float = 4.0, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The documents drawn: a row for each time a document is taken, with the columns of ``docs``."""
    rows = token_rows(docs, seed)
    plan = block_plan(rows, source_weights(rows, target, most_repeats, budget), seed)
    at = fresh(docs, "place")
    return drawn(docs.withColumn(at, place(col("doc_id"), seed, text_of())), plan, "source", at).select(*map(quoted, docs.columns))


def mixing_query(docs: DataFrame, seed: int = 17) -> DataFrame:
    """A row per draw; ordering by ``mix_key`` interleaves the sources in proportion to their weights."""
    rows = token_rows(docs, seed)
    weights = source_weights(rows)
    plan = block_plan(rows, weights, seed)
    slim = weights.select(F.col("source").alias("_ws"), F.col("weight").alias("source_weight"), "exponent")
    return drawn(rows, plan, "source", "at").join(slim, F.col("source").eqNullSafe(F.col("_ws"))).select(
        "doc_id", "source", F.col("_pass").cast("long").alias("pass"), block_of(F.col("at")).cast("long").alias("block"), "n_tokens",
        (F.col("_opening") / F.col("_budget")).alias("mix_key"), "source_weight", "exponent")
