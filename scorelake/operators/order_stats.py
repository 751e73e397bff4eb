"""Exact order statistics by rank, without gathering a group in one task.

Values are first counted per distinct value (map-side combined). Each value falls into a bucket that grows
with it; a small per-bucket count tells which bucket holds a wanted rank. That bucket is cut again into parts of
equal width between its own least and greatest value, and only the part that holds the rank is put in order.
So a group holding most of the rows is spread out, whether its values lie far apart or close together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rank = Callable[[Column], Column]

# Buckets per doubling of the value, and parts of a bucket that holds a wanted rank.
_STEPS = 128
_PARTS = 4096


def nearest_rank(q: str) -> Rank:
    """1-based index ``ceil(q*n)``; ``q`` is decimal text so that e.g. .95*20 stays exactly 19."""
    return lambda n: F.greatest(F.lit(1), F.ceil(F.lit(q).cast("decimal(6,4)") * n.cast("decimal(20,0)")).cast("bigint"))


def floor_rank(q: str) -> Rank:
    """1-based index of ``sorted[min(int(q*n), n-1)]``."""
    return lambda n: F.least(n, F.floor(F.lit(q).cast("decimal(6,4)") * n.cast("decimal(20,0)")).cast("bigint") + 1)


def upper_median(n: Column) -> Column:
    return F.floor(n / 2).cast("bigint") + 1


def median_low(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("bigint")


def median_high(n: Column) -> Column:
    return F.floor((n + 2) / 2).cast("bigint")


def _bucket(v: Column) -> Column:
    steps = F.floor(F.log2(F.abs(v) * 1024.0 + 1.0) * _STEPS)
    return F.when(v < 0, -steps).otherwise(steps)


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Part of a bucket, in the order of the values; one part where the bucket has one value."""
    share = F.coalesce((v - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    return F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1)).cast("int")


def values_at_ranks(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, Rank]]) -> DataFrame:
    """Per key, the value at each wanted rank of its non-null values: ``{out: (value, rank of n)}``.

    A null key, and a key without any value, has no row.
    """
    sources: dict[str, str] = {}
    pairs, targets = [], []
    for out, (value, rank) in wanted.items():
        tag = sources.setdefault(str(value), f"v{len(sources)}")
        if f"'{tag}'" not in "".join(p[0] for p in pairs):
            pairs.append((f"'{tag}'", F.struct(F.lit(tag).alias("_m"), value.cast("double").alias("_v"))))
        targets.append((tag, out, rank))
    items = [p[1] for p in pairs]
    long = (
        df.select(*keys, items[0].alias("_x")) if len(items) == 1
        else df.select(*keys, F.explode(F.array(*items)).alias("_x"))
    ).select(*keys, "_x._m", "_x._v").where("_v is not null")
    # The join below would infer the same conditions for its own copy of the counts only; stated here, both
    # readers have one plan and share one shuffle.
    for key in keys:
        long = long.where(F.col(key).isNotNull())
    counts = (
        long.groupBy(*keys, "_m", "_v").agg(F.count("*").alias("_c")).withColumn("_b", _bucket(F.col("_v")))
        .where("_b is not null and _m is not null")
    )
    group = [*keys, "_m"]
    by_bucket = counts.groupBy(*group, "_b").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = Window.partitionBy(*group)
    running = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = by_bucket.withColumn("_upto", F.sum("_bc").over(running)).withColumn("_n", F.sum("_bc").over(whole))
    ranks = F.array(*[
        F.struct(F.lit(tag).alias("tag"), F.lit(out).alias("out"), rank(F.col("_n")).cast("bigint").alias("rank"))
        for tag, out, rank in targets
    ])
    hits = (
        placed.withColumn("_t", F.explode(ranks))
        .where("_t.tag = _m and _t.rank <= _upto and _t.rank > _upto - _bc")
        .select(*group, "_b", "_lo", "_hi", F.col("_t.out").alias("_out"), (F.col("_t.rank") - (F.col("_upto") - F.col("_bc"))).alias("_r"))
    )
    inside_bucket = counts.join(hits, [*group, "_b"]).withColumn("_p", _part(F.col("_v"), F.col("_lo"), F.col("_hi")))
    cut = [*group, "_b", "_out"]
    by_part = inside_bucket.groupBy(*cut, "_p", "_r").agg(F.sum("_c").alias("_pc"))
    upto = F.sum("_pc").over(Window.partitionBy(*cut).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part_hits = by_part.withColumn("_pu", upto).where("_r <= _pu and _r > _pu - _pc").select(
        *cut, "_p", (F.col("_r") - (F.col("_pu") - F.col("_pc"))).alias("_pr"))
    inside = Window.partitionBy(*cut, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        inside_bucket.join(part_hits, [*cut, "_p"])
        .withColumn("_seen", F.sum("_c").over(inside))
        .where("_seen >= _pr and _seen - _c < _pr")
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_out") == out, F.col("_v"))).alias(out) for _, out, _ in targets]
    )


# Buckets per doubling of the value in a mergeable sketch: neighbouring values of one bucket differ by at most one part in 32.
_SKETCH_BITS = 5


def sketch_bucket(value: Column) -> Column:
    """Log-linear bucket of a number to three digits after the point, growing with the number; null without a value.

    Buckets of separate rows are counted apart and the counts added, so the sketch of a whole is the sum of its parts'. Whole-number
    steps only: the bucket is the same on every machine.
    """
    units = F.floor(F.abs(value) * 1000)
    top = F.length(F.bin(units)) - 1
    fine = F.call_function("shiftright", units, F.greatest(top - _SKETCH_BITS, F.lit(0))).bitwiseAND((1 << _SKETCH_BITS) - 1)
    step = F.when(units < 1 << _SKETCH_BITS, units.cast("int")).otherwise(((top - _SKETCH_BITS + 1) * (1 << _SKETCH_BITS) + fine).cast("int"))
    return F.when(value < 0, -step - 1).otherwise(step)


def sketch_bounds(sketch: DataFrame, keys: list[str], count: str, lo: str, hi: str, rank: Rank, bucket: str = "bucket") -> DataFrame:
    """(keys, low, high): least and greatest value of the bucket that holds the value of a rank. A key's window holds its buckets only."""
    whole = Window.partitionBy(*keys)
    upto = F.sum(count).over(whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = sketch.withColumns({"_upto": upto, "_rank": rank(F.sum(count).over(whole))})
    return placed.where(f"_rank <= _upto and _rank > _upto - {count}").select(*keys, F.col(lo).alias("low"), F.col(hi).alias("high"))


def percentiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, str]) -> DataFrame:
    """Linearly interpolated percentiles ``{out: q}`` per key."""
    wanted: dict[str, tuple[Column, Rank]] = {"_count": (value, lambda n: n)}
    position = lambda q, n: F.lit(q).cast("decimal(6,4)") * (n - 1).cast("decimal(20,0)")
    for i, q in enumerate(probs.values()):
        wanted[f"_lo{i}"] = (value, lambda n, q=q: F.floor(position(q, n)).cast("bigint") + 1)
        wanted[f"_hi{i}"] = (value, lambda n, q=q: F.ceil(position(q, n)).cast("bigint") + 1)
    at = values_at_ranks(df, keys, wanted)
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    joined = at.join(n, keys) if keys else at.withColumn("_n", n.select("_n").scalar())
    outs = []
    for i, (out, q) in enumerate(probs.items()):
        pos = position(q, F.col("_n"))
        share = (pos - F.floor(pos)).cast("double")
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * share).alias(out))
    return joined.select(*keys, *outs)


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Interpolated median of several columns per key."""
    wanted: dict[str, tuple[Column, Rank]] = {}
    for out, value in values.items():
        wanted[f"_lo_{out}"] = (value, median_low)
        wanted[f"_hi_{out}"] = (value, median_high)
    at = values_at_ranks(df, keys, wanted)
    return at.select(*keys, *[((F.col(f"_lo_{o}") + F.col(f"_hi_{o}")) / 2).alias(o) for o in values])


def join_on_keys(frames: list[DataFrame], keys: list[str], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)
