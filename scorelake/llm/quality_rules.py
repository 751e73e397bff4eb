"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

A document is measured by Spark expressions in its own row. Base rules with fixed cutoffs reject it outright. The other
measures are compared with fences that each (lang, source) group sets for itself: a sketch of a measure is a table of counts
in log-linear buckets (exact below 32, then 32 buckets to a doubling, so values are known to one part in 32). Sketches
merge by adding counts, so a group with too few documents uses the merged sketch of its language, and a language with too few
that of all documents. The fences stand ``reach`` times the quartile distance, and a least slack, outside the quartiles.

Defined cases: a null or empty text has no words, so the base rule rejects it. Null languages and sources are groups of their
own. Repeated rows are measured and decided each for itself and weigh as often as they occur. An empty table gives an empty
table. Columns that are not read are passed on; nothing is joined by ``doc_id``, which may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import bucket_floor, bucket_of, col, fresh, merge_beyond, quoted, stored, text_of

# Measure: (value in thousandths, least slack below the lower quartile or None for no lower fence, least slack above).
RATES: dict[str, tuple[str, int | None, int]] = {
    "word_length": ("1000 * word_chars div n_words", 1500, 2500),
    "symbols": ("1000 * n_symbols div n_words", None, 150),
    "capitals": ("1000 * n_capitals div n_words", None, 600),
    "dup_lines": ("1000 * n_dup_lines div n_lines", None, 300),
    "repeats": ("1000 * n_repeat_words div n_words", None, 160),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Windows of five words as hashes of hashes; equal ones are found by sorting, only where some are equal.
_MEASURE = r"""
element_at(transform(array(array_remove(split({t}, r'[\x20\x09-\x0D]+'), '')), w ->
  element_at(transform(array(filter(split({t}, r'\n'), l -> l rlike r'[^\x20\x09-\x0D]')), ls -> named_struct(
    'n_words', cast(size(w) as bigint),
    'word_chars', cast(char_length(array_join(w, '')) as bigint),
    'n_symbols', cast(regexp_count({t}, r'[#*$%&|<>]') as bigint),
    'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint),
    'n_repeat_words', if(size(w) < 5, 0L, element_at(transform(array(transform(w, x -> xxhash64(x))), h ->
      element_at(transform(array(transform(sequence(1, size(h) - 4), i -> xxhash64(slice(h, i, 5)))), g ->
        if(size(array_distinct(g)) = size(g), 0L,
          element_at(transform(array(array_sort(transform(g, (x, i) -> named_struct('x', x, 'i', i)))), p ->
            aggregate(array_sort(transform(filter(p, (s, k) -> s.x <=> get(p, k - 1).x or s.x <=> get(p, k + 1).x), s -> s.i)),
              named_struct('end', 0, 'total', 0L),
              (acc, i) -> named_struct('end', i + 5, 'total', acc.total + cast(i + 5 - greatest(acc.end, i) as bigint)),
              acc -> acc.total)), 1))), 1)), 1)),
    'n_lines', cast(size(ls) as bigint),
    'n_capitals', cast(regexp_count({t}, r'\p{{Lu}}') as bigint))), 1)), 1)
"""


def measured(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with one more column, a struct of the measures of ``text``; ``name`` must be free."""
    whole = fresh(docs, "whole")
    struct = F.expr(_MEASURE.format(t=quoted(whole)))
    return docs.withColumn(whole, text_of(text)).withColumn(name, struct).drop(whole)


def base_failed(q: str = "quality", least_words: int = 10, most_repeats: int = 20) -> Column:
    return F.expr(f"{q}.n_words < {least_words} or 100 * {q}.n_repeat_words > {most_repeats} * {q}.n_words")


def rates(q: str = "quality") -> dict[str, Column]:
    """The compared measures in thousandths; the base rule must have passed, so there are words and lines."""
    out = {}
    for name, (form, _, _) in RATES.items():
        for field in (*BASE, "n_lines", "n_capitals"):
            form = form.replace(f" {field} ", f" {q}.{field} ").replace(f"div {field}", f"div {q}.{field}")
        out[name] = F.expr(form)
    return out


def sketches(measured_docs: DataFrame, q: str = "quality", lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: documents per group, measure and bucket. Counts are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), bucket_of(v).alias("bucket")) for n, v in rates(q).items()])
    return (
        measured_docs.where(~base_failed(q))
        .select(col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"), F.explode(pairs).alias("pair"))
        .groupBy("lang", "source", F.col("pair.measure").alias("measure"), F.col("pair.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups: counts are added."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("docs").alias("docs"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Documents and quartiles per group and measure. A group's window holds its buckets, some hundreds at most."""
    each = Window.partitionBy(*keys, "measure")
    seen = sketch.withColumn("upto", F.sum("docs").over(each.orderBy("bucket"))).withColumn("n", F.sum("docs").over(each))
    at = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("n") * share, F.col("bucket")))
    return (
        seen.groupBy(*keys, "measure").agg(F.max("n").alias("n"), at(1).alias("b1"), at(3).alias("b3"))
        .select(*keys, "measure", "n", bucket_floor(F.col("b1")).alias("q1"), bucket_floor(F.col("b3")).alias("q3"))
    )


def fences(sketch: DataFrame, least_docs: int = 50, reach: int = 3) -> DataFrame:
    """One row per (lang, source) with ``<measure>_lo`` and ``<measure>_hi``; the sketch should be stored, it is read three times."""
    own = quartiles(sketch, "lang", "source")
    by_lang = quartiles(merged(sketch, "lang"), "lang").select(
        F.col("lang").alias("lang2"), F.col("measure").alias("m2"), F.col("n").alias("n2"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    overall = quartiles(merged(sketch)).select(F.col("measure").alias("m3"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    rows = (
        own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("m2")))
        .join(overall, F.col("measure") == F.col("m3"))
    )
    pick = lambda a, b, c: F.when(F.col("n") >= least_docs, F.col(a)).when(F.col("n2") >= least_docs, F.col(b)).otherwise(F.col(c))
    rows = rows.select("lang", "source", "measure", pick("q1", "l1", "a1").alias("q1"), pick("q3", "l3", "a3").alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * reach
    out = []
    for name, (_, below, above) in RATES.items():
        mine = lambda v, name=name: F.max(F.when(F.col("measure") == name, v))
        if below is not None:
            out.append(mine(F.col("q1") - F.greatest(spread, F.lit(below))).alias(f"{name}_lo"))
        out.append(mine(F.col("q3") + F.greatest(spread, F.lit(above))).alias(f"{name}_hi"))
    return rows.groupBy("lang", "source").agg(*out)


def judged(measured_docs: DataFrame, fence: DataFrame, q: str = "quality", name: str = "kept", lang: str = "lang", source: str = "source", salts: int = 32) -> DataFrame:
    """``measured_docs`` with the verdict in ``name``. A stored fence table of few rows, counted with their salts, is broadcast by Spark; beyond that
    the join is an ordinary one, on a salt besides the group, so that a dominant group is spread over ``salts`` tasks."""
    salt, packed = fresh(measured_docs, "salt"), fresh(measured_docs, "fence")
    limits = fence.select(
        F.col("lang").alias("_fence_lang"), F.col("source").alias("_fence_source"), F.struct(*[c for c in fence.columns if c not in ("lang", "source")]).alias(packed),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_fence_salt"))
    left = measured_docs.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"{q}.{f}") for f in BASE]), F.lit(salts)).cast("int"))
    joined = left.join(
        merge_beyond(limits),
        col(lang).cast("string").eqNullSafe(F.col("_fence_lang")) & col(source).cast("string").eqNullSafe(F.col("_fence_source")) & (F.col(salt) == F.col("_fence_salt")), "left")
    within = F.lit(True)
    for measure, value in rates(q).items():
        if RATES[measure][1] is not None:
            within = within & (value >= F.col(f"{packed}.{measure}_lo"))
        within = within & (value <= F.col(f"{packed}.{measure}_hi"))
    verdict = F.when(base_failed(q), F.lit(False)).otherwise(F.coalesce(within, F.lit(True)))
    return joined.withColumn(name, verdict).drop(salt, packed, "_fence_lang", "_fence_source", "_fence_salt")


def adaptive_filter(docs: DataFrame, name: str = "kept", q: str = "quality", least_docs: int = 50, reach: int = 3) -> DataFrame:
    """``docs`` with their measures (``q``) and verdicts (``name``). The measured rows are stored, so texts are read once and never shuffled."""
    rows = stored(measured(docs, name=q), "quality-rows")
    sketch = stored(sketches(rows, q), "quality-sketch")
    limits = stored(fences(sketch, least_docs, reach).coalesce(1), "quality-fences")
    return judged(rows, limits, q, name)


def quality_stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    q, kept = fresh(docs, "quality"), fresh(docs, "kept")
    return adaptive_filter(docs, kept, q).where(F.col(kept)).select(*map(quoted, docs.columns))


def quality_query(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    rows = stored(measured(slim).drop("text"), "quality-rows")
    sketch = stored(sketches(rows), "quality-sketch")
    limits = stored(fences(sketch).coalesce(1), "quality-fences")
    return judged(rows, limits).select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in BASE], base_failed().alias("base_failed"), "kept")
