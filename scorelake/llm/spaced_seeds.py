"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

Tokens are the lower-cased runs of letters and digits. A mask is a fixed row of ones and zeros; laid at a token position it hashes the
tokens under its ones and ignores those under its zeros, so a substituted word under a zero does not hide a copy. The
seeds of all benchmark items are joined with those of every position of every document. A hit fixes a diagonal (document
position less item position). Around the hits the tokens of document and item are compared along the diagonal, and the
overlap counts if some ``window`` item tokens in a row, or the whole of a shorter item, agree in at least ``share`` of their places.

Document seeds are made, probed and dropped within one stage: the distinct benchmark seeds are broadcast if their stored row count is at most
``most_broadcast``; above it the same join is left to Spark. Only hits are shuffled. Texts are read again for the documents
with hits only.

No accepted overlap is without a hit: the masks of a full window are tested against every choice of places that may differ. Items
shorter than the window are seeded by blocks, down to whole items of four or three tokens. Items of one or two tokens are words, not passages, and are
not searched.

Defined cases: null and empty texts have no seeds. Rows without a ``doc_id`` or ``item_id`` cannot be reported and are not searched. Repeated documents or items give the same
result as one. An item that agrees in several places is reported once, at its best place (most equal tokens, then the first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import col, merge_beyond, quoted, stored, text_of

# Every way in which 13 of 16 places agree leaves one of these whole: eight tokens each.
WIDE = (
    "111010010111", "110110111001", "101100111011", "11111111", "1101011001011", "11110001111",
    "1110010001111", "11001101111", "111101111",
)
MASKS = (*WIDE, "1111", "111", "11")
LEAST_ITEM = 3


def masks_for(span: int, share: float) -> tuple[str, ...]:
    """Masks of which every accepted pattern of ``span`` places leaves one whole: where n places may differ, one of n + 1 blocks is equal."""
    differ = max(k for k in range(span + 1) if span - k >= span * share)
    return WIDE if span == 16 and differ <= 3 else ("1" * (span // (differ + 1)),)


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t))


def seeds(df: DataFrame, tokens: str, masks: tuple[str, ...] = MASKS, when: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a row per position ``at`` and mask whose span fits, and its ``seed``. ``tokens`` is an array column; ``when`` has conditions of masks."""
    keys = []
    for mask in masks:
        ones = ", ".join(f"get({tokens}, at + {i})" for i, bit in enumerate(mask) if bit == "1")
        keys.append(f"if(at + {len(mask)} <= n_tokens and {(when or {}).get(mask, 'true')}, xxhash64('{mask}', {ones}), null)")
    short = min(len(m) for m in masks)
    placed = (
        df.withColumn("n_tokens", F.size(tokens)).where(F.col("n_tokens") >= short)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - short)))
    )
    return placed.withColumn("seed", F.explode(F.expr(f"array({', '.join(keys)})"))).where("seed is not null")


def overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] | None = None, window: int = 16, share: float = 0.8, most_broadcast: int = 2_000_000,
) -> DataFrame:
    """(doc_id, item_id, doc_start, doc_end, n_equal, n_compared) of each contaminated document and item, in token positions."""
    items = stored(
        benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), token_hashes(text_of()).alias("item_tokens"))
        .where(f"size(item_tokens) >= {LEAST_ITEM}").dropDuplicates(["item_id", "item_tokens"]), "benchmark-tokens")
    when = {}
    if masks is None:
        # Masks by the number of places that must agree; short ones are laid only if there are items that need them.
        present = items.select(F.least(F.lit(window), F.size("item_tokens")).alias("span")).distinct().collect()
        spans = {}
        for span in sorted({row["span"] for row in present} or {window}):
            for mask in masks_for(span, share):
                spans.setdefault(mask, []).append(str(span))
        masks, when = tuple(spans), {mask: f"least({window}, n_tokens) in ({', '.join(of)})" for mask, of in spans.items()}
    item_seeds = stored(seeds(items, "item_tokens", masks, when).select("seed", "item_id", F.col("at").alias("item_at")).distinct(), "benchmark-seeds")
    keys = stored(item_seeds.select("seed").distinct(), "benchmark-keys")
    if keys.count() <= most_broadcast:
        keys = F.broadcast(keys)
    named = docs.where(col("doc_id").isNotNull()).select(col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tokens = named.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    probed = seeds(tokens, "tokens", masks).select("doc_id", "at", "seed").join(keys, "seed", "left_semi")
    hits = probed.join(item_seeds, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = merge_beyond(stored(hits, "seed-hits"))
    # Hits are few beside the texts: their documents are picked before tokens are made again.
    searched = named.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = (
        searched.select("doc_id", token_hashes(F.col("text")).alias("tokens")).join(hits, "doc_id").join(items, "item_id")
        .withColumn("lo", F.expr("greatest(0, -diagonal)")).withColumn("hi", F.expr("least(size(item_tokens), size(tokens) - diagonal)"))
        .withColumn("span", F.expr(f"least({window}, size(item_tokens))")).where("hi - lo >= span")
    )
    same = pairs.withColumn("same", F.expr("transform(sequence(lo, hi - 1), j -> if(get(tokens, diagonal + j) = get(item_tokens, j), 1, 0))"))
    runs = same.withColumn("runs", F.expr(
        "transform(sequence(1, size(same) - span + 1), s -> named_struct('n', aggregate(slice(same, s, span), 0, (a, x) -> a + x), 'back', -s))"))
    best = runs.withColumn("best", F.expr("array_max(runs)")).where(F.col("best.n") >= F.col("span") * share)
    found = best.select(
        "doc_id", "item_id", F.struct(
            F.col("best.n").alias("n_equal"), F.expr("-(diagonal + lo - best.back - 1)").alias("back"), F.col("span").alias("n_compared")).alias("place"))
    return found.groupBy("doc_id", "item_id").agg(F.max("place").alias("place")).select(
        "doc_id", "item_id", (-F.col("place.back")).cast("long").alias("doc_start"), (F.col("place.n_compared") - F.col("place.back")).cast("long").alias("doc_end"),
        F.col("place.n_equal").cast("long").alias("n_equal"), F.col("place.n_compared").cast("long").alias("n_compared"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no passage with the benchmark. Rows without an id stay."""
    hit = stored(overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("_hit_id")).distinct(), "contaminated")
    return docs.join(merge_beyond(hit), col("doc_id").cast("long") == F.col("_hit_id"), "left_anti").select(*map(quoted, docs.columns))


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs, benchmark)
