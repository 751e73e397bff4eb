"""SimHash near-duplicate groups by segment popcounts, a grid range-join, and exact verification.

A fingerprint (64 bits) has a bit set where more than half of the text's shingle hashes have it. Its embedding cuts each half of
32 bits into 16 segments of two bits and keeps how many are set (0 to 2). The Manhattan distance of two embeddings is a lower
bound of the fingerprints' Hamming distance: one differing bit moves one count by one. Fingerprints at ``4`` differing bits or
fewer differ by two or fewer in one of the halves, so in that half their counts are at Manhattan distance two or less, and
some grid point lies within one of both. Every fingerprint is therefore put at the grid points within one of its counts
(33 a half at most), points are joined, and the pairs that meet are verified on all 64 bits. No pair is lost.

Copies are settled before: only distinct fingerprints are embedded. Dense clusters are settled before too: two
fingerprints that share a neighbour at one bit differ by two or less, so all that meet in such a neighbour (65 at most, as they are
distinct) form a star without comparison; the join keeps only pairs from different clusters. So the pairs it emits do
not grow with the square of a cluster. Components are found by contracting each node into a neighbour, the least by a hash that changes with
the round, until no link is left, with every round stored in the shared folder.

The near-duplicate stage of the pipeline (``near_dedup``) keeps one row of each component of the same groups. What is joined and compared are fingerprints
and ids; texts pass one shuffle, to the rows that stay.

Defined cases: null and empty texts and texts of white space have fingerprint zero and link like any other. A text of fewer words
than a shingle is one shingle. Repeated rows are separate rows with one class. A class is named by its least ``doc_id``;
rows without one take part but cannot name it, and a class of only such rows has a null name. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, fresh, merge_beyond, quoted, small_batches, stored, text_of

SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the shingles in their order; none for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.array([], dtype="<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1:].tolist())], dtype="<u8")


def fingerprint(text: str, words: int = 4) -> int:
    """Signed 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(words: int = 4):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", words) for t in texts], dtype="int64")

    return of


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that share a neighbour at one bit. A neighbour's group has 65 members at most."""
    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    at = nodes.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = F.min("fp").over(Window.partitionBy("point"))
    return at.select("fp", least.alias("b")).where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def grid(nodes: DataFrame) -> DataFrame:
    """Each fingerprint at the grid points within Manhattan distance one of its segment counts, for both halves."""
    halves = nodes.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).withColumn(
        "bits", F.expr("if(half = 0, fp & 4294967295L, shiftrightunsigned(fp, 32))"))
    counts = halves.withColumn("counts", F.expr("(bits & 1431655765L) + (shiftright(bits, 1) & 1431655765L)"))
    # Step 0 stays; step 2k + 1 adds one to segment k, step 2k + 2 takes one.
    steps = counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(32)))).withColumn(
        "shift", F.expr("2 * ((step - 1) div 2)")).withColumn("field", F.expr("if(step = 0, 1L, shiftright(counts, shift) & 3L)"))
    inside = steps.where("step = 0 or (step % 2 = 1 and field < 2) or (step % 2 = 0 and field > 0)")
    move = "case when step = 0 then 0L when step % 2 = 1 then shiftleft(1L, shift) else -shiftleft(1L, shift) end"
    return inside.select("fp", "cluster", F.expr(f"(counts + ({move})) * 2 + half").alias("cell"))


def close_pairs(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) of clusters that hold fingerprints at ``bits`` differing bits or fewer; nodes have ``fp`` and ``cluster``."""
    if bits > 5:
        raise ValueError("two halves and a radius of one find pairs of at most five differing bits")
    # Spark sizes the points as the nodes they are exploded from, some fifty times too low, and would broadcast them.
    points = grid(nodes).hint("merge")
    left = points.select("cell", F.col("fp").alias("f1"), F.col("cluster").alias("c1"))
    right = points.select("cell", F.col("fp").alias("f2"), F.col("cluster").alias("c2"))
    met = left.join(right, "cell").where(f"f1 < f2 and c1 <> c2 and bit_count(f1 ^ f2) <= {bits}")
    return met.select(F.greatest("c1", "c2").alias("a"), F.least("c1", "c2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being one node of the component.

    Each round maps a node to the least of itself and its neighbours, by a hash that is another one in every round, and rewrites the links; links within
    a node go. Whatever the order of the labels, about half of a chain's nodes go in a round, so the rounds grow with the logarithm of its length.
    """
    edges = stored(links.select("a", "b"), "links")
    roots, turn = None, 0
    while n_links := edges.count():
        both, turn = edges.union(edges.select("b", "a")), turn + 1
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("place"), F.col(c).alias("up"))  # noqa: E731, B023
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("least"))
        parent = stored(least.select("node", F.least("least", place("node"))["up"].alias("up")), "parents")
        known = merge_beyond(parent, 2 * n_links)
        first, second = known.toDF("a", "ua"), known.toDF("b", "ub")
        edges = stored(
            edges.join(first, "a").join(second, "b").where("ua <> ub")
            .select(F.greatest("ua", "ub").alias("a"), F.least("ua", "ub").alias("b")).distinct(), "links")
        if roots is None:
            roots = parent.select("node", F.col("up").alias("root"))
        else:
            moved = roots.join(known.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
            roots = stored(moved, "roots")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots


def near_groups(docs: DataFrame, text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = stored(docs.select(col("doc_id").cast("long").alias("doc_id"), fingerprints(words)(text_of(text)).alias("fp")), "fingerprints")
    final = fingerprint_classes(stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints"), bits)
    names = final.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(merge_beyond(final).join(names, "root").select("fp", "component_id"), "class-names")
    return rows.join(merge_beyond(named), "fp").select("doc_id", "fp", "component_id")


def fingerprint_classes(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, least, root) for every stored node (fp, least), each fingerprint once; nodes of one component have one root."""
    clusters = components(stars(nodes.select("fp")))
    placed = stored(nodes.join(merge_beyond(clusters).toDF("fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("cluster")), "clusters")
    merged = components(close_pairs(placed.select("fp", "cluster"), bits))
    final = placed.join(merge_beyond(merged).toDF("cluster", "top"), "cluster", "left").select("fp", "least", F.coalesce("top", "cluster").alias("root"))
    return stored(final, "classes")


def near_dedup(docs: DataFrame, text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row of each component: the one with the least ``doc_id`` (a row without one stays only where no row of the component has an id), of those
    the one whose text has the least hash. Rows that share an id are told apart by their texts; of rows equal in both one stays."""
    small_batches(docs.sparkSession)
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("key"))
    rows = docs.select(col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("key"), fingerprints(words)(text_of(text)).alias("fp"))
    nodes = stored(rows.groupBy("fp").agg(F.min(order).alias("least")), "distinct-fingerprints")
    keep = fingerprint_classes(nodes, bits).groupBy("root").agg(F.min("least").alias("least"))
    # Every kept key is one component's, so it is there once.
    names = [fresh(docs, n) for n in ("kept_id", "kept_key", "own_id", "own_key", "nth")]
    kept_id, kept_key, own_id, own_key, nth = map(F.col, names)
    kept = stored(keep.select(F.col("least.doc_id").alias(names[0]), F.col("least.key").alias(names[1])), "kept-rows")
    keyed = docs.withColumns({names[2]: col("doc_id").cast("long"), names[3]: F.xxhash64(text_of(text))})
    found = keyed.join(merge_beyond(kept), own_id.eqNullSafe(kept_id) & (own_key == kept_key), "left_semi")
    tie = F.xxhash64(*[col(c) for c, t in docs.dtypes if not t.startswith("map")])
    one = found.withColumn(names[4], F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(tie))).where(nth == 1)
    return one.select(*map(quoted, docs.columns))


def simhash_query(docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
