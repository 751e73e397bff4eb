"""Merkle manifest of a data set: digest-to-children records, and proofs found by descent from the root.

A leaf is the digest of a row's fields. The leaves of a tree (a source) ascend by id; every ``ARITY`` consecutive nodes are hashed into one until one is
left, the subroot; the subroots in the order of their sources are the leaves of one more tree, whose top is the root. Digests are lowercase hexadecimal
SHA-256 and enter the next level as that text.

Nodes are kept as records (digest, its children's digests) in packs: a pack holds ``LEVELS`` levels over ``PACK`` consecutive nodes, and the packs' roots
are the nodes of the next tier, so a tree of any size takes few tiers and no task sees more than one pack at a time. A proof is found from the top: a request knows the rank of its node;
it starts at a pack's root, looks up each digest's children, goes on with the child that the next base-``ARITY`` digit of the rank names and keeps those not taken. The segments, reversed,
are the path from the node up. Requests for the nodes of one pack descend together, first in the upper tiers, where a request stands for a whole pack below, then in the lowest.

Ranks come from a range sort by (tree, id) and sums of counts per partition: a source with a third of all rows is spread over tasks like any other.

Defined cases: null fields count as ``-``. Rows without a source are a tree of their own that comes first; rows without an id come first in their
tree and are never tampered with. Equal ids are in the order of their leaves; repeated rows are separate leaves. Other columns take no part. An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from scorelake.llm.common import col, small_batches, stored

ARITY, LEVELS = 3, 7
PACK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MEMBER = "array<struct<rank: bigint, digest: binary, tampered: binary, doc_id: bigint>>"


def digest_of(children: list[bytes]) -> bytes:
    return sha256(b"".join([c.hex().encode() for c in children])).digest()


def leaf_digest(fields: list[Column]) -> Column:
    """Binary digest of fields, each with its length in bytes, so that no two rows of different fields are hashed as one text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered, tie): ``tampered`` is the digest of the row as it was changed, null where nothing was."""
    fields = {name: col(name) for name in FIELDS}
    text = fields["text"].cast("string")
    changes = F.coalesce(F.crc32(fields["doc_id"].cast("string")) % 2 == 0, F.lit(False)) & F.contains(text, F.lit("\n"))
    changed = leaf_digest([*list(fields.values())[:-1], F.translate(text, "\n", "")])
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), fields["source"].cast("string")), F.lit("")).alias("tree"), fields["doc_id"].cast("long").alias("doc_id"),
        leaf_digest(list(fields.values())).alias("digest"), F.when(changes, changed).alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` within ``tree`` by the order's columns, from 0, and ``n``, the nodes of the tree. ``nodes`` is stored, no two rows are equal."""
    def numbered(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = np.array(batch.column("tree").to_pylist(), dtype=object)
            nth = np.zeros(len(trees), dtype=np.int64)
            starts = np.concatenate(([0], np.flatnonzero(trees[1:] != trees[:-1]) + 1, [len(trees)])) if len(trees) else np.array([0])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                seen = seen if trees[a] == last else 0
                nth[a:b] = np.arange(seen, seen + b - a)
                last, seen = trees[a], seen + b - a
            yield batch.append_column("part", pa.array([part] * len(trees), pa.int32())).append_column("nth", pa.array(nth))

    spread = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = stored(spread.mapInArrow(numbered, f"{nodes.schema.toDDL()}, part int, nth bigint"), "numbered-nodes")
    counts = stored(rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("own")), "node-counts")
    tree = Window.partitionBy("tree")
    before = counts.select("tree", "part", (F.sum("own").over(tree.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(tree).alias("n"))
    return rows.join(before, ["tree", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def built(digests: list[bytes], whole: bool) -> tuple[bytes, list[tuple[bytes, list[bytes]]], int]:
    """(root, records, levels) of a pack; ``whole`` where its root is the top of the tree, else it has all its levels."""
    records, levels = [], 0
    while len(digests) > 1 if whole else levels < LEVELS:
        groups = [digests[i:i + ARITY] for i in range(0, len(digests), ARITY)]
        digests = [digest_of(g) for g in groups]
        records += zip(digests, groups)
        levels += 1
    return digests[0], records, levels


def packs(nodes: DataFrame) -> DataFrame:
    """One tier: (tree, pack, n, members, root, records, levels) from nodes (tree, rank, n, digest, tampered, doc_id)."""
    member = F.struct("rank", "digest", "tampered", "doc_id")
    groups = nodes.groupBy("tree", F.floor(F.col("rank") / PACK).alias("pack"), "n").agg(F.sort_array(F.collect_list(member)).alias("members"))

    def hashed(batches):
        for batch in batches:
            roots, records, levels = [], [], []
            for n, members in zip(batch.column("n").to_pylist(), batch.column("members")):
                root, own, height = built(members.values.field("digest").to_pylist(), n <= PACK)
                roots.append(root)
                records.append(b"".join(d + bytes([len(c)]) + b"".join(c) for d, c in own))
                levels.append(height)
            yield batch.append_column("root", pa.array(roots, pa.binary())).append_column("records", pa.array(records, pa.binary())).append_column("levels", pa.array(levels, pa.int32()))

    return stored(groups.mapInArrow(hashed, f"tree string, pack bigint, n bigint, members {_MEMBER}, root binary, records binary, levels int"), "manifest-packs")


def parsed(records: bytes) -> dict[bytes, list[bytes]]:
    out, at = {}, 0
    while at < len(records):
        n = records[at + 32]
        out[records[at:at + 32]] = [records[i:i + 32] for i in range(at + 33, at + 33 + 32 * n, 32)]
        at += 33 + 32 * n
    return out


def descend(records: dict[bytes, list[bytes]], root: bytes, levels: int, rank: int) -> tuple[bytes, list[tuple[int, list[bytes]]]]:
    """(digest found, path from it to ``root``): on each level the place among the run's nodes, and the other nodes."""
    node, path = root, []
    for level in range(levels - 1, -1, -1):
        children, digit = records[node], rank // ARITY**level % ARITY
        path.append((digit, children[:digit] + children[digit + 1:]))
        node = children[digit]
    return node, path[::-1]


def folded(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    for digit, others in path:
        leaf = digest_of([*others[:digit], leaf, *others[digit:]])
    return leaf


def to_bytes(path: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes([digit, len(others)]) + b"".join(others) for digit, others in path)


def from_bytes(data: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(data):
        digit, n = data[at:at + 2]
        out.append((digit, [data[i:i + 32] for i in range(at + 2, at + 2 + 32 * n, 32)]))
        at += 2 + 32 * n
    return out


def forest(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all trees, lowest first, and their tops (tree, top)."""
    tiers = [packs(nodes)]
    while not (upper := tiers[-1].where(F.col("n") > PACK)).isEmpty():
        none = F.lit(None)
        tiers.append(packs(upper.select(
            "tree", F.col("pack").alias("rank"), F.ceil(F.col("n") / PACK).alias("n"), F.col("root").alias("digest"), none.cast("binary").alias("tampered"), none.cast("long").alias("doc_id"))))
    tops = None
    for tier in tiers:
        own = tier.where(F.col("n") <= PACK).select("tree", F.col("root").alias("top"))
        tops = own if tops is None else tops.unionByName(own)
    return tiers, tops


def requested(tier: DataFrame, above: DataFrame, each, schema: str) -> DataFrame:
    """Rows (``schema``) that ``each`` makes of a pack, a member, the path from the member to the pack's root, and the rest of the way up as it found it
    (bytes and path). ``above`` (tree, pack, top, path) has the tree's top and that rest for the packs of the tier."""
    names = [f.name for f in T.StructType.fromDDL(schema)]
    kinds = to_arrow_schema(T.StructType.fromDDL(schema)).types

    def found(batches):
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for pack in _rows(batch):
                records, rest = parsed(pack["records"]), from_bytes(pack["path"])
                for member in pack["members"]:
                    node, path = descend(records, pack["root"], pack["levels"], member["rank"] % PACK)
                    if node != member["digest"]:
                        raise ValueError(f"the manifest has no node {member['rank']} of tree {pack['tree']!r}")
                    rows.append(each(pack, member, path, rest))
                if len(rows) >= PACK:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    return tier.join(above, ["tree", "pack"]).select("tree", "members", "root", "records", "levels", "top", "path").mapInArrow(found, schema)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, so that only one pack at a time is spread out."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def lowest(tiers: list[DataFrame], tops: DataFrame, each, schema: str) -> DataFrame:
    """Descends all tiers: rows that ``each`` makes of the lowest tier's members. ``tops`` (tree, top, path) has the way from each tree's top on."""
    above = None
    for tier in reversed(tiers):
        own = tier.where(F.col("n") <= PACK).select("tree", "pack").join(tops, "tree").select("tree", "pack", "top", "path")
        entered = own if above is None else own.unionByName(above)
        if tier is not tiers[0]:
            below = requested(tier, entered, lambda pack, m, path, _: (pack["tree"], m["rank"], pack["top"], to_bytes(path) + pack["path"]), "tree string, pack bigint, top binary, path binary")
            above = stored(below, "manifest-paths")
    return requested(tiers[0], entered, each, schema)


class Manifest:
    """The stored records of a table: ``tiers`` of the sources' trees, ``names`` (rank, tree, top) of the subroots, ``high`` tiers of the tree over them, and ``root``."""

    def __init__(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        self.tiers, tops = forest(ranked(stored(leaves(docs), "leaves"), "doc_id", "digest", "tie"))
        none = F.lit(None)
        upper = stored(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"), none.cast("binary").alias("tampered"), none.cast("long").alias("doc_id")), "subroots")
        named = stored(ranked(upper, "name"), "ranked-subroots")
        self.names = named.select("rank", F.col("name").alias("tree"), F.col("digest").alias("top"))
        self.high, top = forest(named.drop("name"))
        found = top.select("top").first()
        self.root: bytes | None = bytes(found["top"]) if found else None

    def records(self) -> DataFrame:
        """(digest, children), hexadecimal, each digest once."""
        return records_of(self.tiers + self.high)

    def proofs(self, each, schema: str) -> DataFrame:
        """Rows that ``each`` makes of every leaf, see :func:`requested`."""
        spark = self.names.sparkSession
        start = spark.createDataFrame([("", self.root, b"")], "tree string, top binary, path binary")
        ways = lowest(self.high, start, lambda pack, m, path, rest: (m["rank"], to_bytes(path + rest)), "rank bigint, path binary")
        tops = stored(self.names.join(ways, "rank").select("tree", "top", "path"), "source-paths")
        return lowest(self.tiers, tops, each, schema)


def records_of(tiers: list[DataFrame]) -> DataFrame:
    """The records of stored tiers: (digest, children), hexadecimal, each digest once."""
    def opened(batches):
        for batch in batches:
            for blob in batch.column(0):
                own = parsed(blob.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d.hex() for d in own], pa.string()), pa.array([[c.hex() for c in cs] for cs in own.values()], pa.list_(pa.string()))], ["digest", "children"])

    found = tiers[0].select("records")
    for tier in tiers[1:]:
        found = found.unionByName(tier.select("records"))
    return found.mapInArrow(opened, "digest string, children array<string>").dropDuplicates(["digest"])


def verified(docs: DataFrame, keep_proof: bool = True) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, digests in hexadecimal, and ``proof``, the path as :func:`to_bytes` has it."""
    own = Manifest(docs)
    root = own.root.hex() if own.root else None

    def each(pack, member, path, rest):
        whole = path + rest
        leaf, others = member["digest"], [d.hex().encode() for _, siblings in whole for d in siblings]
        fold = folded(member["tampered"] or leaf, whole).hex()
        return (member["doc_id"], leaf.hex(), pack["top"].hex(), root, sha256(b"".join(others)).hexdigest(), fold, fold == root, to_bytes(whole) if keep_proof else None)

    out = own.proofs(each, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof binary")
    return out if keep_proof else out.drop("proof")
