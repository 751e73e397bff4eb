"""Whitening of embeddings from a covariance that is weighted by how often each vector occurs.

Entries are put on a whole-number grid (floor of ``scale`` times the entry, plus ``offset``), equal vectors are grouped, and each group's size, or one, is
its weight in the fit. Sums are exact whole numbers; the covariance is a sum over batches of weighted matrix products of centred vectors, added
up task by task and then in a bounded number of slots, so that only a few matrices come to the driver, which takes the eigenvectors. Each
distinct vector is projected once and joined back to its rows; what the join carries is a 128-bit digest of the vector, not the vector. The error of the
whitened covariance against the identity is measured on what was written.

Vectors that occur very often are known by their stored counts: more than a thousandth of all rows (and more than 100), so there are fewer than 1,000 of them.
Their rows meet a broadcast table of at most that size; all others are joined through a shuffle, where none of them has more rows than that.

Defined cases: rows whose vector is null, empty, or holds a null or an entry that is not finite are left out. Vectors of other lengths are spaces of
their own, each with its fit. An entry beyond 2^62 on the grid counts as 2^62. Equal vectors, and repeated rows, are whitened alike; a row without
an id keeps its null id. A component whose variance is less than 1e-12 of the total has a null ``whitened``; it takes no part in the identity error,
which is 0 if there is no other. ``deviation`` is null where it needs more than 64 bits, ``deviation_exact`` where it needs more than 38 digits. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import col, small_batches, stored

LIMIT = 1 << 62
LEAST_SHARE = 1e-12
_KINDS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


def pack(grid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, their bytes as rows of a matrix): the width of an entry in bytes, then the entries, as narrow as a row's own entries let them be."""
    reach = np.maximum(grid.max(axis=1), ~grid.min(axis=1))
    widths = np.select([reach < 1 << 15, reach < 1 << 31], [2, 4], 8)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        body = np.ascontiguousarray(grid[rows], dtype=_KINDS[width]).view(np.uint8).reshape(len(rows), -1)
        yield rows, np.concatenate([np.full((len(rows), 1), width, dtype=np.uint8), body], axis=1)


def unpack(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which rows, their vectors as a matrix of whole numbers) for each length and width in a batch."""
    raw = vectors.to_pylist()
    forms = np.array([(len(r), r[0]) for r in raw], dtype=np.int64).reshape(-1, 2)
    for size, width in np.unique(forms, axis=0).tolist():
        rows = np.flatnonzero((forms == (size, width)).all(axis=1))
        joined = np.frombuffer(b"".join([raw[i] for i in rows]), dtype=np.uint8).reshape(len(rows), size)
        yield rows, np.ascontiguousarray(joined[:, 1:]).view(_KINDS[width]).astype(np.int64)


def on_grid(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, vec) of the rows that take part; ``vec`` is the packed grid vector without the offset."""
    def packed(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy()[:-1]
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                entries = values[starts[at][:, None] + np.arange(size)]
                whole = np.isfinite(entries).all(axis=1)
                at, entries = at[whole], entries[whole]
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    grid = np.clip(np.floor(entries * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)
                for rows, data in pack(grid):
                    ends = pa.py_buffer(np.arange(0, data.size + 1, data.shape[1], dtype=np.int32).tobytes())
                    vec = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(data.tobytes())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[rows])), vec], ["vec_id", "vec"])

    slim = df.select(col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("vec"))
    return slim.mapInArrow(packed, "vec_id long, vec binary")


def sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length of a vector: the total weight and the exact sum of each entry."""
    def partial(batches):
        found: dict[int, list] = {}
        for batch in batches:
            weights = batch.column(1).to_numpy()
            for rows, grid in unpack(batch.column(0)):
                w = weights[rows][:, None]
                own = found.setdefault(grid.shape[1], [0, np.zeros((2, grid.shape[1]), dtype=object)])
                own[0] += int(w.sum())
                own[1] += np.stack([((grid >> 31) * w).sum(axis=0), ((grid & 0x7FFFFFFF) * w).sum(axis=0)]).astype(object)
        for dim, (n, parts) in found.items():
            totals = [Decimal(int(h) * (1 << 31) + int(low)) for h, low in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(n), *totals], pa.decimal128(38, 0))], ["dim", "at", "total"])

    rows = distinct.select("vec", "weight").mapInArrow(partial, "dim int, at int, total decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(rows.groupBy("dim", "at").agg(F.sum("total").alias("total")).collect(), key=lambda r: (r["dim"], r["at"])):
        if row["at"] < 0:
            out[row["dim"]] = (int(row["total"]), [])
        else:
            out[row["dim"]][1].append(int(row["total"]))
    return out


def covariances(distinct: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length: the covariance of the grid vectors, divisor n, from centred vectors."""
    means = {dim: np.array([s / n for s in each]) for dim, (n, each) in totals.items()}
    slots = {dim: max(1, min(64, (1 << 26) // (8 * dim * dim))) for dim in totals}

    def partial(batches):
        found = {}
        for batch in batches:
            weights = batch.column(1).to_numpy().astype(np.float64)
            for rows, grid in unpack(batch.column(0)):
                dim = grid.shape[1]
                centred = grid - means[dim]
                found[dim] = found.get(dim, 0) + (centred * weights[rows][:, None]).T @ centred
        task = TaskContext.get().partitionId()
        for dim, matrix in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([task % slots[dim]], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["dim", "slot", "matrix"])

    def added(table):
        total = 0
        for raw in table.column("matrix"):
            total = total + np.frombuffer(raw.as_buffer())
        return pa.table({"dim": table.column("dim").slice(0, 1), "matrix": pa.array([total.tobytes()], pa.binary())})

    parts = distinct.select("vec", "weight").mapInArrow(partial, "dim int, slot int, matrix binary")
    out: dict[int, np.ndarray] = {}
    for row in parts.groupBy("dim", "slot").applyInArrow(added, "dim int, matrix binary").collect():
        dim = row["dim"]
        out[dim] = out.get(dim, 0) + np.frombuffer(bytes(row["matrix"])).reshape(dim, dim)
    return {dim: (m + m.T) / (2 * totals[dim][0]) for dim, m in out.items()}


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection onto the first k components over their deviations, share of the total variance of each, which have a variance)."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    total = float(np.trace(covariance))
    live = values > LEAST_SHARE * total
    shares = np.where(live, values, 0.0) / total if total > 0 else np.zeros(len(values))
    return vectors / np.sqrt(np.where(live, values, 1.0)), shares, live


def squares(n: int, grid: np.ndarray, total: list[int]) -> list[int]:
    """Exact sum over entries of (n * x - S)^2 per row."""
    reach = n * max(int(grid.max()), -int(grid.min())) + max(map(abs, total))
    if reach >= 1 << 62:
        return [sum((n * x - s) ** 2 for x, s in zip(row, total)) for row in grid.tolist()]
    apart = np.abs(grid * n - np.array(total, dtype=np.int64))
    # Limbs of 21 bits: their products, summed over all entries, stay within 64 bits.
    a, b, c = apart >> 42, apart >> 21 & 0x1FFFFF, apart & 0x1FFFFF
    parts = [(a * a, 84, 1), (a * b, 63, 2), (a * c, 42, 2), (b * b, 42, 1), (b * c, 21, 2), (c * c, 0, 1)]
    out = [0] * len(grid)
    for product, shift, times in parts:
        if product.any():
            out = [o + (times * v << shift) for o, v in zip(out, product.sum(axis=1).tolist())]
    return out


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8, weights: str = "counts", scale: int = 1024) -> DataFrame:
    """(vec_id, dim, n, deviation, deviation_exact, whitened, explained, identity_error) of each row that takes part; ``whitened`` and ``explained`` are lists
    with an item a component. ``weights`` is ``counts``, where the fit is over all vectors, or ``one``, where it is over the distinct ones. The offset of the grid moves no result."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    spark = df.sparkSession
    small_batches(spark, 4096)
    placed = on_grid(df, vec_id, vector, scale)
    groups = placed.groupBy("vec").agg(F.count(F.lit(1)).alias("rows"))
    distinct = stored(groups.withColumn("weight", F.col("rows") if weights == "counts" else F.lit(1).cast("long")), "distinct-vectors")
    totals = sums(distinct)
    models = {dim: leading(matrix, components) for dim, matrix in covariances(distinct, totals).items()}
    means = {dim: np.array([s / n for s in each]) for dim, (n, each) in totals.items()}

    def projected(batches):
        for batch in batches:
            for rows, grid in unpack(batch.column(1)):
                dim = grid.shape[1]
                projection, _, live = models[dim]
                n, total = totals[dim]
                values = (grid - means[dim]) @ projection
                exact = squares(n, grid, total)
                size = values.shape[1]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, values.size + 1, size, dtype=np.int32)), pa.array(values.ravel(), mask=np.broadcast_to(~live, values.shape).ravel()))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array([dim] * len(rows), pa.int32()),
                     pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()),
                     pa.array([Decimal(d) if d < 10**38 else None for d in exact], pa.decimal128(38, 0)), lists],
                    ["key", "rows", "weight", "dim", "deviation", "deviation_exact", "whitened"])

    key = F.substring(F.unhex(F.sha2("vec", 256)), 1, 16)
    once = stored(distinct.select(key.alias("key"), "vec", "rows", "weight").mapInArrow(
        projected, "key binary, rows long, weight long, dim int, deviation long, deviation_exact decimal(38,0), whitened array<double>"), "whitened-vectors")
    errors = identity_errors(once, components)
    facts = [(dim, totals[dim][0], [float(s) for s in shares], errors[dim]) for dim, (_, shares, _) in models.items()]
    fits = spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    rows = stored(placed.select("vec_id", key.alias("key")), "vector-keys")
    often = max(100, (once.agg(F.sum("rows")).first()[0] or 0) // 1000)
    hot = once.where(F.col("rows") > often)
    joined = rows.join(F.broadcast(hot), "key").unionByName(
        rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(once.where(F.col("rows") <= often), "key"))
    return joined.join(F.broadcast(fits), "dim").select(
        "vec_id", "dim", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error")


def identity_errors(once: DataFrame, components: int) -> dict[int, float]:
    """Per length: the largest entry of the whitened vectors' covariance less the identity."""
    at = [F.get("whitened", F.lit(i)) for i in range(components)]
    n, weight = F.sum("weight"), F.col("weight")
    means = once.groupBy("dim").agg(n.alias("n"), F.array(*[F.sum(a * weight) / n for a in at]).alias("means"))
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    centred = [a - F.get("means", F.lit(i)) for i, a in enumerate(at)]
    off = [F.abs(F.sum(centred[i] * centred[j] * weight) / F.max("n") - (1.0 if i == j else 0.0)) for i, j in pairs]
    found = once.join(F.broadcast(means), "dim").groupBy("dim").agg(F.array(*off).alias("off")).collect()
    return {row["dim"]: max([v for v in row["off"] if v is not None], default=0.0) for row in found}


def whitening_query(df: DataFrame) -> DataFrame:
    """A row for each component of each row that takes part."""
    return whitened(df).select(
        "vec_id", F.posexplode("whitened").alias("at", "whitened"), "dim", "n", "deviation", "deviation_exact", "explained", "identity_error").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error", "deviation_exact")
