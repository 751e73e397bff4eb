import math
import random

import numpy as np
import pytest

from scorelake.llm.whitening import pack, squares, unpack, whitened, whitening_query

SCHEMA = "vec_id long, embedding array<float>, label int"


def some(n, dim, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    spread = rng.normal(size=(n, dim)) * np.linspace(0.05, 0.6, dim)
    rows = [(i, [float(np.float32(v)) for v in row], i % 3) for i, row in enumerate(spread)]
    return rows + [(n + k, rows[k % 5][1], 0) for k in range(copies)]


def brute(vectors, components=8):
    grid = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, total = len(grid), grid.sum(axis=0)
    centred = grid - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, total)) for row in grid]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("copies", [0, 300])
def test_as_numpy(spark, copies):
    rows = some(200, 12, copies=copies)
    out = whitening_query(spark.createDataFrame(rows, SCHEMA))
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, values, shares = brute([r[1] for r in rows])
    found = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(found) == len(rows) * 8
    for c in range(8):
        own = np.array([found[i, c + 1]["whitened"] for i in range(len(rows))])
        sign = 1 if own @ values[:, c] > 0 else -1
        assert np.allclose(own, sign * values[:, c], atol=1e-9)
        assert all(math.isclose(found[i, c + 1]["explained"], shares[c], rel_tol=1e-9) for i in range(len(rows)))
    assert all(r["n"] == n and r["deviation"] == deviation[i] == int(r["deviation_exact"]) and r["identity_error"] < 1e-9 for (i, _), r in found.items())
    assert len({r["identity_error"] for r in found.values()}) == 1


def test_weights_of_one_fit_the_distinct_vectors(spark):
    rows = some(50, 4, copies=400)
    df = spark.createDataFrame(rows, SCHEMA)
    once = whitened(df.where("vec_id < 50"), components=4).orderBy("vec_id").collect()
    out = whitened(df, components=4, weights="one").where("vec_id < 50").orderBy("vec_id").collect()
    assert [(r["n"], r["deviation"]) for r in out] == [(r["n"], r["deviation"]) for r in once]
    assert np.allclose(np.abs([r["whitened"] for r in out]), np.abs([r["whitened"] for r in once]), atol=1e-9)
    with pytest.raises(ValueError):
        whitened(df, weights="none")


def test_cases(spark, clashing):
    good = some(30, 3)
    odd = [(100, None, 1), (101, [], 1), (102, [0.5, None, 0.25], 1), (103, [float("nan"), 0.0, 0.0], 1), (104, [float("inf"), 0.0, 0.0], 1), (None, good[0][1], None), (0, good[0][1], 1),
           (200, [0.5, 0.25], 1), (201, [0.25, -0.5], 1), (202, [0.5, 0.25], 1), (300, [1.0, 2.0, 3.0, 4.0], 0)]
    rows = whitening_query(clashing(spark.createDataFrame(good + odd, SCHEMA))).collect()
    per = {}
    for r in rows:
        per.setdefault(r["vec_id"], []).append(r)
    assert set(per) == {*range(30), None, 200, 201, 202, 300} and len(per[0]) == 6 and len(per[None]) == 3
    assert {r["n"] for r in per[5]} == {32} and {r["whitened"] for r in per[None]} == {r["whitened"] for r in per[0]}
    # Three vectors of two entries on one line: the second component has no variance.
    flat = {r["component"]: r for r in per[200]}
    assert {r["n"] for r in per[200]} == {3} and flat[2]["whitened"] is None and flat[2]["explained"] < 1e-12 and abs(flat[1]["whitened"]) > 0.5 and flat[1]["identity_error"] < 1e-9
    # One vector of four entries: nothing varies.
    assert [r["whitened"] for r in per[300]] == [None] * 4 and {r["deviation"] for r in per[300]} == {0} and {r["identity_error"] for r in per[300]} == {0.0}
    empty = whitening_query(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    nothing = whitening_query(spark.createDataFrame(odd[:5], SCHEMA))
    assert nothing.count() == 0


def test_far_entries(spark):
    rows = [(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [70.0, 3e6])]
    out = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    exact = {r["vec_id"]: r["deviation_exact"] for r in out}
    grid = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    assert exact == {i: sum((3 * x - sum(g[k] for g in grid.values())) ** 2 for k, x in enumerate(v)) for i, v in grid.items()}
    assert {r["vec_id"]: r["deviation"] for r in out} == {i: int(v) if v < 1 << 63 else None for i, v in exact.items()}
    beyond = whitened(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert [r["deviation_exact"] for r in beyond] == [1 << 126] * 2 and sorted(r["whitened"] for r in beyond) == [[-1.0], [1.0]]


def test_packing_round_trip_and_squares():
    rng = random.Random(3)
    grid = np.array([[rng.choice([0, 5, -(1 << 15), 1 << 15, (1 << 31) - 1, -(1 << 31), 1 << 31, 1 << 62]) for _ in range(5)] for _ in range(200)])
    import pyarrow as pa

    packed = [None] * len(grid)
    for rows, data in pack(grid):
        for i, raw in zip(rows.tolist(), data):
            packed[i] = raw.tobytes()
    back = np.zeros_like(grid)
    for rows, own in unpack(pa.array(packed, pa.binary())):
        back[rows] = own
    assert (back == grid).all() and len({packed[i] for i in range(200)}) == len({tuple(g) for g in grid.tolist()})
    for n, reach in ((7, 100), (10**6, 10**6), (10**9, 10**9), (3, 1 << 62)):
        grid = np.array([[rng.randint(-reach, reach) for _ in range(6)] for _ in range(20)])
        total = [rng.randint(-n * reach, n * reach) for _ in range(6)]
        assert squares(n, grid, total) == [sum((n * x - s) ** 2 for x, s in zip(row, total)) for row in grid.tolist()]


def test_rows_of_frequent_vectors_are_broadcast(spark):
    """A vector with most of the rows: no task gets its rows by a shuffle on the vector."""
    df = spark.createDataFrame([(i, [0.5, 0.25] if i % 3 else [i / 1000, 0.5], 0) for i in range(3000)], SCHEMA)
    out = whitened(df, components=2)
    assert out.count() == 3000
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in plan
