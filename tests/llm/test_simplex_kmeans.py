import hashlib

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import Tables
from tillscope.llm.simplex_kmeans import (DIMS, ORACLE, Simplex, bounds, nearest, op11_simplex_kmeans, simplex_kmeans, squared)

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, v string, distance string"


def brute(rows, k=8, rounds=10):
    """rows: (vec_id, list of floats) that are kept."""
    ints = [np.array([int(np.floor(1024 * x)) for x in v], np.int64) for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"3:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(),
                                                    ints[i].tolist()))
    cents = [ints[i].tolist() for i in order[:k]]

    def assign():
        return [min((int(((x - np.array(c)) ** 2).sum()), j) for j, c in enumerate(cents)) for x in ints]

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            mine = [x for x, (_, c) in zip(ints, got) if c == j]
            if mine:
                cents[j] = [int(s) // len(mine) for s in np.sum(mine, 0)]
    got = assign()
    per = [sum(d for d, c in got if c == j) for j in range(len(cents))]
    return sorted([str((r[0], c, d, per[c], sum(per), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()))
                   for r, (d, c) in zip(rows, got)])


def data(n, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, DIMS)) * spread
    return [(int(i), (centre[i % 5] + rng.normal(size=DIMS) * 0.1).tolist()) for i in range(n)]


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    x = np.array([v for _, v in data(400)])
    x = np.floor(1024 * x).astype(np.int64)
    s = Simplex(x[:16])
    c = x[rng.choice(len(x), 8)] + 3
    low, high = bounds(s.apex(x), s.apex(c))
    exact = squared(x, c)
    assert (low <= exact).all() and (exact <= high).all()
    best, far, seen = nearest(x, s.apex(x), c, s.apex(c), False)
    assert (best == exact.argmin(1)).all()
    assert seen < 0.6 * exact.size   # exact comparisons that are left
    best, far, _ = nearest(x, s.apex(x), c, s.apex(c), True)
    assert (far == exact.min(1)).all()


def test_degenerate_pivots():
    x = np.array([[1, 2, 3], [1, 2, 3], [2, 4, 6], [3, 6, 9], [0, 0, 7]], np.int64)
    s = Simplex(x)
    assert len(s.pivots) == 3   # repeated and collinear ones go
    low, high = bounds(s.apex(x), s.apex(x))
    assert (low <= squared(x, x)).all() and (squared(x, x) <= high).all()
    assert Simplex(x[:2]).apex(x).shape == (5, 2)


@pytest.mark.parametrize("n", [1, 5, 8, 300])
def test_against_brute_force(spark, n):
    rows = data(n, n)
    df = spark.createDataFrame([(*r, 0, "a", "b", "c") for r in rows], SCHEMA)
    got = op11_simplex_kmeans(Tables(spark, embeddings=df), "x")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kept = data(40) + [(7, data(40)[7][1]), (None, data(3, 9)[0][1]), (7, data(3, 9)[1][1]), (99, [0.0] * DIMS), (98, [-1.5] * DIMS), (98, [-1.5] * DIMS)]
    out = [(1, None), (2, []), (3, [1.0] * 63), (4, [nan] + [0.0] * 63), (5, [inf] + [0.0] * 63), (6, [None] + [0.0] * 63)]
    df = spark.createDataFrame([(*r, None, "a", None, "c") for r in kept + out], SCHEMA)
    got = op11_simplex_kmeans(Tables(spark, embeddings=df), "x")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(kept)
    empty = op11_simplex_kmeans(Tables(spark, embeddings=spark.createDataFrame([], SCHEMA)), "x")
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_vectors_and_too_large_components(spark):
    same = [(i, [0.25] * DIMS) for i in range(50)]
    df = spark.createDataFrame([(*r, 0, "", "", "") for r in same], SCHEMA)
    assert sorted(str(tuple(r)) for r in op11_simplex_kmeans(Tables(spark, embeddings=df), "x").collect()) == brute(same)
    big = spark.createDataFrame([(1, [1e6] + [0.0] * 63, 0, "", "", "")], SCHEMA)
    with pytest.raises(ValueError):
        simplex_kmeans(big)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE})").fetchall())
    assert sorted(tuple(r) for r in op11_simplex_kmeans(spark, sf).select(cols).collect()) == want
