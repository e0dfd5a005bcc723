"""Centroid clustering with n-simplex projection before exact integer comparison.

Vectors are made integers, and a few of them (``PIVOTS``, the first by the seeding hash, left out where they lie nearly in the
others' hull) span a simplex.  A vector's squared distances to the pivots, computed once and kept beside it, give the
coordinates of an apex over that simplex: the foot from a triangular system, the altitude from what is left.  For two apexes
the Euclidean distance with the altitudes on the same side is a lower bound of the distance of the vectors, with the altitudes
on opposite sides an upper bound.  In every round a centroid whose lower bound exceeds the smallest upper bound (by more than
the rounding slack) is left out; only the others are compared in exact 64-bit integers, ties to the smaller number.  Sums are
exact, new centroids are the componentwise floor of sum / count, empty clusters keep theirs.

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; null or
repeated vec_ids stay (a null counts as an empty text in the seeding hash, equal hashes go by components); fewer vectors than
``k`` give as many clusters, none an empty table; other columns are left out, whatever their names.  A component whose integer
is beyond +-2^27 is an error (its squared distances could pass 64 bits), and sums hold for 2^36 vectors.

Scale: one written table of integers and apexes, read once a round; a round sends the centroids to the tasks and returns
k sums per batch, combined by Spark to k rows for the driver.  No shuffle carries vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import written
from tillscope.session import ship_package

DIMS, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
PIVOTS = 16
SCALE = 1024
LIMIT = 1 << 27
#: Share of the largest pivot distance that a pivot's altitude over the earlier ones must have.
LEAST_ALTITUDE = 0.1
#: Slack of the bounds, as a share of the squared distances to the first pivot: far above the rounding of the triangular system.
SLACK = 1e-6
#: Vectors per numpy step.
STEP = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows (n x d) to rows (m x d)."""
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


class Simplex:
    """A simplex of pivots; ``apex`` turns squared distances to the pivots into coordinates and altitude."""

    def __init__(self, candidates: np.ndarray):
        pivots, rows = [], []
        far = float(squared(candidates, candidates).max()) if len(candidates) else 0.0
        for p in candidates:
            if not pivots:
                pivots.append(p)
                continue
            d = squared(p[None], np.array(pivots))[0].astype(float)
            foot, height = self._solve(np.array(rows).reshape(len(rows), len(rows)), d[None])
            if height[0] > LEAST_ALTITUDE ** 2 * far:
                for r in rows:
                    r.append(0.0)
                rows.append([*foot[0], float(np.sqrt(height[0]))])
                pivots.append(p)
        self.pivots = np.array(pivots, np.int64).reshape(len(pivots), candidates.shape[1])
        self.base = np.array(rows, float).reshape(len(rows), len(rows))

    @staticmethod
    def _solve(base: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feet (coordinates) and squared altitudes from squared distances d (n x pivots)."""
        foot = np.zeros((len(d), len(base)))
        for i, v in enumerate(base):   # the base is lower triangular
            rest = (d[:, 0] - d[:, i + 1] + (v ** 2).sum()) / 2 - foot[:, :i] @ v[:i]
            foot[:, i] = rest / v[i]
        return foot, np.maximum(d[:, 0] - (foot ** 2).sum(1), 0.0)

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of (foot, altitude, squared distance to the first pivot)."""
        d = squared(vectors, self.pivots).astype(float)
        foot, height = self._solve(self.base, d)
        return np.concatenate([foot, np.sqrt(height)[:, None], d[:, :1]], 1)


def bounds(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (with slack) of the squared distances of apex rows a and c: n x m."""
    feet = np.maximum((a[:, :-2] ** 2).sum(1)[:, None] + (c[:, :-2] ** 2).sum(1)[None] - 2 * a[:, :-2] @ c[:, :-2].T, 0.0)
    slack = SLACK * (a[:, -1:] + c[:, -1][None] + 1.0)
    ha, hc = a[:, -2:-1], c[:, -2][None]
    return feet + (ha - hc) ** 2 - slack, feet + (ha + hc) ** 2 + slack


def nearest(x: np.ndarray, a: np.ndarray, centroids: np.ndarray, apexes: np.ndarray, distance: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance or 0, exact comparisons): a lone candidate is measured only if ``distance``."""
    low, high = bounds(a, apexes)
    may = low <= high.min(1)[:, None]
    best, far = np.full(len(x), -1), np.zeros(len(x), np.int64)
    lone = may.sum(1) == 1
    best[lone] = may[lone].argmax(1)
    seen = 0
    for c in range(len(centroids)):
        at = np.flatnonzero(may[:, c] & (distance | ~lone))
        seen += len(at)
        d = ((x[at] - centroids[c]) ** 2).sum(1)
        won = (best[at] < 0) | lone[at] | (d < far[at])   # centroids in ascending order: ties stay
        best[at[won]], far[at[won]] = c, d[won]
    return best, far, seen


def integer_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", dims: int = DIMS) -> DataFrame:
    """(key, v array<long>) of the vectors that are kept."""
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(value, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return vectors.where((F.size(value) == dims) & finite).select(F.col(key).alias("vec_id"), ints.alias("v"))


def _arrays(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for i in range(0, batch.num_rows, STEP):
        part = batch.slice(i, STEP)
        x = np.frombuffer(b"".join(part.column("ints").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
        a = np.frombuffer(b"".join(part.column("apex").to_pylist()), "<f8").reshape(len(x), -1)
        yield part, x, a


def with_apexes(ints: DataFrame, simplex: Simplex, dims: int) -> DataFrame:
    """(vec_id, ints, apex) as packed binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                v = part.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
                if len(x) and np.abs(x).max() > LIMIT:
                    raise ValueError(f"a component is beyond +-{LIMIT // SCALE}")
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()),
                     pa.array([r.tobytes() for r in simplex.apex(x)], pa.binary())], names=["vec_id", "ints", "apex"])

    return ints.mapInArrow(run, f"vec_id {ints.schema['vec_id'].dataType.simpleString()}, ints binary, apex binary")


def simplex_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, pivots: int = PIVOTS,
                   seed: int = SEED, key: str = "vec_id", value: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every kept vector, and the final centroids."""
    ship_package(vectors.sparkSession)
    ints = integer_vectors(vectors, key, value, dims)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = ints.orderBy(digest, "v").limit(max(k, pivots)).collect()
    kind = ints.schema["vec_id"].dataType.simpleString()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, cluster int, distance long"), []
    head = np.array([r["v"] for r in first], object)
    if np.abs(head).max() > LIMIT:
        raise ValueError(f"a component is beyond +-{LIMIT // SCALE}")
    head = head.astype(np.int64)
    simplex = Simplex(head[:pivots])
    table = written(with_apexes(ints, simplex, dims), "simplex-vectors")
    centroids = [[int(x) for x in r] for r in head[:k]]
    for _ in range(rounds):
        sums = _sums(table, np.array(centroids, np.int64), simplex, dims)
        for r in sums.collect():   # k rows
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return _assigned(table, np.array(centroids, np.int64), simplex, dims).withColumnRenamed("vec_id", key), centroids


def _sums(table: DataFrame, centroids: np.ndarray, simplex: Simplex, dims: int) -> DataFrame:
    apexes = simplex.apex(centroids)
    names = ["cluster", "n", *[f"s{i}" for i in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 1), np.int64)
        for batch in batches:
            for _, x, a in _arrays(batch, dims):
                best = nearest(x, a, centroids, apexes, False)[0]
                for c in np.unique(best):
                    mine = x[best == c]
                    total[c, 0] += len(mine)
                    total[c, 1:] += mine.sum(0)
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(col) for col in total[some].T]], names=names)

    schema = ", ".join(["cluster int", "n long", *[f"s{i} long" for i in range(dims)]])
    part = table.select("ints", "apex").mapInArrow(run, schema)
    return part.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in names[1:]])


def _assigned(table: DataFrame, centroids: np.ndarray, simplex: Simplex, dims: int) -> DataFrame:
    apexes = simplex.apex(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, a in _arrays(batch, dims):
                best, far, _ = nearest(x, a, centroids, apexes, True)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(far)],
                                                 names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def op11_simplex_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, exact squared distance, inertias and digest of the final centroid of every kept vector."""
    assigned, centroids = simplex_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = written(assigned, "simplex-assigned")
    per = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, per.get(c, 0), sum(per.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
            for c, v in enumerate(centroids)]
    digest = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(digest), "cluster").select(   # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    square = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {DIMS})""",
             f"""c0 AS MATERIALIZED (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY
  sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS cluster, v FROM e) WHERE cluster < {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT a.r, any_value(a.vec_id) AS vec_id, any_value(a.v) AS v,
  min(struct_pack(d := {square}, cluster := c.cluster)) AS m FROM e a CROSS JOIN c{i} c GROUP BY a.r)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT m.cluster AS cluster, unnest(range(1, {DIMS + 1})) AS pos, unnest(v) AS x FROM a{i}),
f{i} AS (SELECT cluster, pos, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM s{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(any_value(g.v), any_value(c.v)) AS v FROM c{i} c LEFT JOIN (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM f{i} GROUP BY cluster) g USING (cluster)
  GROUP BY c.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.m.cluster AS cluster, CAST(a.m.d AS BIGINT) AS distance,
  CAST(sum(a.m.d) OVER (PARTITION BY a.m.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.m.cluster"""


ORACLE = _oracle()
