"""KMeans from many starts at once.

The centres of all starts move together: a pass over the rows gives, for every centre of every open start, the sum and number
of its rows and the start's cost; converged starts leave.  First centres come from k-means++ for all starts together: one
pass per centre draws, in every start, the row with the smallest exponential variate of rate D^2 (a weighted draw that needs no
total), from a hash of the row's key, start and seed.
"""


from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.operators.passes import Block, RowTable, blocks, row_parts, sums

MAX_PASSES, TOLERANCE = 300, 1e-4


def vector_table(df: DataFrame, key: str, features: str = "features") -> RowTable:
    """Persisted rows of ``x`` and a hash of the key."""
    width = df.select(F.size(vector_to_array(features)).alias("n")).first()["n"]
    # a pass returns a matrix per partition: as many as the rows need, whatever shuffle made them
    return RowTable(df.select(vector_to_array(features).alias("x"), F.xxhash64(key).alias("key")).coalesce(row_parts(df.count())).persist(), width)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances rows x starts x centres."""
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    out = (x ** 2).sum(1)[:, None] - 2 * x @ flat.T + (flat ** 2).sum(1)
    return np.maximum(out, 0.0).reshape(len(x), starts, k)


def _uniform(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Hash of key and salt to (0, 1): rows x starts."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64)[:, None] + salt.astype(np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)).astype(float) / 2.0 ** 53 + 2.0 ** -54


def first_centres(table: RowTable, k: int, starts: int, seed: int) -> np.ndarray:
    """k-means++ centres starts x k x features, in k passes."""
    width, centres = table.width, np.zeros((starts, 0, table.width))
    for i in range(k):
        salt = np.arange(starts, dtype=np.uint64) + np.uint64((seed * 1009 + i) * 100_003)

        def draw(batches: Iterator[pa.RecordBatch], centres=centres, salt=salt) -> Iterator[pa.RecordBatch]:
            best, rows = np.full(starts, np.inf), np.zeros((starts, width))
            for batch in batches:
                for _, b in blocks(batch, width):
                    rate = _gaps(b["x"], centres).min(2) if centres.shape[1] else np.ones((len(b["x"]), starts))
                    u = _uniform(b["key"], salt)
                    with np.errstate(divide="ignore"):
                        turn = np.where(rate > 0, -np.log(u) / rate, 1e300 * (1 + u))   # rows on a centre come last
                    at = turn.argmin(0)
                    won = turn[at, np.arange(starts)] < best
                    best[won], rows[won] = turn[at, np.arange(starts)][won], b["x"][at[won]]
            some = np.flatnonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(best[some]), pa.array(rows[some].tolist(), pa.list_(pa.float64()))],
                                             names=["start", "turn", "x"])

        got = table.df.mapInArrow(draw, "start int, turn double, x array<double>").groupBy("start").agg(F.min_by("x", F.struct("turn", "x")).alias("x"))
        new = {r["start"]: r["x"] for r in got.collect()}   # a row per start
        if len(new) < starts:
            raise ValueError("no rows to cluster")
        centres = np.concatenate([centres, np.array([[new[s]] for s in range(starts)])], 1)
    return centres


def move_together(table: RowTable, centres: np.ndarray, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """Lloyd's iterations of all starts: (centres, cost per start, passes).  An empty cluster keeps its centre."""
    starts, k, d = centres.shape
    centres, cost, live, passes = centres.copy(), np.zeros(starts), np.arange(starts), 0

    def measure(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        now = centres[index]

        def one(b: Block) -> np.ndarray:
            gaps = _gaps(b["x"], now)
            near, out = gaps.argmin(2), np.zeros((len(index), k, d + 2))
            for s in range(len(index)):
                hot = np.zeros((len(near), k))
                hot[np.arange(len(near)), near[:, s]] = 1.0
                out[s, :, :d] = hot.T @ b["x"]
                out[s, :, d] = hot.sum(0)
                out[s, :, d + 1] = hot.T @ gaps[np.arange(len(near)), s, near[:, s]]
            return out.reshape(len(index), -1)

        out = sums(table, one, len(index)).reshape(len(index), k, d + 2)
        return out[..., :d], out[..., d], out[..., d + 1].sum(1)

    while len(live) and passes < max_passes:
        total, count, cost[live] = measure(live)
        passes += 1
        new = np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None], centres[live])
        moved = ((new - centres[live]) ** 2).sum(2).max(1)
        centres[live] = new
        live = live[moved > tolerance ** 2]
    _, _, cost = measure(np.arange(starts))   # of the final centres
    return centres, cost, passes + 1


def assigned(centres: np.ndarray, features: str = "features") -> Column:
    """Number of the nearest centre (lowest on ties)."""
    @F.pandas_udf("int")
    def near(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        return pd.Series(_gaps(np.array(x.tolist(), float), centres[None])[:, 0].argmin(1).astype("int32"))

    return near(vector_to_array(features))
