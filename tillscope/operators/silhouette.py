"""Silhouette of a labelled point set without pairwise distances.

With squared Euclidean distance the mean distance of a point to a cluster has a
closed form from per-cluster statistics (count, vector sum, sum of squared norms),
the same formula Spark ML's ``ClusteringEvaluator`` uses.  The statistics table has
one row per cluster (bounded by k), carried to every point as one array value.
Own-cluster mean excludes the point itself (factor n / (n - 1)); singleton clusters
score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_silhouette(points: DataFrame, feature_cols: list[str], label: str = "cluster") -> DataFrame:
    sq = sum((F.col(c) * F.col(c) for c in feature_cols[1:]), F.col(feature_cols[0]) * F.col(feature_cols[0]))
    stats = points.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"),
        F.array(*[F.sum(c) for c in feature_cols]).alias("s"))
    packed = stats.agg(F.collect_list(F.struct(F.col(label).alias("k"), "n", "q", "s"))).scalar()
    p = points.withColumn("_st", packed).withColumn("_sq", sq).withColumn("_x", F.array(*feature_cols))

    def dist(s):
        dot = F.aggregate(F.arrays_zip(F.col("_x"), s["s"]), F.lit(0.0),
                          lambda acc, z: acc + z["_x"] * z["s"])
        return F.col("_sq") + s["q"] / s["n"] - 2 * dot / s["n"]

    own = F.filter(F.col("_st"), lambda s: s["k"] == F.col(label))[0]
    a = dist(own) * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter(F.col("_st"), lambda s: s["k"] != F.col(label)), dist))
    sil = (F.when(own["n"] <= 1, F.lit(0.0)).when(b.isNull(), F.lit(0.0))
           .when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0)))
    return p.withColumn("silhouette", sil).drop("_st", "_sq", "_x")


def silhouette(points: DataFrame, feature_cols: list[str], label: str = "cluster") -> DataFrame:
    """One row: mean silhouette."""
    return point_silhouette(points, feature_cols, label).agg(F.avg("silhouette").alias("silhouette"))
