import random

import numpy as np
from pyspark.sql import functions as F

from tillscope.operators import knn as KNN
from tillscope.operators import shapley as SH
from tillscope.operators.silhouette import silhouette


def test_knn_exact(spark):
    rnd = np.random.default_rng(1)
    tr = rnd.normal(size=(300, 3)) * [5, 1, 1]
    qs = rnd.normal(size=(80, 3)) * [5, 1, 1]
    t = spark.createDataFrame([(i, int(i % 4), [float(x) for x in r]) for i, r in enumerate(tr)],
                              "tid long, label int, x array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(qs)], "qid long, x array<double>")
    k = 7
    got = {}
    for r in KNN.neighbours(t, q, k).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    for i, x in enumerate(qs):
        d = np.sqrt(((tr - x) ** 2).sum(1))
        want = sorted(range(len(tr)), key=lambda j: (d[j], j))[:k]
        assert [tid for _, tid in sorted(got[i])] == want


def test_shapley_linear_closed_form(spark):
    rnd = random.Random(2)
    feats = [f"f{j}" for j in range(6)]
    rows = [(f"c{i}", *[rnd.random() for _ in feats]) for i in range(12)]
    df = spark.createDataFrame(rows, "CustomerID string, " + ", ".join(f"{f} double" for f in feats))
    w = [1.0, -2.0, 0.5, 3.0, 0.0, 1.5]
    pts = SH.coalition_points(df.limit(4), df, features=feats)
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    out = sum((x[j] * w[j] for j in range(6)), F.lit(0.0))
    scored = pts.withColumn("p", F.array(out, -out))
    vals = SH.shapley(scored, 2, [0], features=feats).collect()
    mean_bg = [np.mean([r[1 + j] for r in rows]) for j in range(6)]
    byid = {r[0]: r for r in rows}
    for v in vals:
        xr = byid[v["CustomerID"]]
        for j, f in enumerate(feats):
            assert abs(v[f"shap_{f}"] - abs(w[j] * (xr[1 + j] - mean_bg[j]))) < 1e-9
        # efficiency: contributions + mean background output = output
        phi0 = [p[0] for p in v["phi"]]
        fx = sum(w[j] * xr[1 + j] for j in range(6))
        fb = sum(w[j] * mean_bg[j] for j in range(6))
        assert abs(sum(phi0) + fb - fx) < 1e-9


def test_silhouette_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    rnd = np.random.default_rng(5)
    rows = [(float(a), float(b), int(c)) for (a, b), c in zip(rnd.normal(size=(200, 2)), rnd.integers(0, 4, 200))]
    df = spark.createDataFrame(rows, "a double, b double, cluster int")
    mine = silhouette(df, ["a", "b"]).first()[0]
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    ref = ClusteringEvaluator(predictionCol="cluster").evaluate(v.withColumn("cluster", F.col("cluster").cast("double")))
    assert abs(mine - ref) < 1e-9


def test_shapley_of_mean_is_mean_of_shapley(spark):
    rnd = random.Random(9)
    feats = [f"f{j}" for j in range(6)]
    rows = [(f"c{i}", *[rnd.random() for _ in feats]) for i in range(10)]
    df = spark.createDataFrame(rows, "CustomerID string, " + ", ".join(f"{f} double" for f in feats))
    pts = SH.coalition_points(df.limit(3), df, features=feats)
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    f1 = F.when(x[0] > 0.5, x[1]).otherwise(x[2] * x[3])      # non-linear outputs
    f2 = F.greatest(x[4], x[5]) - x[0]
    a = SH.shapley(pts.withColumn("p", F.array(f1, -f1)), 2, [0, 1], features=feats)
    b = SH.shapley(pts.withColumn("p", F.array(f2, f2 * 2)), 2, [0, 1], features=feats)
    direct = SH.shapley(pts.withColumn("p", F.array((f1 + f2) / 2, (-f1 + f2 * 2) / 2)), 2, [0, 1], features=feats)
    combined = {r["CustomerID"]: r for r in SH.mean_of([a, b], 2, [0, 1], features=feats).collect()}
    for r in direct.collect():
        for f in feats:
            assert abs(r[f"shap_{f}"] - combined[r["CustomerID"]][f"shap_{f}"]) < 1e-12
