import random

import numpy as np
from pyspark.ml.feature import VectorAssembler

from tillscope.operators import kmeans as KM
from tillscope.operators import products as PR


def frame(spark, n=200, seed=1):
    rnd = random.Random(seed)
    rows = [(f"p{i}", *[rnd.gauss(4 * (i % 5) * (j + 1), 2.0) for j in range(3)]) for i in range(n)]
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(rows, "Description string, a double, b double, c double")).select("Description", "features")


def lloyd(x, centres):
    for _ in range(300):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved = ((new - centres) ** 2).sum(1).max()
        centres = new
        if moved <= 1e-8:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_starts_together_equal_single_runs(spark):
    d = frame(spark)
    x = np.array([list(r["features"]) for r in d.collect()])
    for table in (KM.vector_table(d, "Description"), KM.vector_table(d.repartition(11), "Description")):
        first = KM.first_centres(table, 5, 12, seed=3)
        centres, cost, passes = KM.move_together(table, first)
        for s in range(12):
            want, best = lloyd(x, first[s])
            assert np.abs(centres[s] - want).max() < 1e-9 and abs(cost[s] - best) < 1e-6 * best
        assert passes < 40   # for all starts
    a = KM.first_centres(KM.vector_table(d, "Description"), 5, 12, seed=3)
    b = KM.first_centres(KM.vector_table(d.repartition(11), "Description"), 5, 12, seed=3)
    assert (a == b).all() and not (a == KM.first_centres(KM.vector_table(d, "Description"), 5, 12, seed=4)).all()


def test_first_centres_are_drawn_by_squared_distance(spark):
    d = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(f"p{i}", 0.0 if i < 97 else 10.0 * (i - 96)) for i in range(100)], "Description string, a double"))
    first = KM.first_centres(KM.vector_table(d, "Description"), 2, 2000, seed=0)[:, :, 0]
    from_zero = first[first[:, 0] == 0.0, 1]
    share = [(from_zero == v).mean() for v in (10.0, 20.0, 30.0)]   # 1 : 4 : 9
    assert np.abs(np.array(share) - np.array([1, 4, 9]) / 14).max() < 0.04
    assert abs((first[:, 0] == 0.0).mean() - 0.97) < 0.02


def test_equal_rows_and_mapping(spark):
    d = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(f"p{i}", 1.0) for i in range(9)] + [("q", 5.0)], "Description string, a double")).select("Description", "features")
    centres, cost, _ = KM.move_together(KM.vector_table(d, "Description"), KM.first_centres(KM.vector_table(d, "Description"), 3, 4, 1))
    assert np.abs(cost).max() < 1e-12
    mapping, best, sil, _ = PR.cluster_products(d, k=2, starts=3)
    got = {r["Description"]: r["categ_product"] for r in mapping.collect()}
    assert len({got[f"p{i}"] for i in range(9)}) == 1 and got["q"] != got["p0"] and sil >= 0.9 and best.shape == (2, 1)
