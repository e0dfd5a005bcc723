import pytest
from pyspark.sql import functions as F

from tillscope.functions import rules, text
from tillscope.operators import customers as U
from tillscope.operators.ranking import global_position


def rfm(spark, rec, freq=None, mon=None):
    n = len(rec)
    freq = freq or list(range(1, n + 1))
    mon = mon or [float(x) for x in range(1, n + 1)]
    rows = [(f"c{i}", rec[i], freq[i], mon[i]) for i in range(n)]
    return spark.createDataFrame(rows, "CustomerID string, Recency long, Frequency long, Monetary double")


def test_quartile_edges(spark):
    s = U.rfm_scores(rfm(spark, list(range(1, 9)))).orderBy("Recency").collect()
    assert [r["R_Score"] for r in s] == [4, 4, 3, 3, 2, 2, 1, 1]
    assert [r["F_Score"] for r in sorted(s, key=lambda r: r["Frequency"])] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_quartile_collapse_fails(spark):
    with pytest.raises(Exception):
        U.rfm_scores(rfm(spark, [1, 1, 1, 1, 1, 1, 2, 3])).collect()


def test_global_position_matches_sort(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"k{i}", rnd.choice([1.0, 2.0, 5.0]) if i % 3 else rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["pos"] for r in global_position(df, ["v", "k"]).collect()}
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_recency_floor(spark):
    import datetime as dt
    t = dt.datetime(2011, 1, 10, 12)
    b = spark.createDataFrame([("a", "i1", 10.0, t), ("b", "i2", 5.0, t + dt.timedelta(hours=12))],
                              "CustomerID string, InvoiceNo string, basket_price double, InvoiceDate timestamp_ntz")
    for c in [f"categ_{i}" for i in range(5)]:
        b = b.withColumn(c, F.lit(0.0))
    r = {x["CustomerID"]: x["Recency"] for x in U.rfm_metrics(b).collect()}
    assert r == {"a": 1, "b": 1}   # 36 h -> 1 day; 24 h -> 1 day


@pytest.mark.parametrize("r,f,m,pct,name", [
    (1, 1, 1, 0.96, "Champions"), (4, 4, 3, 0.5, "Champions"), (3, 3, 3, 0.5, "Loyal Customers"),
    (1, 3, 1, 0.5, "At Risk"), (1, 2, 2, 0.5, "Lost"), (2, 1, 3, 0.5, "Need Attention"),
    (3, 1, 2, 0.5, "Promising"), (3, 2, 4, 0.5, "Big Spenders"), (2, 2, 2, 0.5, "Standard"),
    (4, 4, 4, 0.5, "Champions"), (1, 1, 4, 0.5, "At Risk")])
def test_segment_rules(spark, r, f, m, pct, name):
    df = spark.createDataFrame([(float(r), float(f), float(m), pct)], "r double, f double, m double, p double")
    got = df.select(rules.segment_name(F.col("r"), F.col("f"), F.col("m"), F.col("p")).alias("s")).first()["s"]
    assert got == name


def test_label_default(spark):
    cust = spark.createDataFrame([("new",), ("old",)], "CustomerID string")
    seg = spark.createDataFrame([("old", 2)], "CustomerID string, cluster int")
    got = {r["CustomerID"]: r["cluster"] for r in U.label_customers(cust, seg).collect()}
    assert got == {"new": 7, "old": 2}


def test_price_band(spark):
    prices = [-1.0, 0.0, 0.99, 1.0, 2.0, 3.0, 5.0, 10.0, 11.0, None]
    df = spark.createDataFrame([(p,) for p in prices], "p double")
    got = [r["b"] for r in df.select(rules.price_band(F.col("p")).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 2, 3, 4, 5, 5, 0]


def test_trend_zero(spark):
    df = spark.createDataFrame([(5, 0), (15, 10)], "c long, p long")
    assert [r["t"] for r in df.select(rules.trend(F.col("c"), F.col("p")).alias("t")).collect()] == [0.0, 50.0]


def test_table_name():
    assert [text.table_name(t) for t in ("Stage 5--Eval (x)", "--", "a_b__C")] == ["stage_5_eval_x", "artifact", "a_b_c"]


def test_infer_types(spark):
    from tillscope.sources.catalog import infer_column_types
    rows = [(None, "1.0", "1.5", "2011-01-01", "7", "x" * 300), (None, "2.0", "2.0", "2011-01-02", "8", "y")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    got = {r["column"]: r["label"] for r in infer_column_types(df).collect()}
    assert got == {"a": "text", "b": "int", "c": "float", "d": "datetime", "e": "int", "f": "text"}


def test_period_bounds(spark):
    import datetime as dt
    from tillscope.operators.reports import period_masks
    mx = dt.datetime(2011, 12, 9)
    rows = [(mx,), (mx - dt.timedelta(days=30),), (mx - dt.timedelta(days=60),)]
    df = spark.createDataFrame(rows, "InvoiceDate timestamp_ntz")
    cur, prev = period_masks(df, None)
    got = [(r["c"], r["p"]) for r in df.select(cur.alias("c"), prev.alias("p")).collect()]
    assert got == [(True, False), (False, True), (False, False)]


def test_global_position_many_partitions(spark):
    import random
    rnd = random.Random(4)
    rows = [(f"k{i:05d}", float(rnd.choice([1, 2, 3]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["k"]: r["pos"] for r in global_position(df, [F.desc("v"), "k"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
