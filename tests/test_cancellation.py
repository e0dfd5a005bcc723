import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tillscope.operators import cancellation as C

COLS = "line_key string, InvoiceNo string, StockCode string, Description string, Quantity long, " \
       "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID string, Country string"
T0 = dt.datetime(2011, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


def lines(spark, rows):
    out = []
    for i, r in enumerate(rows):
        key, stock, qty, t = r[:4]
        desc = r[4] if len(r) > 4 else "item"
        cust = r[5] if len(r) > 5 else "c1"
        out.append((key, f"inv{i}", stock, desc, qty, t, 1.0, cust, "UK"))
    return spark.createDataFrame(out, COLS)


def match_map(spark, rows):
    m = C.match_cancellations(lines(spark, rows))
    return {r["neg_key"]: r["pos_key"] for r in m.collect()}


def test_match_latest(spark):
    assert match_map(spark, [("a", "S", 10, day(1)), ("b", "S", 10, day(2)), ("n", "S", -5, day(3))]) == {"n": "b"}


def test_match_same_time_is_not_earlier(spark):
    assert match_map(spark, [("a", "S", 10, day(1)), ("n", "S", -5, day(1))]) == {}


def test_match_needs_quantity(spark):
    rows = [("a", "S", 4, day(1)), ("n", "S", -5, day(2))]
    assert match_map(spark, rows) == {}
    clean = C.clean_lines(lines(spark, rows))
    assert [r["line_key"] for r in clean.collect()] == ["a"]


def test_last_negative_wins(spark):
    rows = [("a", "S", 10, day(1)), ("n1", "S", -5, day(2)), ("n2", "S", -3, day(3))]
    clean = C.clean_lines(lines(spark, rows)).collect()
    assert [(r["line_key"], r["QuantityCanceled"]) for r in clean] == [("a", 3)]


def test_tie_keeps_lowest_key(spark):
    assert match_map(spark, [("b", "S", 10, day(1)), ("a", "S", 10, day(1)), ("n", "S", -5, day(2))]) == {"n": "a"}


def test_null_stock_codes_match(spark):
    assert match_map(spark, [("a", None, 10, day(1)), ("n", None, -5, day(2))]) == {"n": "a"}


def test_discount_rows(spark):
    rows = [("k1", "D", -1, day(1), "Discount"), ("k2", "X", -1, day(1), "Discount"), ("k3", "D", -1, day(1), "Gift")]
    assert [r["line_key"] for r in C.clean_lines(lines(spark, rows)).collect()] == ["k1"]


def brute(rows):
    df = pd.DataFrame(rows, columns=["key", "stock", "qty", "t", "desc", "cust"])
    neg = df[(df.qty < 0) & (df.desc != "Discount")]
    pos = df[df.qty > 0]
    out = {}
    for _, n in neg.iterrows():
        c = pos[(pos.cust == n.cust) & (pos.stock == n.stock) & (pos.t < n.t) & (pos.qty >= -n.qty)]
        if len(c):
            c = c.sort_values(["t", "key"], ascending=[False, True])
            out[n.key] = c.iloc[0].key
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        q = rnd.choice([1, 2, 3, 5, 8, 12, 40, 100]) * rnd.choice([1, 1, -1])
        rows.append((f"k{i:04d}", rnd.choice(["A", "B", "C"]), q, day(rnd.randrange(20)), "item",
                     rnd.choice(["c1", "c2", "c3"])))
    # a hot key: one customer and item with many lines at the same few times
    for i in range(300):
        rows.append((f"h{i:04d}", "H", rnd.choice([3, 7, -2, -7, 64, -65]), day(rnd.randrange(3)), "item", "c1"))
    assert match_map(spark, rows) == brute(rows)
    # small time buckets exercise the carry between buckets
    for group_rows in (1, 7, 50):
        m = C.match_cancellations(lines(spark, rows), group_rows=group_rows)
        assert {r["neg_key"]: r["pos_key"] for r in m.collect()} == brute(rows)


def test_one_busy_day_is_cut_by_its_times(spark):
    n = 100_000
    d = spark.range(n).select(F.lit("c").alias("CustomerID"), F.lit("=S").alias("sk"), (F.col("id") % 86_400).alias("t"))
    few = spark.createDataFrame([("x", "=S", 5)], "CustomerID string, sk string, t long")
    cuts = C.time_buckets(d.unionByName(few), 500)
    assert [r["CustomerID"] for r in cuts.select("CustomerID").collect()] == ["c"]
    got = d.unionByName(few).join(cuts, ["CustomerID", "sk"], "left").withColumn("bucket", C._bucket(F.col("t"), F.col("cuts")))
    sizes = [r["count"] for r in got.groupBy("CustomerID", "bucket").count().collect()]
    assert sum(sizes) == n + 1 and max(sizes) <= 502 and len(sizes) > 190
    order = got.where("CustomerID = 'c'").groupBy("bucket").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("bucket").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))
