"""Steps of the fifth round: the line chain shuffles the rows that lines are made of, in tasks of bounded size."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_cancellation import day, lines
from tillscope import session
from tillscope.operators import cancellation as C
from tillscope.plans.context import Context
from tillscope.params import driver_params
from tillscope.sources import driver_tables as T
from tillscope.sources import results as RES


def tables(spark, folder):
    """Small driver tables: repeated and null keys, null texts, one large month, lines without a date."""
    when = lambda i: None if i % 31 == 0 else dt.datetime(2000, 3, 1 + i % 28) if i % 2 else dt.datetime(1999, 1 + i % 12, 5, i % 24)
    made = {
        "nation": ([(0, "FRANCE"), (1, "PERU")], "n_nationkey long, n_name string"),
        "customer": ([(i, i % 3) for i in range(8)] + [(1, 0), (None, 1)], "c_custkey long, c_nationkey long"),
        "part": ([(i, f"ring {i % 4}" if i % 5 else None, f"Brand#{i % 3}", i) for i in range(10)] + [(2, "bolt", None, None)],
                 "p_partkey long, p_name string, p_type string, p_size int"),
        "orders": ([(i, i % 9) for i in range(120)] + [(7, 2), (None, 3)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i % 125 if i % 40 else None, i % 8 if i % 13 else None, i % 11, i % 5 if i % 17 else None, float(i % 6) if i % 19 else None,
                       "RAN"[i % 3] if i % 23 else None, when(i)) for i in range(600)] * 2,
                     "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_lines_are_dealt_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path)
    monkeypatch.setattr(RES, "TASK_LINES", 100)
    dealt = T.transactions(spark, str(tmp_path), dealt=True)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" in plan.split("Repartition")[0] and "concat_ws" not in plan.split("Repartition")[1]   # whole lines were shuffled before
    want = T.transactions(spark, str(tmp_path)).dropna(subset=["CustomerID"]).dropDuplicates()
    got = Context(spark, str(tmp_path), driver_params()).dedup()
    assert got.columns == want.columns and got.count() > 300
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_task_takes_a_bounded_part_of_a_month(spark, monkeypatch):
    monkeypatch.setattr(RES, "TASK_LINES", 100)
    rows = spark.range(2000).select("id", F.expr("if(id % 10 = 0, if(id % 50 = 0, null, timestampadd(MONTH, cast(id % 30 as int), TIMESTAMP_NTZ'1999-01-01')),"
                                                 " TIMESTAMP_NTZ'2000-03-05')").alias("at"))
    out = RES.deal(rows, "at", "id", rows).withColumn("task", F.spark_partition_id())
    assert out.where(f"task <> {RES.DEAL}").count() == 0 and out.count() == 2000   # rows without a time too
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    assert max(sizes) < 200 and len(sizes) < 25   # one month of 1,800 rows, three of some 60 and the null one
    assert RES.deal(rows.limit(0), "at", "id", rows.limit(0)).count() == 0


def test_settings_are_put_back(spark, tmp_path):
    tables(spark, tmp_path)
    before = {k: spark.conf.get(k, None) for k in session.LINE_TABLES}
    Context(spark, str(tmp_path), driver_params()).clean()
    assert {k: spark.conf.get(k, None) for k in session.LINE_TABLES} == before


def test_cancelled_quantities_are_sent_up_to_four_times_the_rows(spark, monkeypatch):
    rows = [r for i in range(12) for r in ((f"p{i}", f"S{i}", 5, day(i)), (f"q{i}", f"S{i}", -3, day(i + 1)))]
    t = lines(spark, rows).checkpoint()
    m = C.match_cancellations(t).checkpoint()
    monkeypatch.setattr(session, "SENT_ROWS", 4)
    assert m.count() == 12
    for most, sent in ((4, True), (2, False)):   # 12 rows: more than four, at most sixteen
        monkeypatch.setattr(session, "SENT_ROWS", most)
        clean = C.clean_lines(t, m)
        assert ("broadcast" in clean._jdf.queryExecution().optimizedPlan().toString()) == sent
        assert {r["QuantityCanceled"] for r in clean.collect()} == {3} and clean.count() == 12
