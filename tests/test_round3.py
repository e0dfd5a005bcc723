"""Steps that had to grow no faster than their input: training tables, forests, the line chain, invoice files."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tests.test_cancellation import COLS, brute, day, lines
from tests.test_many_models import labelled, values
from tillscope import session
from tillscope.operators import baskets as B
from tillscope.operators import cancellation as C
from tillscope.operators import forests as FO
from tillscope.operators import kmeans as KM
from tillscope.operators import knn as KNN
from tillscope.operators import models as M
from tillscope.operators import passes as P
from tillscope.operators import shapley as S
from tillscope.sources import invoice_csv as CSV
from tillscope.sources import results as RES


def test_training_rows_are_spread_by_their_number(spark):
    one = spark.range(13_000).withColumnRenamed("id", "rid").coalesce(1)
    assert P.spread_rows(one, 13_000, "rid").rdd.getNumPartitions() == 3   # came as one partition, stayed one
    assert P.spread_rows(one, 400, "rid").rdd.getNumPartitions() == 1
    assert [P.row_parts(n) for n in (0, 6_000, 72_000, 720_000, 4_300_000)] == [1, 1, 12, 16, 86]


def test_forests_travel_packed(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(400, 4)), 1), rng.integers(0, 8, 400)   # ties leave impure leaves
    whole = FO.grow(x, y, 8, "gini", 2, list(range(9)), 7, True)
    parts = [FO.grow(x, y, 8, "gini", 2, list(range(a, b)), 7, True) for a, b in ((0, 4), (4, 5), (5, 9))]
    got = FO.Forest.unpacked([p.packed() for p in parts], 8)
    assert (got.roots == whole.roots).all() and (got.left == whole.left).all() and (got.value == whole.value).all()
    assert (got.votes(x) == whole.votes(x)).all()
    node_bytes = sum(a.nbytes for a in (got.feature, got.threshold, got.left, got.code)) / len(got.feature)
    assert node_bytes <= 20   # a row of Python objects per node before
    boxes = [whole.boxes(4, range(a, b)) for a, b in ((0, 4), (4, 9))]
    for a, b in zip(whole.boxes(4), (np.concatenate(t) for t in zip(*boxes))):
        assert (a == b).all()
    low, high, share = whole.boxes(4, range(2, 3))
    inside = ((x[:, None] > low) & (x[:, None] <= high)).all(2)
    assert (inside.sum(1) == 1).all()   # leaves of a tree tile the space


def test_forest_values_by_trees_equal_values_by_rows(spark):
    d = labelled(spark, n=80, spread=3.0, folds=2)
    rows = d.collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([int(r["label"]) for r in rows])
    forest = FO.grow(x, y, 8, "gini", 2, list(range(10)), 3, True)
    explain, back = d.orderBy("CustomerID").limit(6), S.feature_rows(d.orderBy("CustomerID").limit(9))
    want = values(S.row_values(explain, S.forest_phi(forest, back), 8, [0, 1, 2, 3]))
    got = values(S.forest_values(explain, spark.sparkContext.broadcast(forest), back, 8, [0, 1, 2, 3]))
    assert set(want) == set(got) and max(np.abs(want[k] - got[k]).max() for k in want) < 1e-12


def test_members_of_a_vote_are_scored_once(spark, monkeypatch):
    M.GRIDS["vote"] = {"RF": {"impurity": ["gini"], "trees": [3], "subset": ["sqrt"]}, "GB": {"rounds": [2]}, "KNN": {"k": [3]}, "folds": 2}
    d = labelled(spark, n=90, folds=2).withColumn("part", F.lit("train"))
    fitted = M.fit_suite(d, "vote", names=("RF", "GB", "KNN"))
    fitted["VOTE"] = M.vote(fitted)
    asked, score = [], M.Fitted.score
    monkeypatch.setattr(M.Fitted, "score", lambda self, *a: asked.append(self.name) or score(self, *a))
    ev, preds = M.evaluate(fitted, d, "s", ["RF", "GB", "KNN", "VOTE"])
    assert sorted(asked) == ["GB", "KNN", "RF", "VOTE"] and preds.count() == 4 * 90
    p = {(r["model"], r["CustomerID"]): r["p_1"] for r in preds.collect()}
    assert all(abs(p["VOTE", c] - (p["RF", c] + p["GB", c] + p["KNN", c]) / 3) < 1e-12 for m, c in p if m == "VOTE")


def test_blocks_of_queries_follow_the_training_rows():
    t = KNN.TrainRows.__new__(KNN.TrainRows)
    for n, want in ((0, 256), (1_000, 256), (72_000, 55), (250_000, 16)):
        t.x = np.zeros((n, 6))
        assert t.block() == want


def test_kmeans_table_has_partitions_by_rows(spark):
    from pyspark.ml.functions import array_to_vector
    d = spark.range(500).select(F.col("id").cast("string").alias("k"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features")).repartition(24)
    assert KM.vector_table(d, "k").parts == 1   # 24 matrices a pass before


def odd_lines(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(500):
        q = rnd.choice([1, 2, 5, 9]) * rnd.choice([1, 1, -1])
        rows.append((f"k{i:04d}", rnd.choice("ABCDEFGH"), q, day(rnd.randrange(90)), "item", f"c{rnd.randrange(20)}"))
    return rows


def test_only_pairs_that_can_match_are_kept(spark):
    rows = [("a", "S", 4, day(1)), ("n", "S", -3, day(2)),                       # can match
            ("b", "T", 4, day(2)), ("o", "T", -3, day(2)),                       # not earlier
            ("c", "U", 2, day(1)), ("p", "U", -3, day(2)), ("d", "V", 2, day(1)), ("q", "W", -1, day(1))]
    t = lines(spark, rows).withColumn("sk", C._stock_key())
    neg, pos = C.negative_candidates(t), C.positive_candidates(t)
    neg, pos = (d.withColumn("sk", C._stock_key()) for d in (neg, pos))
    want = t.where("StockCode = 'S'").select(C._pair()).distinct().collect()
    assert C.matchable_pairs(neg, pos).collect() == want


def test_a_purchase_without_a_time_is_earlier_than_any(spark):
    rows = [("a", "S", 4, None), ("n", "S", -3, day(2)), ("b", "T", 4, None), ("c", "T", 9, day(1)), ("o", "T", -3, day(2)), ("p", "U", -3, None)]
    m = C.match_cancellations(lines(spark, rows))
    assert {r["neg_key"]: r["pos_key"] for r in m.collect()} == {"n": "a", "o": "b"}   # as without leaving lines out


def test_tables_too_large_to_send_are_joined(spark, monkeypatch):
    rows = odd_lines(spark)
    t = lines(spark, rows).checkpoint()
    found = {}
    for most in (10 ** 6, 0):
        monkeypatch.setattr(session, "SENT_ROWS", most)
        m = C.match_cancellations(t).checkpoint()
        found[most] = ({r["neg_key"]: r["pos_key"] for r in m.collect()}, sorted(C.clean_lines(t, m).collect()),
                       sorted(r["neg_key"] for r in C.unmatched_cancellations(t, m).collect()))
    assert found[0] == found[10 ** 6] and found[0][0] == brute(rows) and found[0][0] and found[0][2]
    assert "BroadcastHashJoin" not in C.clean_lines(t, m)._jdf.queryExecution().optimizedPlan().toString()
    cats = spark.createDataFrame([("item", 2)], "Description string, categ_product int")
    assert {r["categ_product"] for r in B.with_category(t, cats).collect()} == {2}


def test_distinct_lines_are_written_by_month_in_one_shuffle(spark, tmp_path):
    t = lines(spark, [(f"k{i}", "S", i % 5 + 1, day(3 * i), "item", f"c{i % 7}" if i % 10 else None) for i in range(100)])
    none = spark.createDataFrame([("x", "i", "S", "d", 1, None, 1.0, "c1", "UK")], COLS)
    t = t.unionByName(t.limit(40)).unionByName(none).unionByName(none)
    got = RES.distinct_by_month(t, str(tmp_path / "a"))
    assert got.columns == t.columns and got.count() == 91
    assert sorted(map(str, got.collect())) == sorted(map(str, t.dropna(subset=["CustomerID"]).dropDuplicates().collect()))
    months = {p.name for p in (tmp_path / "a").iterdir() if p.is_dir()}
    assert len(months) == 11 and f"{RES.MONTH}=2011-01" in months
    other = t.withColumn("line_key", F.concat("line_key", F.monotonically_increasing_id().cast("string")))
    assert RES.distinct_by_month(other, str(tmp_path / "b"), key_in_data=False).count() == 91
    # lines that lie by month are written without a further shuffle
    again = RES.write_by_month(got, str(tmp_path / "c"), laid_out=True)
    assert again.count() == 91 and {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == months


def test_a_date_is_parsed_once(spark):
    d = spark.createDataFrame([("2011-02-03 04:05:06",), ("2/3/2011 4:05",), ("2011-02-30 00:00:00",), (None,)], "v string")
    strict, loose = (CSV.parse_invoice_date(F.col("v"), s) for s in (True, False))
    assert [r[0] for r in d.select(loose).collect()] == [dt.datetime(2011, 2, 3, 4, 5, 6), dt.datetime(2011, 2, 3, 4, 5), None, None]
    text = lambda c: d.select(c.alias("t"))._jdf.queryExecution().analyzed().toString()
    assert text(strict).count("regexp_extract") == text(loose).count("regexp_extract")   # twice as many before


def test_odd_quotes_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"a ""b"""\n""\nplain\n', "latin-1")
    (tmp_path / "b.csv").write_text('h\n"a\nb"\n', "latin-1")
    short, long = CSV.files_with_long_records(spark, str(tmp_path))
    assert [f[-5:] for f in short] == ["a.csv"] and [f[-5:] for f in long] == ["b.csv"]
