"""Behaviour that the first round got wrong or did not cover."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.functions import text
from tillscope.operators import customers as U
from tillscope.operators import knn as K
from tillscope.operators import models as M
from tillscope.operators import reports as R
from tillscope.operators import shapley as S
from tillscope.schema import CATEG_COLS, FEATURE_COLS
from tillscope.sources import catalog as CAT
from tillscope.sources import invoice_csv as CSV
from tillscope.sources import results as RES


def test_every_customer_keeps_a_score(spark):
    rnd = random.Random(5)
    rows = [(f"c{rnd.randrange(800)}", f"i{i}", rnd.randrange(1, 9999) / 100, i) for i in range(6000)]
    b = spark.createDataFrame(rows, "CustomerID string, InvoiceNo string, basket_price double, h long")
    b = b.withColumn("InvoiceDate", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ'2010-01-01 00:00:00')")).drop("h")
    for c in CATEG_COLS:
        b = b.withColumn(c, F.col("basket_price") / 5)
    n = b.select("CustomerID").distinct().count()
    for layout in (b.repartition(3), b.repartition(13, "InvoiceNo")):
        scored = U.customer_segments(layout)
        assert scored.count() == n and scored.where("M_Score is null or M_Pct is null").count() == 0


def write(path, content):
    path.write_bytes(content.encode("latin-1"))
    return str(path)


HEADER = "StockCode,InvoiceNo,Extra,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def test_csv_is_read_by_header_name(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + '85123A,536365,x,"WHITE\nHEART, ""BIG""",6,12/1/2010 8:26,2.55,17850,Réunion\n')
    r = CSV.read_invoices(spark, path).first()
    assert (r.InvoiceNo, r.StockCode, r.Description, r.Quantity, r.Country) == ("536365", "85123A", 'WHITE\nHEART, "BIG"', 6, "Réunion")
    assert str(r.InvoiceDate) == "2010-12-01 08:26:00"
    with pytest.raises(ValueError):
        CSV.read_invoices(spark, write(tmp_path / "b.csv", "InvoiceNo,Quantity\n1,2\n"))


def test_upload_preview_of_text_dates(spark):
    d = spark.createDataFrame([("12/1/2010 8:26", 1), ("2011-02-03", 2), ("soon", 3), (None, 4)], "`Invoice Date` string, n int")
    assert sorted(r.period for r in R.upload_preview_periods(d).collect()) == ["2010-12", "2011-02"]
    assert R.date_column(["a", "INVOICE_DATE"]) == "INVOICE_DATE" and R.date_column(["a"]) is None


def test_stock_codes_are_no_numbers(spark):
    d = spark.createDataFrame([("85123D", "1", "1e3", " 2.5 "), ("10F", "2", "-4.", "True")], "a string, b string, c string, d string")
    labels = {r["column"]: r["label"] for r in CAT.infer_column_types(d).collect()}
    assert labels == {"a": "varchar", "b": "int", "c": "int", "d": "varchar"}
    assert [r.a for r in CAT.cast_by_labels(d, labels).collect()] == ["85123D", "10F"]


def test_null_countries_are_no_region(spark):
    lines = spark.createDataFrame([("UK",), ("UK",), ("FR",), (None,)], "Country string") \
        .withColumn("InvoiceDate", F.expr("TIMESTAMP_NTZ'2011-01-05 00:00:00'"))
    got = {r.name: r.pct for r in R.region_share(lines, "2011").collect()}
    assert got == {"UK": 66.7, "FR": 33.3}


def test_roots_of_plurals(spark):
    words = ["boxes", "dishes", "churches", "glasses", "buses", "ladies", "cats", "bus", "gas"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.plural_root(F.col("w")).alias("r")).collect()
    assert [r.r for r in got][:4] == ["box", "dish", "church", "glass"] and [r.r for r in got][6:] == ["cat", "bus", "gas"]


def test_period_questions_prune(spark, tmp_path):
    lines = spark.range(400).select(F.expr("timestampadd(DAY, cast(id as int), TIMESTAMP_NTZ'1999-06-01 00:00:00')").alias("InvoiceDate"),
                                    F.lit(1.0).alias("TotalPrice"), F.lit("x").alias("Other"))
    table = RES.write_by_month(lines, str(tmp_path / "t"))
    daily = R.daily_sales(table, "1999")
    plan = daily._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(invoice_month" in plan and "GreaterThanOrEqual(InvoiceDate" in plan
    scan = plan[plan.rindex("FileScan"):]
    assert "Other" not in scan and daily.count() == 214 and R.daily_sales(lines, "1999").count() == 214


def frame(spark, n=200, classes=4, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = rnd.randrange(classes)
        rows.append((f"c{i}", c, *[rnd.gauss(c * (j + 1), 1.0) for j in range(len(FEATURE_COLS))]))
    cols = ", ".join(f"`{f}` double" for f in FEATURE_COLS)
    return spark.createDataFrame(rows, f"CustomerID string, cluster int, {cols}")


def test_split_takes_the_whole_share(spark):
    sizes = {0: 701, 1: 333, 2: 211, 3: 150, 4: 64, 5: 27, 6: 13, 7: 1}
    rows = [(f"c{k}-{i}", k) for k, n in sizes.items() for i in range(n)]
    s = M.stratified_split(spark.createDataFrame(rows, "CustomerID string, cluster int"))
    got = {(r.cluster, r.part): r["count"] for r in s.groupBy("cluster", "part").count().collect()}
    assert s.count() == 1500 and sum(n for (_, p), n in got.items() if p == "train") == 1200
    assert all(abs(got.get((k, "train"), 0) - 0.8 * n) < 1 for k, n in sizes.items())


def test_families_score_probabilities(spark):
    data = M.model_frame(frame(spark)).withColumn("fold", (F.abs(F.xxhash64("CustomerID")) % 3).cast("int"))
    split = data.withColumn("part", F.lit("train"))
    grid = {"SVC": {"C": [1.0]}, "LR": {"C": [1.0]}, "DT": {"impurity": ["gini"], "subset": ["sqrt"]}, "KNN": {"k": [1, 3, 5]},
            "RF": {"impurity": ["gini"], "trees": [5], "subset": ["sqrt"]}, "GB": {"rounds": [3]}, "ADA": {"rounds": [3]}, "folds": 3}
    M.GRIDS["test"] = grid
    fitted = M.fit_suite(split, "test")
    fitted["VOTE"] = M.vote(fitted)
    ev, preds = M.evaluate(fitted, data, "s", list(fitted))
    for r in preds.collect():
        p = [r[f"p_{c}"] for c in range(8)]
        assert abs(sum(p) - 1) < 1e-6 and min(p) >= 0 and p[r.y_pred] == max(p)
    acc = {r.model: r.accuracy for r in ev.collect()}
    assert acc["LR"] > 0.9 and acc["RF"] > 0.9 and acc["KNN"] > 0.9 and acc["VOTE"] > 0.9
    # boosted one-vs-rest: the score of a class is sigma(2 raw), normalised
    import math
    one = data.limit(1)
    x = [list(one.first()["features"])]
    sigma = [1 / (1 + math.exp(-2 * r)) for r in fitted["GB"].model.raw(np.array(x))[0]]
    got = fitted["GB"].score(one).first()["p"]
    assert all(abs(g - s / sum(sigma)) < 1e-9 for g, s in zip(got, sigma))
    # AdaBoost: votes are shares of alpha, softmax of share / (K - 1)
    share, total = [0.0] * 8, sum(s[4] for s in fitted["ADA"].model.stages)
    for f, cut, left, right, alpha in fitted["ADA"].model.stages:
        share[left if x[0][f] <= cut else right] += alpha / total
    e = [math.exp(v / 7) for v in share]
    assert all(abs(v / sum(e) - p) < 1e-9 for v, p in zip(e, fitted["ADA"].score(one).first()["p"]))


def test_block_knn_matches_the_join(spark):
    rnd = random.Random(2)
    t = spark.createDataFrame([(i, rnd.randrange(3), [float(rnd.randrange(4)) for _ in range(3)]) for i in range(120)], "tid long, label int, x array<double>")
    q = spark.createDataFrame([(i, [float(rnd.randrange(4)) for _ in range(3)]) for i in range(60)], "qid long, x array<double>")
    for k in (1, 5, 7):
        want = {r.qid: r.p for r in K.vote_scores(K.neighbours(t, q, k), k, 3).collect()}
        rows = spark.sparkContext.broadcast(K.TrainRows(t))
        got = {r.qid: r.p for r in K.block_scores(q.withColumnRenamed("x", "_x"), rows, k, 3).collect()}
        assert all(sum(abs(a - b) for a, b in zip(want[i], got[i])) < 1e-9 for i in want)


def test_linear_shapley_is_the_coalition_value(spark):
    x = frame(spark, 12)
    w = [[0.5, -1.0, 2.0, 0.0, 1.5, -0.25], [1.0] * 6]
    explain, background = x.limit(5), x
    linear = {r.CustomerID: r.phi for r in S.linear_values(explain, background, w, [0, 1]).collect()}
    pts = S.coalition_points(explain, background)
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    scored = pts.withColumn("p", F.array(*[sum((v[j] * w[c][j] for j in range(6)), F.lit(0.0)) for c in range(2)]))
    for r in S.shapley(scored, 2, [0, 1]).collect():
        assert all(abs(a - b) < 1e-6 for p, q in zip(r.phi, linear[r.CustomerID]) for a, b in zip(p, q))


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from tillscope import session

    class Context:
        master = "spark://host:7077"
        def getCheckpointDir(self): return None

    class Conf:
        def get(self, *_): return None

    class Spark:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Spark())


def test_chain_through_stage_8(spark, tmp_path):
    from tillscope.params import driver_params
    from tillscope.plans.report import report_bundle
    from tillscope.plans.stages import run_stages
    from tillscope.sources.driver_tables import transactions

    M.GRIDS["tiny"] = {"SVC": {"C": [1.0]}, "LR": {"C": [1.0]}, "DT": {"impurity": ["gini"], "subset": ["sqrt"]}, "KNN": {"k": [1, 5]},
                       "RF": {"impurity": ["gini"], "trees": [3], "subset": ["sqrt"]}, "GB": {"rounds": [2]}, "ADA": {"rounds": [2]}, "folds": 2}
    params = driver_params(grid="tiny", explain_rows=10, background_rows=5)
    out = run_stages(spark, transactions(spark, "/root/testdata/sf0.001"), params, upto=8, folder=str(tmp_path))
    assert {r.model for r in out["model_eval"].collect()} >= {"SVC", "VOTE", "Gradient Boosting"}
    fitted = RES.load_models(spark, f"{tmp_path}/models")
    assert set(fitted) == {"SVC", "LR", "DT", "RF", "GB", "KNN", "ADA", "VOTE"}
    hold = out["split"].where("part = 'test'")
    _, again = M.evaluate(fitted, hold, "stage5", ["LR", "RF", "GB", "KNN", "ADA", "VOTE"])
    before = {(r.model, r.CustomerID): r.y_pred for r in out["model_predictions"].where("stage = 'stage5'").collect()}
    rows = again.collect()
    assert rows and all(before[r.model, r.CustomerID] == r.y_pred for r in rows)
    assert RES.read_metrics(spark, f"{tmp_path}/metrics")["rows"]["customers"] == out["customer_segments"].count()
    report = report_bundle(out["transactions_clean"], out["customer_profile"], out["product_clusters"], None, model_eval=out["model_eval"],
                           shap_importance=out["shap_importance"], shap_values=out["shap_values"])
    assert all(report[k].count() > 0 for k in ("kpis", "products", "segments", "evaluation", "shap_importance", "shap_values"))
