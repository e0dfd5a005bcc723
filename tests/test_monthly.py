import random

from pyspark.sql import functions as F

from tillscope.operators import cancellation as C
from tillscope.operators import reports as R
from tillscope.operators.monthly import MonthlyState, changed_months
from tillscope.sources.results import write_by_month

LINE = ("line_key string, InvoiceNo string, StockCode string, Description string, Quantity long, UnitPrice double, CustomerID string, "
        "Country string, at string")


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE).withColumn("InvoiceDate", F.to_timestamp_ntz("at", F.lit("yyyy-MM-dd HH:mm"))).drop("at")


def make(seed, n, load, months):
    rnd = random.Random(seed)
    return [(f"k{load}-{i:04d}", f"i{load}-{i // 3}", rnd.choice("AB"), rnd.choice(["mug", "plate", None, "box"]), rnd.choice([1, 4, 9, -1, -4]),
             rnd.randrange(1, 40) / 4, f"c{rnd.randrange(15)}", rnd.choice(["UK", "FR", None]),
             f"{rnd.choice(months)}-{rnd.randrange(1, 29):02d} {rnd.randrange(8, 20):02d}:{rnd.randrange(60):02d}") for i in range(n)]


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_three_loads_equal_the_direct_form(spark, tmp_path):
    state, seen, before = MonthlyState(spark, str(tmp_path / "state")), [], None
    profile = spark.createDataFrame([(f"c{i}", i % 3, 10.0 + i, 100.0 * i, i, *[float(i * j % 7) for j in range(5)]) for i in range(15)],
                                    "CustomerID string, cluster int, mean double, sum double, count long, " + ", ".join(f"categ_{j} double" for j in range(5)))
    groups = spark.createDataFrame([("mug", 0), ("plate", 1), ("box", 1), ("never sold", 0)], "Description string, categ_product int")
    loads = [make(1, 300, 0, ["2010-11", "2010-12", "2011-01"]), make(2, 60, 1, ["2011-02"]),
             [("k2-x", "i2-x", "A", "mug", -9, 1.0, "c3", "UK", "2011-02-27 23:00")]]   # a cancellation alone
    touched = []
    for n, new in enumerate(loads):
        seen += new
        clean = write_by_month(C.clean_lines(lines(spark, seen)), str(tmp_path / f"clean{n}"))
        months = changed_months(before, clean)
        touched.append(months)
        state.load(clean, n, months)
        if n == 1:
            state.load(clean, n, months)   # a load that runs again
        before = clean
        view = state.orders()
        for period in ("2010", "2011-02"):
            assert rows(R.kpi_overview(view, period)) == rows(R.kpi_overview(clean, period)), (n, period)
            if n < 2:
                continue
            assert rows(R.segment_summary(profile, view, period)) == rows(R.segment_summary(profile, clean, period))
            assert rows(R.segment_trend(profile, view, period)) == rows(R.segment_trend(profile, clean, period))
            assert rows(state.daily_sales(period)) == rows(R.daily_sales(clean, period))
            assert rows(state.region_share(period)) == rows(R.region_share(clean, period))
            assert rows(R.product_cluster_summary(groups, None, period, state.product_stats(period))) == rows(R.product_cluster_summary(groups, clean, period))
        if n < 2:
            continue
        assert rows(state.monthly_sales("2010")) == rows(R.monthly_sales(clean, "2010"))
        assert rows(state.repeat_interval()) == rows(R.repeat_interval(clean))
        assert rows(R.available_periods(view)) == rows(R.available_periods(clean))
    assert touched[0] == ["2010-11", "2010-12", "2011-01"] and "2011-02" in touched[1]
    assert len(touched[2]) == 1   # the month of the purchase that the last load cancels


def test_questions_prune_months_and_months_can_empty(spark, tmp_path):
    state = MonthlyState(spark, str(tmp_path))
    rows_ = make(5, 80, 0, ["2010-11", "2010-12"])
    state.load(C.clean_lines(lines(spark, rows_)), 0)
    plan = state.product_stats("2010-11")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "2010-12" not in plan[plan.rindex("PartitionFilters"):].split("]")[0]
    kept = [r for r in rows_ if not r[8].startswith("2010-12")]
    state.load(C.clean_lines(lines(spark, kept)), 1, ["2010-12"])   # nothing is left of that month
    assert {r["period"] for r in R.available_periods(state.orders()).collect()} == {"2010-11", "2010"}
    assert state.daily_sales("2010-12").count() == 0
