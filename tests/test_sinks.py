import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillscope.sources import catalog as CAT
from tillscope.sources import exports as EXP


def test_load_results_catalog(spark):
    base = tempfile.mkdtemp(prefix="tillscope-cat-")
    os.makedirs(os.path.join(base, "sub"))
    with open(os.path.join(base, "Stage 5--Eval (x).csv"), "w") as f:
        f.write("model,accuracy,when\nLR,0.5,2011-01-01\nRF,1.0,2011-01-02\n")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.option("header", True) \
        .csv(os.path.join(base, "sub", "pairs.csv"))
    out = {r["table_name"]: (r["rows"], r["columns"]) for r in
           CAT.load_results(spark, base, os.path.join(base, "tables")).collect()}
    assert out == {"stage_5_eval_x": (2, 3), "pairs": (2, 2)}
    t = spark.table("stage_5_eval_x")
    assert dict(t.dtypes) == {"model": "string", "accuracy": "double", "when": "timestamp_ntz"}


def test_export_members(spark):
    m = spark.createDataFrame([("a", 0), ("b", 1)], "Description string, categ_product int")
    got = EXP.product_group_members(m, 1).collect()
    assert [(r["Description"], r["ClusterID"]) for r in got] == [("b", 1)]
    with pytest.raises(LookupError):
        EXP.write_export(EXP.product_group_members(m, 4), tempfile.mkdtemp() + "/x", "group 4")
