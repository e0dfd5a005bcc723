"""Stage 4a: line categories, basket rollup and the temporal split."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.timecols import from_micros, micros
from tillscope.schema import CATEG_COLS
from tillscope.session import sent


def stand_in_product_map(clean: DataFrame, n_groups: int = 5) -> DataFrame:
    """Deterministic product -> group map (length of the description mod n): lets
    customer queries be checked against SQL without the clustering step."""
    return (clean.select("Description").where(F.col("Description").isNotNull()).distinct()
            .withColumn("categ_product", (F.length("Description") % n_groups).cast("int")))


def with_category(clean: DataFrame, product_map: DataFrame) -> DataFrame:
    """Lines with their product group; unmapped (or null) descriptions get -1."""
    return (clean.join(sent(product_map.select("Description", "categ_product")), "Description", "left")
            .withColumn("categ_product", F.coalesce("categ_product", F.lit(-1)).cast("int")))


def basket_rollup(clean: DataFrame, product_map: DataFrame, n_groups: int = 5) -> DataFrame:
    """One row per (CustomerID, InvoiceNo) with positive total: basket_price, mean
    line time, and per group the sum of non-negative line totals."""
    lines = with_category(clean, product_map)
    spend = F.greatest(F.col("TotalPrice"), F.lit(0.0))
    aggs = [F.sum("TotalPrice").alias("basket_price"),
            # exact mean time: integer µs sum over the line count, truncated
            F.sum(micros("InvoiceDate").cast("decimal(38,0)")).alias("_s"), F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.when(F.col("categ_product") == i, spend).otherwise(0.0)).alias(f"categ_{i}")
             for i in range(n_groups)]
    return (lines.groupBy("CustomerID", "InvoiceNo").agg(*aggs)
            .filter(F.col("basket_price") > 0)
            .withColumn("_t", F.expr("cast(_s div _n as bigint)"))
            .select("CustomerID", "InvoiceNo", "basket_price", from_micros("_t").alias("InvoiceDate"),
                    *CATEG_COLS[:n_groups]))


def _cut(cut: _dt.date):
    # text -> TIMESTAMP_NTZ: no time zone is involved
    return F.lit(f"{cut.isoformat()} 00:00:00").cast("timestamp_ntz")


def split_baskets(baskets: DataFrame, cut: _dt.date) -> tuple[DataFrame, DataFrame]:
    c = _cut(cut)
    return baskets.filter(F.col("InvoiceDate") < c), baskets.filter(F.col("InvoiceDate") >= c)


def basket_stats(baskets: DataFrame, cut: _dt.date) -> DataFrame:
    """Date range of all baskets and train / test basket counts (one row)."""
    c = _cut(cut)
    return baskets.agg(F.min("InvoiceDate").alias("first_basket"), F.max("InvoiceDate").alias("last_basket"),
                       F.count_if(F.col("InvoiceDate") < c).alias("train_rows"),
                       F.count_if(F.col("InvoiceDate") >= c).alias("test_rows"))
