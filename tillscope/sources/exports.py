"""Member exports: the products of one group, the customers of one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.operators.reports import period_customers


def product_group_members(product_map: DataFrame, group: int) -> DataFrame:
    m = product_map.select("Description", F.col("categ_product").alias("ClusterID"))
    ok = (F.col("ClusterID").cast("string")).try_cast("int")
    return m.where(ok.isNotNull() & (ok == group)).withColumn("ClusterID", ok)


def segment_members(profile: DataFrame, lines: DataFrame, cluster: int, period: str | None = None) -> DataFrame:
    sel = period_customers(profile, lines, period)
    return sel.where((F.col("cluster").cast("string")).try_cast("int") == cluster)


def write_export(df: DataFrame, path: str, what: str) -> str:
    """Write members as CSV with a header; no members is an error."""
    if df.isEmpty():
        raise LookupError(f"no members found for {what}")
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
