"""Driver tables -> the invoice-line model.

The generated TPC-H-like tables carry no invoice file, so every stage starts from
this view (rule fixed in FIXTURES.md section 2): one line per lineitem, returned
lines are negative quantities, returned line 7 becomes a discount line, every 50th
order has no customer and every 97th order appears twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources.results import DEAL, deal

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The view.  ``dealt``: only its lines with a customer, for ``results.distinct_by_month``: the rows that lines are made of
    are shuffled by month (with the column ``DEAL``), and their texts are put together afterwards."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_returnflag") == "R").alias("returned"), "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # 25 nations: a bounded dimension, safe to broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    # keys and numbers are joined first: names and texts of an order's customer and of a part are put to its lines last
    customer = F.when(F.col("o_orderkey") % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("o_custkey").cast("string"))
    bought = orders.join(cust, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_custkey", "c_nationkey")
    j = (li.join(bought, F.col("o_orderkey") == F.col("l_orderkey"))
           .join(part, F.col("p_partkey") == F.col("l_partkey"))
           .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
           .drop("l_orderkey", "p_partkey", "c_nationkey", "n_nationkey"))
    if dealt:   # equal lines are of one order and time
        j = deal(j.where(customer.isNotNull()), "l_shipdate", "o_orderkey", li.select("l_shipdate"))
    discount = (F.col("l_linenumber") == 7) & F.col("returned")
    qty = F.when(F.col("returned"), -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    b = j.select(
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.when(discount, F.lit("D")).otherwise(F.concat_ws("-", "p_name", "p_type")).alias("StockCode"),
        F.when(discount, F.lit("Discount"))
         .otherwise(F.concat_ws(" ", F.col("p_name"), F.lower("p_type"))).alias("Description"),
        qty.cast("bigint").alias("Quantity"),
        F.col("l_shipdate").alias("InvoiceDate"),
        (F.col("p_size").cast("double") / 4).alias("UnitPrice"),
        customer.alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("bigint").cast("string"),
                    F.col("l_shipdate").cast("date").cast("string")).alias("line_key"),
        *([DEAL] if dealt else []))
    # UNION ALL of the view and its every-97th-order rows, in one pass: such rows are
    # emitted twice by a generator instead of scanning and joining the tables twice
    copies = F.when(F.col("InvoiceNo").cast("bigint") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return b.withColumn("_copy", F.explode(copies)).drop("_copy")
