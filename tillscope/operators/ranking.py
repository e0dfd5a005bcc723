"""Global ranks without a single-partition window.

``row_number() over (order by ...)`` with no partition key moves every row to one
task.  Instead: range-partition and sort on the full order key (Spark samples range
bounds on the composite key, so even one hot value is split by the tie-breaker),
checkpoint that sorted table so its partitioning is fixed, count rows per partition
(one small row per partition), turn the counts into offsets and add each row's index
inside its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.session import ensure_checkpoint_dir


def global_position(df: DataFrame, order_cols: list, name: str = "pos") -> DataFrame:
    """Adds ``name``: the 1-based position of each row in the order of ``order_cols``,
    which must be unique per row (end it with a key)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # no fixed partition count: AQE sizes the range partitions (coalescing keeps them
    # contiguous ranges, and the checkpoint then fixes them)
    ordered = df.repartitionByRange(*cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.call_function("shiftleft", F.col("_pid").cast("bigint"), F.lit(33))
    # offsets has one row per partition: a bounded broadcast
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def first_rank_quartile(pos: Column, n: Column) -> Column:
    """Quartile label 1..4 of a first-come rank (pandas ``qcut`` on ``rank('first')``):
    edges 1 + (n-1)*k/4, right-closed."""
    e = [F.lit(1.0) + (n - 1).cast("double") * k / 4 for k in (1, 2, 3)]
    return (F.when(n < 2, F.raise_error(F.lit("quartile edges collapse: fewer than two rows")).cast("double"))
            .when(pos <= e[0], 1.0).when(pos <= e[1], 2.0).when(pos <= e[2], 3.0).otherwise(4.0))
