"""Stage 4b: customer rollup, recency / frequency / monetary scores, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.rules import segment_id, segment_name
from tillscope.functions.timecols import DAY_US, micros
from tillscope.operators.ranking import first_rank_quartile, global_position
from tillscope.schema import CATEG_COLS
from tillscope.session import ensure_checkpoint_dir


def customer_rollup(baskets: DataFrame, n_groups: int = 5, guard_zero: bool = True) -> DataFrame:
    """Per customer: basket count, min, max, mean, sum, each group's % of spend and
    the last basket time (µs).  One hash aggregate (partial + final)."""
    aggs = [F.count(F.lit(1)).alias("count"), F.min("basket_price").alias("min"),
            F.max("basket_price").alias("max"), F.avg("basket_price").alias("mean"),
            F.sum("basket_price").alias("sum"), F.max(micros("InvoiceDate")).alias("last_us")]
    aggs += [F.sum(c).alias(f"_{c}") for c in CATEG_COLS[:n_groups]]
    r = baskets.groupBy("CustomerID").agg(*aggs)
    for c in CATEG_COLS[:n_groups]:
        pct = F.col(f"_{c}") / F.col("sum") * 100
        if guard_zero:
            pct = F.when(F.col("sum") == 0, F.lit(0.0)).otherwise(pct)
        r = r.withColumn(c, pct).drop(f"_{c}")
    return r


def rfm_metrics(train_baskets: DataFrame, n_groups: int = 5) -> DataFrame:
    """Rollup + Recency (whole days from the last basket to the day after the last
    train basket), Frequency (baskets = distinct invoices) and Monetary (spend)."""
    analysis_us = train_baskets.agg(F.max(micros("InvoiceDate"))).scalar() + F.lit(DAY_US)
    r = customer_rollup(train_baskets, n_groups)
    return (r.withColumn("Recency", F.floor((analysis_us - F.col("last_us")) / F.lit(DAY_US)).cast("bigint"))
            .withColumn("Frequency", F.col("count"))
            .withColumn("Monetary", F.col("sum")))


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """R (quartiles of raw recency, 4 = most recent), F and M (quartiles of
    first-come rank), M_Pct (average-rank percentile of spend).  Collapsed quartile
    edges fail the job, like the reference.

    ``rfm`` is fixed first: sums of prices depend on the order of summation in their last digit, so a second
    evaluation could differ, and rows matched on Monetary would be lost."""
    ensure_checkpoint_dir(rfm.sparkSession)
    rfm = rfm.checkpoint(eager=True)
    n = rfm.agg(F.count(F.lit(1))).scalar()
    edges = rfm.agg(F.struct(
        F.min("Recency").cast("double").alias("lo"),
        F.percentile(F.col("Recency"), [0.25, 0.5, 0.75]).alias("q"),
        F.max("Recency").cast("double").alias("hi"))).scalar()
    q = edges["q"]
    collapsed = ((edges["lo"] == q[0]) | (q[0] == q[1]) | (q[1] == q[2]) | (q[2] == edges["hi"]))
    rec = F.col("Recency").cast("double")
    r_score = (F.when(collapsed, F.raise_error(F.lit("recency quartile edges collapse")).cast("double"))
               .when(rec <= q[0], 4.0).when(rec <= q[1], 3.0).when(rec <= q[2], 2.0).when(rec.isNotNull(), 1.0))
    # a customer without recency gets the mean score
    r_score = F.coalesce(r_score, rfm.agg(F.avg(r_score)).scalar())

    f_pos = global_position(rfm.select("CustomerID", "Frequency"), ["Frequency", "CustomerID"], "f_pos")
    m_pos = global_position(rfm.select("CustomerID", "Monetary"), ["Monetary", "CustomerID"], "m_pos")
    # ties meet inside m_pos (one checkpointed evaluation); everything else joins on the customer
    m_ties = m_pos.groupBy("Monetary").agg(((F.min("m_pos") + F.max("m_pos")) / 2.0).alias("m_avg"))
    return (rfm.join(f_pos.select("CustomerID", "f_pos"), "CustomerID")
            .join(m_pos.join(m_ties, "Monetary").select("CustomerID", "m_pos", "m_avg"), "CustomerID")
            .withColumn("R_Score", r_score)
            .withColumn("F_Score", first_rank_quartile(F.col("f_pos"), n))
            .withColumn("M_Score", first_rank_quartile(F.col("m_pos"), n))
            .withColumn("M_Pct", F.col("m_avg") / n.cast("double"))
            .drop("f_pos", "m_pos", "m_avg"))


def with_segments(scored: DataFrame) -> DataFrame:
    name = segment_name(F.col("R_Score"), F.col("F_Score"), F.col("M_Score"), F.col("M_Pct"))
    return scored.withColumn("RFM_Segment", name).withColumn("cluster", segment_id(F.col("RFM_Segment")))


def customer_segments(train_baskets: DataFrame, n_groups: int = 5) -> DataFrame:
    """Everything per train customer: rollup, RFM, scores, segment and its id."""
    return with_segments(rfm_scores(rfm_metrics(train_baskets, n_groups)))


PROFILE_COLS = ["CustomerID", "count", "min", "max", "mean", "sum", *CATEG_COLS,
                "Recency", "Frequency", "Monetary", "RFM_Segment", "cluster"]


def customer_profile(segments: DataFrame) -> DataFrame:
    return segments.select(*PROFILE_COLS)


def test_profile(test_baskets: DataFrame, scale: int = 5, n_groups: int = 5) -> DataFrame:
    """Later-period customers, same statistics; then count *= scale and
    sum = count * mean (only mean and the group shares feed the models)."""
    r = customer_rollup(test_baskets, n_groups, guard_zero=False).drop("last_us")
    r = r.withColumn("count", F.col("count") * scale)
    return r.withColumn("sum", F.col("count") * F.col("mean"))


def label_customers(customers: DataFrame, segments: DataFrame, default: int = 7) -> DataFrame:
    """Segment id learned on the train period; customers unseen there get ``default``."""
    return (customers.join(segments.select("CustomerID", F.col("cluster").alias("_c")), "CustomerID", "left")
            .withColumn("cluster", F.coalesce("_c", F.lit(default)).cast("int")).drop("_c"))


def segment_distribution(segments: DataFrame) -> DataFrame:
    return segments.groupBy("RFM_Segment", "cluster").agg(F.count(F.lit(1)).alias("customers"))


def standardized_rfm(segments: DataFrame) -> DataFrame:
    """(x - mean) / population sd of Recency, Frequency, Monetary (one scalar
    aggregate for all six moments)."""
    names = ("Recency", "Frequency", "Monetary")
    st = segments.agg(F.struct(*[F.avg(c).alias(f"mu_{c}") for c in names],
                               *[F.stddev_pop(c).alias(f"sd_{c}") for c in names])).scalar()
    cols = [((F.col(c) - st[f"mu_{c}"]) / st[f"sd_{c}"]).alias(f"z_{c}") for c in names]
    return segments.select("CustomerID", "cluster", *cols)
