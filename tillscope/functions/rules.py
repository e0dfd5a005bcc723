"""Row rules as Spark expressions (no Python UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.schema import CHAMPION_PERCENTILE, SEGMENT_IDS, SEGMENT_STORIES


def segment_name(r: Column, f: Column, m: Column, m_pct: Column) -> Column:
    """RFM segment, first matching rule wins."""
    return (F.when(m_pct >= CHAMPION_PERCENTILE, "Champions")
            .when((r == 4) & (f == 4) & (m >= 3), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
            .when((r == 1) & ((f >= 3) | (m >= 3)), "At Risk")
            .when((r == 1) & (f <= 2) & (m <= 2), "Lost")
            .when((r == 2) & ((f >= 3) | (m >= 3)), "Need Attention")
            .when((r >= 3) & ((f == 1) | (m == 1)), "Promising")
            .when(m >= 4, "Big Spenders")
            .otherwise("Standard"))


def segment_id(name: Column) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SEGMENT_IDS.items()))
    return m[name]


def segment_label(cluster_id: Column) -> Column:
    """Name of a cluster id; unknown ids read ``Cluster <id>``."""
    m = F.create_map(*chain.from_iterable((F.lit(v), F.lit(k)) for k, v in SEGMENT_IDS.items()))
    return F.coalesce(m[cluster_id.cast("int")], F.concat(F.lit("Cluster "), cluster_id.cast("string")))


def trend(cur: Column, prev: Column) -> Column:
    """(cur - prev) / prev * 100, one decimal (half-up); 0 when prev is 0."""
    return F.when(prev == 0, F.lit(0.0)).otherwise(
        F.round((cur - prev).cast("double") / prev.cast("double") * 100, 1))


def segment_story(freq: Column, total_spend: Column, avg_basket: Column, global_basket: Column) -> Column:
    s = SEGMENT_STORIES
    return (F.when(freq > 50, s[0])
            .when((freq > 15) & (total_spend > 5000), s[1])
            .when((freq > 10) & (total_spend > 5000), s[2])
            .when(freq > 10, s[3])
            .when((total_spend > 5000) & (freq < 5), s[4])
            .when(total_spend > 2000, s[5])
            .when(avg_basket > global_basket * 1.5, s[6])
            .when((freq < 2.5) & (avg_basket < global_basket * 0.7), s[7])
            .otherwise(s[8]))


def price_band(price: Column) -> Column:
    """Index 0..5 of the price band (edges 0,1,2,3,5,10, left-closed; below 0 -> 0,
    10 and above -> 5; null -> 0)."""
    p = F.coalesce(price, F.lit(0.0))
    return (F.when(p < 1, 0).when(p < 2, 1).when(p < 3, 2).when(p < 5, 3).when(p < 10, 4).otherwise(5))
