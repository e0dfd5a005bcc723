"""Stage 2: offset cancellations against the latest earlier purchase.

Rule: a negative line (not a 'Discount') cancels the latest positive line of the
same customer and stock code (null stock codes match each other) that is strictly
earlier and has at least the cancelled quantity; equal times keep the lowest
positive key.  A positive hit by several negatives keeps the quantity of the last
(highest key) negative.  All such negatives are then removed, and so is every other
negative line except Discount lines with stock code 'D'.

Scale design.  The plain form is an equi-join on (customer, stock code) with a
time and quantity residual, which emits every (negative, positive) pair of a key:
quadratic for a hot key.  Here the quantity condition ``q >= a`` is split over the
binary digits of the quantities (a segment tree over [0, 2^L)): each positive is
filed under L nodes, each negative asks at most L+1 disjoint nodes, and within one
node only the time condition is left, which is a running minimum.  Running minima
are computed in two levels so that no single task holds a whole key: per time bucket
(partial aggregation) with a carry over earlier buckets (a window over bucket
summaries, one row per active bucket), and inside the bucket a range window.  Buckets
follow the data: a customer and item of up to ``group_rows`` lines is one bucket; a
larger one is cut by its histogram of times into buckets of about that many lines (lines
of one instant cannot meet each other and stay together).  Rows grow by a factor
L = bit length of the largest cancelled quantity; nothing is quadratic and nothing is
capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import session
from tillscope.functions.timecols import micros
from tillscope.session import ensure_checkpoint_dir, sent

_KEYS = ["CustomerID", "sk", "lvl", "node"]


def _shl(c, n):
    return F.call_function("shiftleft", c, n)


def _shr(c, n):
    return F.call_function("shiftright", c, n)


def _stock_key():
    # non-null key with null-safe equality semantics: '=' + code, or '\0' for null
    return F.when(F.col("StockCode").isNull(), F.lit("\u0000")).otherwise(F.concat(F.lit("="), "StockCode"))


def negative_candidates(lines: DataFrame) -> DataFrame:
    return (lines.filter((F.col("Quantity") < 0) & ~F.col("Description").eqNullSafe("Discount"))
            .select(F.col("line_key").alias("neg_key"), "CustomerID", "StockCode",
                    micros("InvoiceDate").alias("t"), (-F.col("Quantity")).alias("a")))


def positive_candidates(lines: DataFrame) -> DataFrame:
    return (lines.filter(F.col("Quantity") > 0)
            .select(F.col("line_key").alias("pos_key"), "CustomerID", "StockCode",
                    micros("InvoiceDate").alias("t"), F.col("Quantity").alias("q")))


#: Bucket starts that are searched together.
_EDGES = 128


def time_buckets(moves: DataFrame, group_rows: int) -> DataFrame:
    """(CustomerID, sk, cuts): bucket starts of the customers and items with more than ``group_rows`` rows in ``moves``.

    ``cuts`` is an array of (no, head, edges): stretches of up to 128 bucket starts in order.
    """
    hot = moves.groupBy("CustomerID", "sk").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    by_time = (moves.join(hot.select("CustomerID", "sk"), ["CustomerID", "sk"], "left_semi")
               .groupBy("CustomerID", "sk", "t").agg(F.count(F.lit(1)).alias("n")))
    before = F.sum("n").over(Window.partitionBy("CustomerID", "sk").orderBy("t")) - F.col("n")
    starts = (by_time.withColumn("bucket", F.floor(before / group_rows))
              .groupBy("CustomerID", "sk", "bucket").agg(F.min("t").alias("start")))
    edges = (starts.groupBy("CustomerID", "sk", F.floor(F.col("bucket") / _EDGES).alias("no"))
             .agg(F.sort_array(F.collect_list("start")).alias("edges")))
    return edges.groupBy("CustomerID", "sk").agg(
        F.sort_array(F.collect_list(F.struct("no", F.col("edges")[0].alias("head"), "edges"))).alias("cuts"))


def _bucket(t, cuts):
    """Number of the bucket that ``t`` is in; 0 without cuts."""
    block = F.element_at(F.filter(cuts, lambda c: c["head"] <= t), -1)
    return F.when(cuts.isNull(), F.lit(0).cast("bigint")).otherwise(
        block["no"] * _EDGES + F.size(F.filter(block["edges"], lambda e: e <= t)))


def _pair():
    return F.xxhash64("CustomerID", "sk").alias("pair")


def matchable_pairs(neg: DataFrame, pos: DataFrame) -> DataFrame:
    """Hashes (``pair``) of the customers and items of which some cancellation is later and no larger than some purchase.

    A line of any other customer and item cannot match.  Two customers and items of one hash only leave more lines in; a line
    without a time leaves its pair in.
    """
    both = (neg.select(_pair(), F.coalesce("t", F.lit(2 ** 63 - 1)).alias("last"), F.lit(None).cast("bigint").alias("first"), F.col("a").alias("least"),
                       F.lit(None).cast("bigint").alias("most"))
            .unionByName(pos.select(_pair(), F.lit(None).cast("bigint").alias("last"), F.coalesce("t", F.lit(-2 ** 63)).alias("first"),
                                    F.lit(None).cast("bigint").alias("least"), F.col("q").alias("most"))))
    return (both.groupBy("pair").agg(F.max("last").alias("last"), F.min("first").alias("first"), F.min("least").alias("least"),
                                     F.max("most").alias("most"))
            .where("first < last AND least <= most").select("pair"))


def match_cancellations(lines: DataFrame, group_rows: int = 100_000) -> DataFrame:
    """One row per matched negative: neg_key, pos_key, CustomerID, StockCode,
    AbsQuantity, neg_time_us, pos_time_us."""
    ensure_checkpoint_dir(lines.sparkSession)
    neg = negative_candidates(lines).withColumn("sk", _stock_key())
    pos = positive_candidates(lines).withColumn("sk", _stock_key())
    # the other lines, most of them, take no part in what follows
    # a pair is a bare number: four times the rows of other tables are sent before all lines would be shuffled
    with session.held(lines.sparkSession, session.LINE_TABLES):
        pairs = sent(matchable_pairs(neg, pos).checkpoint(eager=True), 4 * session.SENT_ROWS)
        neg, pos = (d.withColumn("pair", _pair()).join(pairs, "pair", "left_semi").drop("pair").checkpoint(eager=True) for d in (neg, pos))
    cuts = time_buckets(pos.select("CustomerID", "sk", "t").unionByName(neg.select("CustomerID", "sk", "t")), group_rows)
    cuts = cuts.checkpoint(eager=True)   # a row per hot customer and item; mostly none
    pos, asked = (d.join(cuts, ["CustomerID", "sk"], "left").withColumn("bucket", _bucket(F.col("t"), F.col("cuts"))).drop("cuts")
                  for d in (pos, neg))

    # L = bit length of the largest cancelled quantity (scalar subquery, run once)
    n_bits_scalar = F.length(F.bin(neg.agg(F.max("a")).scalar()))   # one scalar subquery, reused
    asked = asked.withColumn("nb", n_bits_scalar)
    pos = pos.withColumn("nb", n_bits_scalar)
    n_bits = F.col("nb")
    top = _shl(F.lit(1).cast("bigint"), n_bits) - 1
    levels = F.sequence(F.lit(0), n_bits - 1)

    pos_nodes = (pos.withColumn("qc", F.least(F.col("q"), top))
                 .select("CustomerID", "sk", "t", "bucket", "pos_key", F.explode(levels).alias("lvl"), "qc")
                 .select("CustomerID", "sk", "lvl", _shr(F.col("qc"), F.col("lvl")).alias("node"), "t", "bucket",
                         F.lit(0).alias("kind"),
                         F.struct((-F.col("t")).alias("neg_t"), F.col("pos_key").alias("key")).alias("cand"),
                         F.lit(None).cast("string").alias("neg_key")))
    a = F.col("a")
    asks = F.concat(
        F.array(F.struct(F.lit(0).alias("lvl"), a.alias("node"))),
        F.transform(F.filter(levels, lambda l: _shr(a, l) % 2 == 0),
                    lambda l: F.struct(l.alias("lvl"), (_shr(a, l) + 1).alias("node"))))
    neg_nodes = (asked.select("CustomerID", "sk", "t", "bucket", "neg_key", F.explode(asks).alias("n"))
                 .select("CustomerID", "sk", F.col("n.lvl").alias("lvl"), F.col("n.node").alias("node"), "t", "bucket",
                         F.lit(1).alias("kind"),
                         F.lit(None).cast("struct<neg_t:bigint,key:string>").alias("cand"), "neg_key"))
    u = pos_nodes.unionByName(neg_nodes)
    u = u.checkpoint(eager=True)   # read by both levels below

    # level 1: best positive per (key, node, bucket), carried over earlier buckets
    summary = (u.groupBy(*_KEYS, "bucket")
               .agg(F.min("cand").alias("best"), F.max("kind").alias("has_neg")))
    carry = (summary
             .withColumn("carry", F.min("best").over(
                 Window.partitionBy(*_KEYS).orderBy("bucket")
                 .rowsBetween(Window.unboundedPreceding, -1)))
             .filter(F.col("has_neg") == 1).select(*_KEYS, "bucket", "carry"))
    # level 2: strictly earlier positives inside the bucket
    local = (u.withColumn("local", F.min("cand").over(
                 Window.partitionBy(*_KEYS, "bucket").orderBy("t")
                 .rangeBetween(Window.unboundedPreceding, -1)))
             .filter(F.col("kind") == 1).select(*_KEYS, "bucket", "neg_key", "local"))
    per_node = (local.join(carry, [*_KEYS, "bucket"])
                .select("neg_key", F.least("local", "carry").alias("cand")))
    best = (per_node.groupBy("neg_key").agg(F.min("cand").alias("best"))
            .filter(F.col("best").isNotNull()))
    return (best.join(neg, "neg_key")
            .select("neg_key", F.col("best.key").alias("pos_key"), "CustomerID", "StockCode",
                    F.col("a").alias("AbsQuantity"), F.col("t").alias("neg_time_us"),
                    (-F.col("best.neg_t")).alias("pos_time_us")))


def unmatched_cancellations(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Negative candidates with no earlier purchase to offset ("doubtful" lines)."""
    neg = negative_candidates(lines)
    return neg.join(sent(matches.select("neg_key")), "neg_key", "left_anti").select(
        "neg_key", "CustomerID", "StockCode", F.col("a").alias("AbsQuantity"))


def canceled_quantity(matches: DataFrame) -> DataFrame:
    """Per hit positive: the quantity of the last (highest key) negative, not the sum."""
    return matches.groupBy("pos_key").agg(
        F.max_by("AbsQuantity", "neg_key").alias("QuantityCanceled"))


def keep_line() -> "F.Column":
    q = F.col("Quantity")
    return q.isNull() | (q >= 0) | ((F.col("Description") == "Discount") & (F.col("StockCode") == "D"))


def clean_lines(lines: DataFrame, matches: DataFrame | None = None, group_rows: int = 100_000) -> DataFrame:
    """transactions_clean: kept lines + QuantityCanceled + TotalPrice."""
    if matches is None:
        matches = match_cancellations(lines, group_rows)
    ensure_checkpoint_dir(lines.sparkSession)
    # a key and a number: sent up to four times the rows of other tables before all lines would be shuffled
    canceled = sent(canceled_quantity(matches).checkpoint(eager=True), 4 * session.SENT_ROWS)
    return (lines.filter(keep_line())
            .join(canceled, F.col("line_key") == F.col("pos_key"), "left").drop("pos_key")
            .withColumn("QuantityCanceled", F.coalesce("QuantityCanceled", F.lit(0)).cast("bigint"))
            .withColumn("TotalPrice", F.col("UnitPrice") * (F.col("Quantity") - F.col("QuantityCanceled"))))
