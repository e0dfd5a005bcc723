"""Sharding by balanced label propagation: linked documents gather in a shard, shards stay even.

Links: documents with equal texts (null texts are not linked).  Every document starts in a pseudo-random shard, dealt so
that shard sizes differ by at most one.  In each round a group of linked documents looks at the shards its members
lie in and picks those that can hold most of it (one shard, or as many as its size needs); members elsewhere ask to
move there.  Movers are admitted by flows between pairs of shards: what enters a shard may exceed what leaves it by the places
that its linked documents have left in its quota, so full shards swap and no round can overfill a shard.  A round counts
if it leaves fewer links cut; rounds end when no document asks to move, or when ``PATIENCE`` rounds in a row, each with
other choices between equal shards, cut no fewer links.  Documents without links cut no edge wherever they lie: they fill the
places left, so sizes end up exactly even.

Law ``rows``: shard counts differ by at most one.

Defined cases: null or empty text has 16 bytes and checksum 0; repeated rows are documents of their own (linked, as
their texts are equal); null doc_id is allowed; an empty table gives an empty result; other columns are not read.

Scale: the text is read once; rounds work on (row, group, shard).  Group counts are pre-aggregated per task, numbering
uses hash ranges of about sqrt(n) rows, group tables join through ``lookup`` (safe for a group with a third of
all rows).  The driver sees two numbers per shard and a count per pair of shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import ensure_row_ids, lookup, spread_rank, written


def _counts(df: DataFrame, n_shards: int) -> list[int]:
    got = {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    return [got.get(j, 0) for j in range(n_shards)]


#: Rounds without gain before propagation ends.
PATIENCE = 3


def flows(demand: list[list[int]], free: list[int]) -> list[list[int]]:
    """Admitted movers by (from, to): within ``demand``, and no shard gains more than ``free``."""
    some = range(len(free))
    f = [list(row) for row in demand]
    slack = [free[j] + sum(f[j]) - sum(f[i][j] for i in some) for j in some]
    while min(slack) < 0:
        j = min(some, key=lambda j: slack[j])
        # movers whose leaving is not needed to keep their own shard within its quota are refused first
        for spare in (True, False):
            for i in sorted(some, key=lambda i: slack[i], reverse=True):
                cut = min(f[i][j], -slack[j], max(0, slack[i]) if spare else f[i][j])
                if cut > 0:
                    f[i][j] -= cut
                    slack[i] -= cut
                    slack[j] += cut
    return f


def _held(linked: DataFrame, n_shards: int) -> tuple[DataFrame, list[int], int]:
    """Rows by (key, n, shard), linked rows of each shard, and linked pairs that lie together."""
    here = written(linked.groupBy("key", "n", "shard").agg(F.count(F.lit(1)).alias("c")), "shards-here")
    got = {r.shard: r for r in here.groupBy("shard").agg(F.sum("c").alias("c"), F.sum(F.expr("cast(c as decimal(38, 0)) * (c - 1)")).alias("same")).collect()}
    return here, [got[j].c if j in got else 0 for j in range(n_shards)], sum(int(r.same) for r in got.values()) // 2


def propagate(linked: DataFrame, quota: list[int]) -> DataFrame:
    """Label propagation over (_row, key, n, shard); no shard ever holds more linked rows than its quota."""
    n_shards, most = len(quota), max(1, min(quota))
    here, held, same = _held(linked, n_shards)
    r = idle = 0
    while idle < PATIENCE:
        r, idle = r + 1, idle + 1
        free = [q - c for q, c in zip(quota, held)]
        room = F.element_at(F.array(*[F.lit(x) for x in free]), F.col("shard") + 1)
        fit = F.struct(F.least("n", F.col("c") + room).alias("fits"), "c", F.xxhash64("key", "shard", F.lit(r)).alias("tie"), "shard")
        per_key = here.groupBy("key", "n").agg(F.sort_array(F.collect_list(fit), asc=False).alias("s"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most))).cast("int")
        goal = written(per_key.select("key", F.slice(F.col("s.shard"), 1, parts).alias("goal")), "shards-goal")
        there = F.element_at("goal", (F.pmod(F.xxhash64("_row", F.lit(r)), F.size("goal")) + 1).cast("int"))
        asked = lookup(linked, goal, ["key"], "inner").withColumn("to", F.when(~F.array_contains("goal", F.col("shard")), there)).drop("goal")
        demand = [[0] * n_shards for _ in quota]
        for x in asked.where("to is not null").groupBy("shard", "to").count().collect():
            demand[x.shard][x.to] = x["count"]
        if not any(map(any, demand)):
            break
        admitted = flows(demand, free)
        if not any(map(any, admitted)):
            continue
        limit = F.get(F.split(F.lit(",".join(str(x) for row in admitted for x in row)), ","), F.col("shard") * n_shards + F.col("to")).cast("long")
        movers = spread_rank(asked.where("to is not null"), ["_row"], "place", max(map(max, demand)), ["shard", "to"])
        movers = movers.withColumn("shard", F.when(F.col("place") < limit, F.col("to")).otherwise(F.col("shard")))
        moved = written(asked.where("to is null").select(*linked.columns).unionByName(movers.select(*linked.columns)), "shards-round")
        after = _held(moved, n_shards)
        if after[2] > same:
            linked, (here, held, same), idle = moved, after, 0
    return linked


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, key, n, first_shard, shard, slot); ``n`` is the size of a linked group, else null."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    nodes = ensure_row_ids(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"),
                                       F.crc32(body).alias("text_crc32"), F.md5(F.col(text).cast("binary")).alias("key")), "shards-nodes")
    n = nodes.count()
    groups = written(nodes.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards-groups")
    dealt = spread_rank(nodes, ["_row"], "rank", n).withColumn("shard", (F.col("rank") % n_shards).cast("int")).drop("rank")
    state = written(lookup(dealt, groups, ["key"]), "shards-start")
    quota = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    linked = propagate(state.where("n is not null").select("_row", "key", "n", "shard"), quota)
    held = _counts(linked, n_shards)
    left, ends = 0, []
    for q, h in zip(quota, held):
        left += q - h
        ends.append(left)
    free = spread_rank(state.where("n is null").select("_row"), ["_row"], "place", left)
    filled = free.select("_row", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("place"))).alias("shard"))
    final = written(linked.select("_row", "shard").unionByName(filled), "shards-final")
    both = state.withColumnRenamed("shard", "first_shard").join(final, "_row")
    return spread_rank(both, ["_row"], "slot", max(1, n // n_shards), ["shard"]).drop("_row")


def cut_edges(placed: DataFrame, shard: str = "shard") -> int:
    """Pairs of linked documents in different shards."""
    c = placed.where("n is not null").groupBy("key", "n", shard).count()
    same = c.groupBy("key", "n").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("same"))
    return int(same.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2 - F.col("same"))).first()[0] or 0)


def op10_label_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                                        "slot", F.lit(None).cast("int").alias("grown_shard"))
