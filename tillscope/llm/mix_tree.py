"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are put in a pseudo-random order and their words form one stream, cut into equal blocks.  A
source's target is a number of block draws (its quota); draws beyond one pass start the next pass.  The vector of
quotas is split among the output shards by a binary tree: at each node the left half receives an exact
multivariate-hypergeometric share of every source.  A shard's draws of a source are a range of that source's
permuted block positions, disjoint from all other shards' ranges; inside a shard the drawn pieces are shuffled.  What a
document gives is counted by shard, from the shards' ranges; its words taken are the sum over the shards.

Targets: sources by code point (null last) weigh ``weights``, repeating; they share ``share`` of all words; a target
stops at ``cap`` times its source's words and the excess is shared again by weight until none is above.

Defined cases: null, empty or blank text has no words and is never drawn; null is a source of its own; repeated rows are
documents of their own; an empty table gives an empty result; extra columns pass through ``mixed_documents``.

Scale: text is read once for sizes; order, prefix sums and draws work on a narrow table.  Prefix sums run inside
hash ranges of about sqrt(n) documents, so a source with a third of all rows is spread like any other.  One row
per source and one number per source and shard go through the driver (``max_sources`` is checked).
"""

from __future__ import annotations

from math import gcd

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.llm.common import lookup, written

#: Fixed values of the operator's contract.
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
NAMES = ["size", "source_size", "target", "taken"]


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Target words of each source (in source order)."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weight[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = cap * sizes[i]
        left = max(0.0, left - sum(out[i] for i in full))
        open_ -= set(full)
    return out


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """(shards, sources) draws: sums over shards are the quotas, sums over sources differ by at most one."""
    out = np.zeros((n_shards, len(quotas)), np.int64)
    total = int(sum(quotas))
    room = [total * (j + 1) // n_shards - total * j // n_shards for j in range(n_shards)]

    def split(lo: int, hi: int, q: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(q, sum(room[lo:mid]), method="marginals")
        split(lo, mid, left)
        split(mid, hi, q - left)

    if total:
        split(0, n_shards, np.array(quotas, np.int64))
    return out


def _plan(sources: list[tuple[str | None, int]], n_shards: int, seed: int, tree_seed: int, max_blocks: int = 1 << 28) -> list[tuple]:
    """(source, source_size, target, block, n_blocks, factor, shift, quota, first draw of each shard)."""
    order = sorted(sources, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8", "surrogatepass")))
    goal = targets([n for _, n in order])
    largest = max(1024, -(-sum(n for _, n in order) // max_blocks))
    block = [min(largest, max(1, n // 1024)) for _, n in order]
    n_blocks = [-(-n // b) for (_, n), b in zip(order, block)]
    quota = [round(t / b) for t, b in zip(goal, block)]
    firsts = np.cumsum(np.vstack([np.zeros(len(order), np.int64), split_quotas(quota, n_shards, tree_seed)]), axis=0)
    out = []
    for i, (name, n) in enumerate(order):
        m = max(1, n_blocks[i])
        factor = max(1, int(m * 0.6180339887))
        while gcd(factor, m) != 1:
            factor += 1
        out.append((name, n, goal[i], block[i], m, factor, (seed * 7919 + i * 104729) % m, quota[i], firsts[:, i].tolist()))
    return out


def placed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_shards: int = 64,
           seed: int = 1, tree_seed: int | None = None, max_sources: int = 100_000) -> DataFrame:
    """One row per document: _id, _key, _source, size, source_size, target, start (its first word in the source's
    stream) and the source's block plan.  ``seed`` orders documents and blocks, ``tree_seed`` (else ``seed``) splits the quotas."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(doc_id), F.lit(seed), F.col(text)).alias("_key"),
                                F.col(source).cast("string").alias("_source"), words.alias("size")), "mix-sizes")
    by_source = sized.groupBy("_source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    rows = by_source.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    plan = spark.createDataFrame(
        _plan([(r._source, int(r.n)) for r in rows], n_shards, seed, seed if tree_seed is None else tree_seed),
        "_source string, source_size long, target double, block long, n_blocks long, factor long, shift long, quota long, firsts array<long>")
    n_ranges = max(1, min(1 << 20, int(sum(r.docs for r in rows) ** 0.5 / 4)))
    ranged = sized.withColumn("_range", F.pmod("_key", F.lit(n_ranges)))
    parts = ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_n"))
    parts = parts.select("_source", "_range", (F.sum("_n").over(Window.partitionBy("_source").orderBy("_range")) - F.col("_n")).alias("_first"))
    inner = Window.partitionBy("_source", "_range").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_in", F.sum("size").over(inner) - F.col("size"))
    at = ranged.join(parts, ranged["_source"].eqNullSafe(parts["_source"]) & (ranged["_range"] == parts["_range"])) \
        .select("_id", "_key", ranged["_source"], "size", (F.col("_first") + F.col("_in")).alias("start"))
    return at.join(F.broadcast(plan), at["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])


def _blocks() -> Column:
    return F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / F.col("block")),
                                               F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))) \
        .otherwise(F.expr("cast(array() as array<bigint>)"))


def _position(b: Column) -> Column:
    """Place of a block in its source's permuted order."""
    return (b * F.col("factor") + F.col("shift")) % F.col("n_blocks")


def _overlap(b: Column) -> tuple[Column, Column]:
    """First and last (exclusive) word of the document that lie in block ``b``."""
    return (F.greatest(b * F.col("block") - F.col("start"), F.lit(0).cast("long")),
            F.least((b + 1) * F.col("block") - F.col("start"), F.col("size")))


def _draws(b: Column) -> Column:
    """(shard, pass) of every draw of block ``b``: each pass draws position + pass * n_blocks, in the shard whose range holds it."""
    at = _position(b)
    quota = F.element_at("firsts", -1)   # the end of the last shard's range
    passes = F.when(at < quota, F.sequence(F.lit(0).cast("long"), F.floor((quota - 1 - at) / F.col("n_blocks")))) \
        .otherwise(F.expr("cast(array() as array<bigint>)"))
    shard = lambda draw: F.size(F.filter("firsts", lambda f: f <= draw)) - 1
    return F.transform(passes, lambda p: F.struct(shard(at + p * F.col("n_blocks")).alias("shard"), p.alias("pass")))


def drawn_ranges(at: DataFrame) -> DataFrame:
    """``at`` with ``drawn``: (shard, pass, lo, hi) of every drawn stretch of the document's words."""
    def of(b: Column) -> Column:
        lo, hi = _overlap(b)
        return F.transform(_draws(b), lambda d: F.struct(d["shard"].alias("shard"), d["pass"].alias("pass"), lo.alias("lo"), hi.alias("hi")))
    return at.withColumn("drawn", F.flatten(F.transform(_blocks(), of)))


def taken_words(at: DataFrame) -> DataFrame:
    """``at`` with ``shards`` (array of shard and words that the document gives it) and ``taken``, their sum."""
    at = drawn_ranges(at)
    words = lambda s: F.aggregate(F.filter("drawn", lambda d: d["shard"] == s), F.lit(0).cast("long"),
                                  lambda acc, d: acc + d["hi"] - d["lo"])
    some = F.sort_array(F.array_distinct(F.transform("drawn", lambda d: d["shard"])))
    at = at.withColumn("shards", F.transform(some, lambda s: F.struct(s.alias("shard"), words(s).alias("words")))).drop("drawn")
    return at.withColumn("taken", F.aggregate("shards", F.lit(0).cast("long"), lambda acc, s: acc + s["words"]))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    n_shards: int = 64, seed: int = 1, tree_seed: int | None = None, shard: str | None = None) -> DataFrame:
    """The mixture as documents: a row for each document, pass and shard with drawn words; every block lies in the shard of its draw.

    A document that a pass draws whole into one shard keeps its text; else the drawn words are joined by one space
    (``n_chars``, where present, follows).  Rows lie in their shard's files in shuffled order; ``shard`` names a column for it.
    """
    at = drawn_ranges(placed(docs, doc_id, text, source, n_shards, seed, tree_seed))
    at = at.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy("_id", "_key")))
    key = F.array_distinct(F.transform("drawn", lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("_shard"))))
    drawn = at.select("_id", "_key", "n_same", "size", "drawn", F.explode(key).alias("d"))
    own = F.filter("drawn", lambda x: (x["pass"] == F.col("d.pass")) & (x["shard"] == F.col("d._shard")))
    drawn = drawn.select("_id", "_key", "n_same", "size", "d.*", F.transform(own, lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("r"))
    whole = F.aggregate("r", F.lit(0).cast("long"), lambda acc, x: acc + x["hi"] - x["lo"]) == F.col("size")
    drawn = drawn.select(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"), "_key", "n_same", "pass", "_shard",
                         F.when(~whole, F.col("r")).alias("_ranges"))
    pieces = written(drawn.groupBy("_id", "_key").agg(
        F.collect_list(F.struct("pass", "_shard", "_ranges")).alias("_draws"), F.max("n_same").alias("n_same")), "mix-draws")
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"),
                        F.xxhash64(F.col(doc_id), F.lit(seed), F.col(text)).alias("_key"))
    twice = written(pieces.where("n_same > 1").select("_id", "_key"), "mix-twice")
    if not twice.isEmpty():  # rows that repeat doc_id and text: one of them stands for the draws of all
        keyed = lookup(keyed, twice, ["_id", "_key"], "left_anti").unionByName(
            lookup(keyed, twice, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]))
    out = lookup(keyed, pieces.drop("n_same"), ["_id", "_key"], "inner").select("row", "_key", F.explode("_draws").alias("_d"))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(WORDS), F.lit(0))
    part = F.array_join(F.flatten(F.transform("_d._ranges", lambda r: F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), " ")
    whole = F.col("_d._ranges").isNull()
    out = out.withColumn("_new", F.when(whole, F.col("row")[text]).otherwise(part))
    out = out.repartition(F.col("_d._shard")).sortWithinPartitions(F.col("_d._shard"), F.xxhash64("_key", F.col("_d.pass"), F.lit(seed)))
    fitted = {text: F.col("_new"), "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.char_length("_new")) if "n_chars" in docs.columns else None}
    place = [F.col("_d._shard").alias(shard)] if shard else []
    return out.select(*[(fitted[c].cast(docs.schema[c].dataType) if c in fitted else F.col("row")[c]).alias(c) for c in docs.columns if c != shard], *place)


def op8_mix_tree(spark, sf_dir: str) -> DataFrame:
    """The mixture's plan per document, with the words that each shard of the tree takes from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken_words(placed(docs)).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")
