"""Helpers shared by the training-data operators.

* ``written``: a table written to the cluster's shared folder and read back.  It cuts lineage, survives
  lost executors, and its size on disk is known to the planner.
* ``lookup``: left join of a large table with a table that has one row per key, safe for hot keys.
* ``spread_rank``: exact 0..n-1 numbering without a single-task sort.
* ``spans_of``: positions of all regular-expression matches, in code points, without Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.session import work_path

#: A table is broadcast only when the planner's size of it (files on disk, or rows times width) is below this.
BROADCAST_BYTES = 16 << 20
#: Copies of each key's row when a lookup table is too large to broadcast.
SALTS = 16

#: Text that a Python worker takes from an Arrow batch at a time.
SHARD_BYTES = 2 << 20

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """The planner's estimate; for a written table this is its size on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``big`` with ``small`` (one row per key; a written table) on ``keys``.

    ``small`` is broadcast when its files are below ``BROADCAST_BYTES``.  Otherwise each of its rows is
    repeated ``SALTS`` times and the rows of ``big`` pick one copy by a hash of the whole row, so the rows of
    a hot key meet in many tasks.  Null keys find nothing (``how`` is left, inner, left_semi or left_anti).
    """
    if size_in_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(SALTS)).cast("int"))
    return out.join(salted, [*keys, "__salt"], how).drop("__salt")


def spread_rank(df: DataFrame, order: list[str], rank: str, n_rows: int, within: list[str] | None = None) -> DataFrame:
    """Number rows 0..n-1 (per group of ``within``) in a pseudo-random, repeatable order.

    The rows are dealt by a hash of ``order`` (which must tell rows apart) into about sqrt(n_rows) ranges of hash
    values; the small table of range counts gives each range its first number, and a window inside a range the
    rest.  No window ever holds more than about sqrt(n_rows) rows.
    """
    within = within or []
    n_ranges = max(1, min(1 << 20, int(max(1, n_rows) ** 0.5 / 4)))
    out = df.withColumn("_h", F.xxhash64(*order, F.lit(17)))
    out = out.withColumn("_range", F.pmod(F.col("_h"), F.lit(n_ranges)))
    counts = out.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*within).orderBy("_range") if within else Window.orderBy("_range")
    first = counts.select(*within, "_range", (F.sum("_n").over(w) - F.col("_n")).alias("_first"))
    inner = Window.partitionBy(*within, "_range").orderBy("_h", *order)
    out = out.withColumn("_in", F.row_number().over(inner) - 1)
    cond = [out["_range"] == first["_range"], *[out[c].eqNullSafe(first[c]) for c in within]]
    joined = out.join(first, cond, "inner")
    return joined.select(*[out[c] for c in df.columns], (F.col("_first") + F.col("_in")).cast("long").alias(rank))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


#: Spans that are added up together: long lists grow by blocks, not by single spans.
SPAN_BLOCK = 128


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _in_blocks(items: Column, n: Column, start: Column, step, kind: str) -> Column:
    """Arrays that ``step(state, item)`` (a struct of ``pos`` and ``out``) collects over the first ``n`` items, joined.

    ``start`` is the first position; lists are put together per block, so the cost grows with n.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")
    block = lambda acc, i: let(
        F.aggregate(F.slice(items, i * SPAN_BLOCK + 1, F.least(F.lit(SPAN_BLOCK), n - i * SPAN_BLOCK)),
                    F.struct(acc["pos"].alias("pos"), none.alias("out")), step),
        lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
    first = F.struct(start.alias("pos"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / SPAN_BLOCK).cast("int")), first, block)


def spans_of(text: Column, regex: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive.

    ``value`` is capture group ``group``.  The text between matches and the matches themselves alternate, so
    their lengths add up to the positions.  Texts without a match only pay for one search.
    """
    kind = "struct<start:int,end:int,value:string>"
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    if group:
        both = F.zip_with(found, F.regexp_extract_all(text, F.lit(regex), F.lit(group)),
                          lambda f, v: F.struct(F.char_length(f).alias("len"), v.alias("value")))
    else:
        both = F.transform(found, lambda f: F.struct(F.char_length(f).alias("len"), f.alias("value")))
    # one more gap than matches: the last pair is left out
    parts = F.zip_with(both, F.split(text, regex, -1),
                       lambda m, g: F.struct(m["len"].alias("len"), m["value"].alias("value"), F.char_length(g).alias("gap")))
    step = lambda acc, m: F.struct(
        (acc["pos"] + m["gap"] + m["len"]).alias("pos"),
        F.concat(acc["out"], F.array(F.struct((acc["pos"] + m["gap"]).alias("start"),
                                              (acc["pos"] + m["gap"] + m["len"]).alias("end"), m["value"].alias("value"))))
        .alias("out"))
    spans = let(parts, lambda p: F.flatten(_in_blocks(p, F.size(p) - 1, F.lit(0), step, kind)["out"]))
    return F.when(text.rlike(regex), spans).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def ensure_row_ids(df: DataFrame, name: str, row: str = "_row") -> DataFrame:
    """Give rows an id and fix it by writing the table (an unwritten id could change when a task runs again)."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, from structs sorted by (start, no)."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def replaced(text: Column, spans: Column, label) -> Column:
    """``text`` with each span of (start, no, end, kind) replaced by ``label(span)``; a span inside an earlier one goes with it."""
    def over(chars: Column, ordered: Column) -> Column:
        piece = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        step = lambda acc, s: F.when(s["start"] < acc["pos"], F.struct(
            F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))).otherwise(F.struct(
                s["end"].alias("pos"), F.concat(acc["out"], F.array(piece(acc["pos"], s["start"] - acc["pos"]), label(s))).alias("out")))
        return let(_in_blocks(ordered, F.size(ordered), F.lit(0), step, "string"), lambda r: F.concat(
            F.array_join(F.flatten(r["out"]), ""), piece(r["pos"], F.greatest(F.size(chars) - r["pos"], F.lit(0)))))

    cut = let(F.split(text, ""), lambda chars: let(F.array_sort(spans), lambda ordered: over(chars, ordered)))
    return F.when(F.size(spans) == 0, text).otherwise(cut)


def shards(batches: Iterator[pa.RecordBatch], text: str, most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text (one document at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else [0, 0]
        for a, b in zip(edge[:-1], edge[1:]):
            yield batch.slice(a, b - a)
