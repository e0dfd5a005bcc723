"""Document fingerprints: threshold-scaled sketches (every shingle hash below a fixed fraction is kept).

Words are runs of characters other than space and U+0009-U+000D, lower-cased; shingles are five consecutive words (fewer
words: the whole sequence).  Words are hashed once and a shingle's hash combines five word hashes.  A hash is kept if
it lies in the lowest 1/``scale`` of the unsigned 64-bit range, i.e. h < 2^64 / scale, so a sketch grows
with its text, the union of sketches is the sketch of the union, and the kept shares of very unequal documents
compare directly.  A fraction would leave texts of a few shingles empty, so texts of at most ``EXACT`` different shingles keep
all of them (an exact set).  Likeness of two texts is the containment of the smaller: from the sketches if neither or both are
exact, and from all shingles of both if one is.

Defined cases: null text counts as empty; a text without words has the empty sketch; likeness with one empty sketch
is 0, of two empty sketches 1 if both texts are without words and else 0; equal texts have equal sketches; repeated
doc_ids follow each other in the order of a text hash; a null doc_id comes before all others; a single document is
its own successor; an empty table gives an empty result; other columns are not read.

Scale: texts are shuffled once, by ranges of doc_id; the successor comes from a window inside a range, and the first
document of each range is also sent to the range before.  Ranges hold about 2,048 rows up to 2^17 of them (some 270 million
documents), beyond that they grow; windows spill.  No Python, no per-document join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillscope.llm.common import let

SCALE, SHINGLE = 4, 5
#: Texts of at most so many different shingles keep them all.
EXACT = 32


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all shingles, repeats included, from the word hashes of a text."""
    n = F.size(hashes)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(shingle)]))


def sketch_struct(hashes: Column, scale: int = SCALE, shingle: int = SHINGLE, exact: int = 0) -> Column:
    """(sketch, exact): sorted distinct kept hashes; all of them, and ``exact`` true, for at most ``exact`` different shingles."""
    last = (1 << 64) // scale - 1  # above 2^63 - 1 only if all are kept
    low = lambda full: full if scale == 1 else F.filter(full, lambda h: (h >= 0) & (h <= F.lit(last)))
    pair = lambda kept, whole: F.struct(F.sort_array(kept).alias("sketch"), F.lit(whole).alias("exact"))
    # texts with more kept hashes than an exact set may have need no count of all
    count = lambda full, kept: let(F.array_distinct(full), lambda all_: F.when(F.size(all_) <= exact, pair(all_, True))
                                   .otherwise(pair(kept, False)))
    return let(shingle_hashes(hashes, shingle), lambda full: let(F.array_distinct(low(full)), lambda kept: F.when(
        F.size(kept) > exact, pair(kept, False)).otherwise(count(full, kept))))


def sketch_of(hashes: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted distinct kept hashes from the word hashes of a text."""
    return sketch_struct(hashes, scale, shingle)["sketch"]


def merge(a: Column, b: Column) -> Column:
    """Sketch of the union of two documents' shingles."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def with_sketch(df: DataFrame, text: str, name: str, exact: int = 0) -> DataFrame:
    """Adds ``name`` (the sketch), ``name``_exact, ``name``_words (number of words) and ``name``_hashes (the words' hashes)."""
    df = df.withColumn(f"{name}_hashes", word_hashes(F.col(text))).withColumn("_s", sketch_struct(F.col(f"{name}_hashes"), exact=exact))
    return df.withColumns({name: F.col("_s.sketch"), f"{name}_exact": F.col("_s.exact"), f"{name}_words": F.size(f"{name}_hashes")}).drop("_s")


def likeness(a: str, b: str) -> Column:
    """Containment of the smaller of two texts (columns of ``with_sketch``)."""
    every = [F.array_distinct(shingle_hashes(F.col(f"{x}_hashes"))) for x in (a, b)]
    blank = (F.col(f"{a}_words") == 0) & (F.col(f"{b}_words") == 0)
    mixed = F.col(f"{a}_exact") != F.col(f"{b}_exact")
    return F.when(blank, F.lit(1.0)).when(mixed, let(every[0], lambda x: let(every[1], lambda y: containment(x, y)))).otherwise(
        containment(F.col(a), F.col(b)))


def _range_of(value: Column, cuts: list[int]) -> Column:
    """Number of the last cut that is not above ``value`` (two-level search; cuts are sorted)."""
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda text: F.transform(F.split(text, ","), lambda x: x.cast("long"))  # noqa: E731  one literal, folded once
    join = lambda xs: ",".join(map(str, xs))
    fine = F.transform(F.split(F.lit(";".join(join(cuts[i:i + step]) for i in range(0, len(cuts), step))), ";"), longs)
    block = F.size(F.filter(longs(F.lit(join(cuts[::step]))), lambda c: c <= value)) - 1
    inner = F.size(F.filter(F.get(fine, block), lambda c: c <= value)) - 1
    return (block * step + inner).cast("int")


def with_next(docs: DataFrame, key: str, cols: list[str], tie: Column, rows_per_range: int = 2048,
              max_ranges: int = 1 << 17) -> DataFrame:
    """``docs`` with ``_next``: struct of ``cols`` of the row that follows by (key, tie); the first row follows the last.

    ``key`` is a non-null long column.
    """
    n = docs.count()
    if n == 0:
        return docs.withColumn("_next", F.struct(*cols))
    n_ranges = max(1, min(max_ranges, n // rows_per_range))
    firsts = docs.select(key).repartitionByRange(n_ranges, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("m"))
    cuts = sorted({r.m for r in firsts.collect()})
    at = _range_of(F.col(key), cuts)
    docs = docs.withColumn("_r", at)
    at = F.col("_r")
    is_cut = F.get(F.transform(F.split(F.lit(",".join(map(str, cuts))), ","), lambda x: x.cast("long")), at) == F.col(key)
    here = F.struct(at.alias("r"), F.lit(0).alias("extra"))
    before = F.struct(F.pmod(at - 1, F.lit(len(cuts))).cast("int").alias("r"), F.lit(1).alias("extra"))
    dealt = docs.withColumn("_at", F.explode(F.when(is_cut, F.array(here, before)).otherwise(F.array(here))))
    w = Window.partitionBy(F.col("_at.r")).orderBy(F.col("_at.extra"), F.col(key), tie)
    return dealt.withColumn("_next", F.lead(F.struct(*cols)).over(w)).where("_at.extra = 0").drop("_at", "_r")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_chars, sketch, edited, edited_sketch, near_edited, near_next, containment both ways)."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_key"))
    nxt = with_next(base, "_key", ["text"], F.xxhash64("text")).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    out = nxt.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")),
                                            F.substring("_next.text", F.lit(1), tail)))
    out = out.withColumn("_next_text", F.col("_next.text"))
    for column, name in (("text", "sketch"), ("edited", "edited_sketch"), ("_next_text", "next_sketch")):
        out = with_sketch(out, column, name, EXACT)
    return out.select("doc_id", "text", "n_chars", "sketch", "sketch_exact", "edited", "edited_sketch", "edited_sketch_exact",
                      likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))


def op9_scaled_sketch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint_documents(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.col("sketch_exact").alias("fingerprint_exact"), F.col("edited_sketch_exact").alias("edited_fingerprint_exact"))
