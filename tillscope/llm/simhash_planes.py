"""SimHash near-duplicate detection with bit-sliced distance counting.

Fingerprint (64 bits): A-Z lower-cased, words are runs of characters other than space and U+0009-U+000D, shingles
are ``shingle`` consecutive words (repeats included, joined by one space; fewer words: the whole sequence), h is
a shingle's XXH64 with seed 42; a bit is 1 if it is set in over half of the h.  No words: zero.

Linking is exact.  Two fingerprints that differ in at most r bits agree on at least m - r of m bit blocks, so every
choice of m - r blocks gives a bucket key; m grows with the number of distinct fingerprints so that buckets stay
small.  Inside a bucket the fingerprints lie vertically (one bit plane per bit, one lane per fingerprint).
Lane i is compared with lane i + s for all lanes at once: the differing planes are added into carry-save
counters and a block of lanes is abandoned once all its distances exceed r.  A bucket larger than
``bucket_rows`` is cut into parts and every pair of parts is compared in a task of its own.  Tasks return a
spanning forest of their links, never all pairs; components follow by large-star/small-star steps.

Defined cases: null, empty or blank text has fingerprint zero and links like any other; repeated rows are judged one
by one; a component is named by its smallest non-null doc_id (null if it has none); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.common import lookup, shards, written
from tillscope.llm.components import components
from tillscope.session import ship_package

BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    import xxhash

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    starts = (end - size)[:n].tolist()
    ends = (end - 1)[min(shingle, len(words)) - 1:].tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends)], repeat(42)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at: at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, "text"):
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, fp long")


def bucket_masks(n: int, radius: int) -> list[int]:
    """Bit masks of the bucket keys: the fewest blocks m (two must agree at least) for which a key has about log2(n) bits."""
    m = radius + 2
    while 2 ** (BITS * (m - radius) // m) * 16 < n and m < 2 * radius + 4:
        m += 1
    edge = [round(BITS * i / m) for i in range(m + 1)]
    blocks = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, m - radius)]
    assert len(masks) == comb(m, radius)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bit_sliced_links(fp: np.ndarray, run_end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (member, root) of the links among fingerprints of one block.

    ``run_end[i]`` is where the bucket of lane i ends.  Python integers serve as bit vectors over the lanes.
    """
    n = len(fp)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(p.tobytes(), "little") for p in np.packbits(bits.T, axis=1, bitorder="little")]
    room = run_end - np.arange(n)
    label = np.arange(n)
    size = (n + 7) // 8
    n_counters = (radius + 4).bit_length()  # four planes are added between two looks
    pending: list[np.ndarray] = []

    def settle() -> None:
        a, b = np.concatenate([p[0] for p in pending]), np.concatenate([p[1] for p in pending])
        pending.clear()
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label[:] = label[label]
            if (old == label).all():
                break

    n_pending = 0
    for s in range(1, int(room.max())):
        alive = int.from_bytes(np.packbits(room > s, bitorder="little").tobytes(), "little")
        counter = [0] * n_counters
        for k, plane in enumerate(planes):
            carry = (plane ^ (plane >> s)) & alive
            for c in range(n_counters):
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
                if not carry:
                    break
            if k % 4 == 3 or k == BITS - 1:
                alive &= ~_exceeds(counter, radius)
                if not alive:
                    break
        if alive:
            i = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes(size, "little"), np.uint8), count=n, bitorder="little"))
            pending.append(np.stack([i, i + s]))
            n_pending += len(i)
            if n_pending > 1 << 20:
                settle()
                n_pending = 0
    if pending:
        settle()
    member = np.flatnonzero(label != np.arange(n))
    return fp[member], fp[label[member]]


def _exceeds(counter: list[int], radius: int) -> int:
    """Lanes whose counter (bits from low to high) is above ``radius``."""
    above, equal = 0, -1
    for c in range(len(counter) - 1, -1, -1):
        if radius >> c & 1:
            equal &= counter[c]
        else:
            above |= equal & counter[c]
            equal &= ~counter[c]
    return above


def _links(radius: int, block: int = 4096):
    def blocks(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Compare whole runs of equal keys, about ``block`` lanes at a time."""
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        keep = np.diff(edge) > 1
        begin, end = edge[:-1][keep], edge[1:][keep]
        at = 0
        while at < len(begin):
            upto = at + 1
            total = end[at] - begin[at]
            while upto < len(begin) and total + end[upto] - begin[upto] <= block:
                total += end[upto] - begin[upto]
                upto += 1
            sizes = end[at:upto] - begin[at:upto]
            lanes = np.repeat(begin[at:upto] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
            a, b = bit_sliced_links(fp[lanes], np.repeat(np.cumsum(sizes), sizes), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by key; the last run may go on in the next batch
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(key) < 1 << 15:
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from blocks(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield from blocks(key, fp)
    return run


def near_links(fps: DataFrame, n: int, radius: int = 4, bucket_rows: int = 2048) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fps`` (fp): enough of them to connect all within ``radius``."""
    ship_package(fps.sparkSession)
    masks = bucket_masks(n, radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    hot = written(sizes.select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")), "simhash-hot")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    dealt = lookup(rows, hot, ["key"]).select("key", "fp", F.explode(pairs).alias("pair"))
    dealt = dealt.select(F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links(radius), "u long, v long")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are connected by links of at most ``radius`` bits."""
    each = written(fingerprints(docs, doc_id, text, shingle), "simhash-docs")
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-fps")
    n_fps, n_docs = fps.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return each.select("doc_id", "fp", F.col("doc_id").alias("component_id"))
    roots = written(components(near_links(fps.select("fp"), n_fps, radius), "simhash-links")
                    .select(F.col("node").alias("fp"), "root"), "simhash-roots")
    linked = lookup(roots, fps, ["fp"], "inner")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    least = written(lookup(linked, least, ["root"], "inner").select("fp", "component_id"), "simhash-least")
    named = written(lookup(fps, least, ["fp"]).select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"),
                    "simhash-named")
    # at most 1000 fingerprints can have more than a thousandth of the rows each
    hot = F.broadcast(named.where(F.col("n") > n_docs // 1000 + 1).select("fp", "component_id"))
    cold = named.where(F.col("n") <= n_docs // 1000 + 1).select("fp", "component_id")
    return each.join(hot, "fp").unionByName(each.join(hot, "fp", "left_anti").join(cold, "fp")) \
        .select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Rows without doc_id cannot be told apart by it and are all kept; of rows that repeat a kept doc_id one is kept.
    """
    found = near_components(docs, doc_id, text, shingle, radius)
    ids = written(found.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-ids")
    gone = written(ids.where("component_id < doc_id").select(F.col("doc_id").alias(doc_id)), "simhash-gone")
    twice = written(ids.where("n > 1 and component_id >= doc_id").select(F.col("doc_id").alias(doc_id)), "simhash-twice")
    left = lookup(docs, gone, [doc_id], "left_anti")
    if twice.isEmpty():
        return left
    return lookup(left, twice, [doc_id], "left_anti").unionByName(
        lookup(left, twice, [doc_id], "left_semi").dropDuplicates([doc_id]))


def op6_simhash_components(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
