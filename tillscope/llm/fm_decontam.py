"""Benchmark decontamination with an FM-index per training shard.

A shard is some 2 MB of documents' text.  Its text is written over the benchmark's word alphabet; a word outside
the alphabet, or the end of a document, is a break, and a stretch between breaks that is shorter than the
shortest test phrase is left out (no phrase crosses a break, so nothing can be missed).  The shard's suffixes are
sorted, the Burrows-Wheeler transform is stored as a wavelet matrix with ranks, every test phrase is searched
backwards, occurrences are located through sampled suffix positions, and their spans are merged per document.

Words: A-Z lower-cased, then runs of digits, letters a-z and characters beyond ASCII.  Test phrases: every
``window`` consecutive words of an item; an item with fewer words (but at least one) is one phrase.

Defined cases: null or wordless text has no words and no hits; null or wordless items have no phrases; rows with
equal item_id are one item; an item without id hits words but is not listed; repeated document rows are
judged one by one; an empty benchmark or empty documents give no hits; extra columns pass through, and a column
named like a result column is replaced by the result.

Scale: documents are read once and never shuffled.  The benchmark is a stated query set; it is taken in blocks of
about ``block_bytes`` of text, each broadcast.  Memory per task: one Arrow batch, the words and index of one shard, and one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.common import shards
from tillscope.session import ship_package

#: The word characters of the operator's contract.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane per level, highest bit first."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``upto`` (elementwise)."""
        i, start = upto, np.zeros_like(upto)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """FM-index of a sequence of symbols >= 1 in which every 0 is a break that equals nothing; it ends with a break."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 8):
        n = len(seq)
        is_break = seq == 0
        n_breaks = int(is_break.sum())
        rank = seq.astype(np.int64) + n_breaks
        rank[is_break] = np.arange(n_breaks)
        step = 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: n - step] = rank[step:]
            key = rank * (n + n_symbols + 2) + after + 1
            sa = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[sa] = np.concatenate([[0], np.cumsum(np.diff(key[sa]) != 0)])
            rank = new
            if n == 0 or rank[sa[-1]] == n - 1:
                break
            step *= 2
        before = np.where(sa > 0, seq[sa - 1], 0)
        self.bwt = before.astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, n_symbols)
        counts = np.bincount(seq, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: n_symbols + 1]
        starts = np.zeros(n, bool)
        starts[0] = True
        starts[1:] = is_break[:-1]
        marked = (sa % sample == 0) | starts[sa]  # a walk never has to step over a break
        self.marked = marked
        self.sampled = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of each row of ``phrases`` (symbols >= 1, one length)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.tree.rank(c, lo[live])
            hi[live] = self.first[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix-array rows: walk back to a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.marked[rows])
        while len(walk):
            c = self.bwt[rows[walk]]
            rows[walk] = self.first[c] + self.tree.rank(c, rows[walk])
            steps[walk] += 1
            walk = walk[~self.marked[rows[walk]]]
        return self.samples[self.sampled[rows]] + steps


class Phrases:
    """The distinct test phrases of a block of items, by length, over the block's own alphabet."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words_of(text)]
            if ids:
                for i in range(max(1, len(ids) - window + 1)):
                    of.setdefault(tuple(ids[i: i + window]), set()).add(item)
        self.by_len: list[tuple[np.ndarray, list[list[int]]]] = []
        for size in sorted({len(p) for p in of}):
            some = sorted(p for p in of if len(p) == size)
            self.by_len.append((np.array(some, np.int64), [sorted(x for x in of[p] if x is not None) for p in some]))
        self.shortest = min((p.shape[1] for p, _ in self.by_len), default=0)

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """Hit flags over all words of a shard (a spare word after each document), where documents start, items by document."""
        get = self.symbols.get
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        seq = np.zeros(int(starts[-1]), np.int64)
        for d, at in zip(docs, starts):
            seq[at: at + len(d)] = [get(w, 0) for w in d]
        hit, items = np.zeros(len(seq), bool), {}
        known = np.concatenate([[False], seq > 0, [False]])
        begin, end = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
        long = (end - begin) >= max(1, self.shortest)
        begin, end = begin[long], end[long]
        if not len(begin) or not self.by_len:
            return hit, starts, items
        # every stretch, followed by the break that stands after it
        lengths = end - begin + 1
        offset = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(offset[-1]) - np.repeat(offset[:-1] - begin, lengths)
        index = FMIndex(seq[place], len(self.symbols))
        cover = np.zeros(len(seq) + 1, np.int64)
        for phrases, owners in self.by_len:
            lo, hi = index.search(phrases)
            n = hi - lo
            which = np.repeat(np.arange(len(phrases)), n)
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            at = place[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + phrases.shape[1], -1)
            doc = np.searchsorted(starts, at, "right") - 1
            for d, p in np.unique(np.stack([doc, which], 1), axis=0):
                items.setdefault(int(d), set()).update(owners[p])
        hit = np.cumsum(cover[:-1]) > 0
        return hit, starts, items


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def cut_words(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the stretches from the first to the last word of each word span."""
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(0x41, 0x5B)}))]
    out, last = [], 0
    for s in spans:
        out.append(text[last: at[s["start"]][0]])
        last = at[s["end"] - 1][1]
    return "".join([*out, text[last:]])


def _search(blocks: list, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
    """Hits of a shard over all benchmark blocks; of several blocks a task holds one at a time."""
    hit = starts = None
    items: dict[int, set] = {}
    for block in blocks:
        phrases = block.value
        more, starts, found = phrases.find(docs)
        hit = more if hit is None else hit | more
        for d, ids in found.items():
            items.setdefault(d, set()).update(ids)
        if len(blocks) > 1:
            del phrases
            block.__dict__.pop("_value", None)
    return hit, starts, items


def _blocks(bench: DataFrame, window: int, item_id: str, item_text: str, block_bytes: int) -> list:
    """The test phrases as broadcast variables of at most about ``block_bytes`` of text each."""
    spark = bench.sparkSession
    ship_package(spark)
    bench = bench.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + int(total // block_bytes)
    of = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in bench.where(of == b).collect()], window)) for b in range(n)]


def find_benchmark(docs: DataFrame, bench: DataFrame, window: int = 10, text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, spans (word positions, end exclusive) and items (ids found)."""
    blocks = _blocks(bench, window, item_id, item_text, block_bytes)
    keep = [c for c in docs.columns if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, text):
            words = [words_of(t) for t in batch.column(text).to_pylist()]
            hit, starts, items = _search(blocks, words)
            spans: list = [[] for _ in words]
            found: list = [[] for _ in words]
            hits = np.add.reduceat(hit, starts[:-1], dtype=np.int64) if len(words) else np.zeros(0, np.int64)
            for d in np.flatnonzero(hits):
                spans[d], found[d] = _spans(hit[starts[d]: starts[d + 1]]), sorted(items.get(int(d), ()))
            cols = [batch.column(c) for c in keep]
            cols += [pa.array([len(d) for d in words], pa.int64()), pa.array(hits, pa.int64()),
                     pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *RESULT.names])

    return docs.select(*keep).mapInArrow(run, schema)


def remove_benchmark(docs: DataFrame, bench: DataFrame, window: int = 10, text: str = "text",
                     item_id: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """Cut every merged span out of the documents' texts; a document of which no word is left goes.

    Documents without hits keep their text as it is.  ``n_chars``, where present, follows the text.
    """
    blocks = _blocks(bench, window, item_id, item_text, block_bytes)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, text):
            texts = batch.column(text).to_pylist()
            words = [words_of(t) for t in texts]
            hit, starts, _ = _search(blocks, words)
            hits = np.add.reduceat(hit, starts[:-1], dtype=np.int64) if len(words) else np.zeros(0, np.int64)
            if not hits.any():
                yield batch
                continue
            cols = {c: batch.column(c) for c in names}
            sizes = cols["n_chars"].to_pylist() if "n_chars" in cols else None
            for d in np.flatnonzero(hits):
                texts[d] = cut_words(texts[d], _spans(hit[starts[d]: starts[d + 1]]))
                if sizes:
                    sizes[d] = len(texts[d])
            cols[text] = pa.array(texts, cols[text].type)
            if sizes:
                cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
            left = pa.array([n == 0 or n < len(w) for n, w in zip(hits, words)])
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names).filter(left)

    return docs.mapInArrow(run, docs.schema)


def op1_fm_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM low),
occ AS (
  SELECT p.doc_id, p.i, s.size, array_to_string(p.w[p.i:p.i + s.size - 1], ' ') AS phrase
  FROM pos p, (SELECT DISTINCT size FROM win) s WHERE p.i + s.size - 1 <= len(p.w)),
hits AS (SELECT o.doc_id, o.i, o.size, w.item_id FROM occ o JOIN win w ON w.size = o.size AND w.phrase = o.phrase),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT l.doc_id, len(l.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(f.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN words h USING (doc_id) LEFT JOIN found f USING (doc_id)"""
