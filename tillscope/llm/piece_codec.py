"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes words: white-space marks followed by letters (no piece has a mark after another character, so merges never
cross a word's start).  The words that are new to a worker are laid out in flat numpy arrays of symbols with one rank per
neighbouring pair.  A round finds the smallest rank of every word (segmented minimum), merges all its leftmost
non-overlapping occurrences in every word at once, closes the gaps and looks up only the pairs beside a merge; words
without a pair leave the arrays.  The library merges one pair at a time, so a round is kept only where that order cannot
differ: where a merge brings up a pair that ranks no later than the one being merged (runs of white space, whose pieces all
rank alike), the word is merged pair by pair from a heap instead.  Characters outside the vocabulary become byte pieces.
Decoding gathers the pieces' bytes by id, drops the mark added in front, and replaces each byte that is no valid UTF-8.

Defined results: null or empty text has the begin and end ids only and decodes to the empty text; every row gives a row, so
repeated rows and repeated or null doc_ids stay; an empty table gives an empty table; other columns are left out, whatever
their names.  Texts of any length are encoded whole.  Texts holding the mark character itself decode to a space there, as in
the library.

Scale: one pass over the table without shuffle; a worker holds a slice of text and the memory of recent words
(``MEMORY_BYTES``), which the words of one slice may exceed only by their own size.  The model file is read on the driver
(its size is checked against ``MODEL_BYTES``) and travels with the function.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import shards
from tillscope.session import ship_package

MODEL_NAME = "piece_bpe_32k.model"
#: Largest model file that is sent along.
MODEL_BYTES = 16 << 20
#: Text and ids of known words that a worker keeps.
MEMORY_BYTES = 32 << 20
#: Words above this length are not kept from slice to slice.
KEEP_CHARS = 64
MARK = "▁"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.int32(1 << 30)

# Piece types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol-buffer message."""
    i = 0

    def varint(i):
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, i

    while i < len(data):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            n, i = varint(i)
            value, i = data[i:i + n], i + n
        elif wire == 5:
            value, i = struct.unpack("<f", data[i:i + 4])[0], i + 4
        elif wire == 1:
            value, i = data[i:i + 8], i + 8
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


class PieceModel:
    """A SentencePiece BPE model: pieces, ranks and the table of pairs that merge."""

    def __init__(self, data: bytes):
        entries, self.normalizer, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                entries.append((f[1].decode(), float(f.get(2, 0.0)), int(f.get(3, NORMAL))))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                self.normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or self.normalizer.get(2) or self.normalizer.get(4, 1) or not self.normalizer.get(3, 1):
            raise ValueError("expects a BPE model with identity normalisation, a mark in front and white space kept")
        self.pieces = [p for p, _, _ in entries]
        kind = np.array([k for _, _, k in entries], np.int8)
        if (kind == USER_DEFINED).any() or (kind == UNUSED).any():
            raise ValueError("user-defined and unused pieces are not supported")
        self.kind = kind
        self.unknown = int(np.flatnonzero(kind == UNKNOWN)[0])
        self.begin, self.end = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.id_of = {p: i for i, (p, _, k) in enumerate(entries) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece has a white-space mark behind another character")
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = {}
        for i in np.flatnonzero(kind == BYTE):
            b = int(self.pieces[i][1:-1], 16)
            self.byte_id[b], self.byte_of[int(i)] = i, b
        # equal scores share a rank: the leftmost of such pairs goes first
        order = {s: r for r, s in enumerate(sorted({s for _, s, k in entries if k == NORMAL}, reverse=True))}
        self.rank = np.array([order[s] if k == NORMAL else _NONE for _, s, k in entries], np.int32)
        n = len(entries)
        pairs = {}
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.n = n
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys], np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        raw = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([self.byte_of[i]]) if k == BYTE
               else p.replace(MARK, " ").encode() for i, (p, _, k) in enumerate(entries)]
        self.length = np.array([len(r) for r in raw], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    # ---- encoding ----
    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of the pairs; symbols below 0 (outside the vocabulary) merge with nothing."""
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (a >= 0) & (b >= 0) & (self.keys[at] == key)
        merged = np.where(ok, self.merged[at], 0)
        return np.where(ok, self.rank[merged], _NONE), merged

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        if not words:
            return out
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32)
        size = np.array([len(w) for w in words], np.int64)
        sym = self.char_id[code]
        sym = np.where(sym < 0, -1 - code, sym)
        word = np.repeat(np.arange(len(words)), size)
        rank, into = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside], into[inside] = self.lookup(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            number = np.cumsum(np.concatenate([[False], word[1:] != word[:-1]]))
            done = least[number] == _NONE
            if done.any():
                self._finish(sym[done], word[done], out)
                go = ~done
                sym, word, rank, into = sym[go], word[go], rank[go], into[go]
                continue
            hit = rank == least[number]
            place = np.arange(len(sym))
            before = np.maximum.accumulate(np.where(hit, -1, place))
            take = hit & ((place - before) % 2 == 1)   # every second one of a run: leftmost first, none overlap
            bad = self._order_matters(sym, word, rank, into, take)
            if len(bad):
                slow = np.isin(word, bad)
                for w in bad:
                    s = self._one_by_one(sym[word == w].tolist())
                    self._finish(np.array(s, np.int32), np.full(len(s), w), out)
                go = ~slow
                sym, word, rank, into, take = sym[go], word[go], rank[go], into[go], take[go]
                if not len(sym):
                    break
            sym = np.where(take, into, sym)
            gone = np.concatenate([[False], take[:-1]])
            new = take[~gone]
            sym, word, rank, into = sym[~gone], word[~gone], rank[~gone], into[~gone]
            touched = new | np.concatenate([new[1:], [False]])   # a merged symbol and its left neighbour
            rank[touched] = _NONE
            at = np.flatnonzero(touched[:-1] & (word[:-1] == word[1:]))
            rank[at], into[at] = self.lookup(sym[at], sym[at + 1])
        return out

    def _order_matters(self, sym, word, rank, into, take) -> np.ndarray:
        """Words in which a merge of this round brings up a pair that ranks no later than the merged one."""
        at = np.flatnonzero(take)
        own, r, w, n = into[at], rank[at], word[at], len(sym)
        bad = np.zeros(len(at), bool)
        left = np.maximum(at - 1, 0)
        has = (at > 0) & (word[left] == w)
        was = np.maximum(at - 2, 0)
        near = np.where((at > 1) & take[was] & (word[was] == w), into[was], sym[left])
        bad |= has & (self.lookup(near, own)[0] <= r)
        right = np.minimum(at + 2, n - 1)
        has = (at + 2 < n) & (word[right] == w)
        bad |= has & (self.lookup(own, sym[right])[0] <= r)
        bad |= has & take[right] & (self.lookup(own, into[right])[0] <= r)
        return np.unique(w[bad])

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """Merges of one word pair by pair: smallest rank first, leftmost among equals."""
        n = len(sym)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i):
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0:
                m = self.pairs.get(sym[i] * self.n + sym[j])
                if m is not None:
                    heapq.heappush(heap, (int(self.rank[m]), i, sym[i], sym[j], m))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if not live[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], live[j] = m, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [s for s, ok in zip(sym, live) if ok]

    def _finish(self, sym: np.ndarray, word: np.ndarray, out: list) -> None:
        if (sym < 0).any():   # byte pieces
            parts = [self.byte_id[np.frombuffer(chr(-1 - s).encode(), np.uint8)] if s < 0 else [s] for s in sym.tolist()]
            word = np.repeat(word, [len(p) for p in parts])
            sym = np.concatenate(parts)
        data = sym.astype("<u4").tobytes()
        edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]]))
        for w, a, b in zip(word[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            out[w] = data[4 * a:4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian unsigned 32-bit integers."""
        if self.known_bytes > MEMORY_BYTES:
            self.known, self.known_bytes = {}, 0
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = self.known
        new = list({w for words in split for w in words if w not in seen})
        seen.update(zip(new, self.merge_words(new)))
        head, tail = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        out = [b"".join([head, *map(seen.__getitem__, words), tail]) for words in split]
        for w in new:
            if len(w) > KEEP_CHARS:
                del seen[w]
            else:
                self.known_bytes += 5 * len(w)
        return out

    # ---- decoding ----
    def decode(self, rows: list[bytes]) -> list[str]:
        """Texts of rows of ids (little-endian unsigned 32-bit integers)."""
        count = np.array([len(r) // 4 for r in rows], np.int64)
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        if len(ids) and ids.max() >= self.n:
            raise ValueError("id outside the vocabulary")
        size = self.length[ids]
        end = np.cumsum(size)
        data = self.pool[np.repeat(self.offset[ids] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)].tobytes()
        bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
        last = np.concatenate([[0], np.cumsum(count)])
        texts = []
        for i in range(len(rows)):
            part = data[bound[i]:bound[i + 1]]
            own = ids[last[i]:last[i + 1]]
            at = np.flatnonzero(self.length[own] > 0)
            said = own[at]
            if len(at) and at[-1] - at[0] >= len(at):   # a control id may part byte pieces
                texts.append(self._decode_slowly(own))
                continue
            if len(said) and self.pieces[said[0]].startswith(MARK) and self.kind[said[0]] == NORMAL:
                part = part[1:]   # the mark in front
            try:
                texts.append(part.decode())
            except UnicodeDecodeError:
                texts.append(self._decode_slowly(own))
        return texts

    def _decode_slowly(self, ids: np.ndarray) -> str:
        """Byte pieces that are no valid UTF-8 give one replacement character a byte."""
        out, run, first = [], bytearray(), True

        def flush():
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i:i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            first = first and not out
            if self.kind[i] == CONTROL:
                continue
            p = " ⁇ " if self.kind[i] == UNKNOWN else self.pieces[i]
            if first and p.startswith(MARK):
                p, first = p[1:], False
            out.append(p.replace(MARK, " ") if self.kind[i] == NORMAL else p)
        flush()
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def piece_model(data: bytes) -> PieceModel:
    """The model, built once per Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PieceModel(data)
    return _MODELS[key]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL_NAME)
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"model file above {MODEL_BYTES} bytes")
    return data


def encode_documents(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ids packed as little-endian unsigned 32-bit integers, decoded the text of those ids."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for part in shards(batches, "text"):
            ids = m.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array(m.decode(ids), pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("doc_id", key)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    coded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_bytes())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
