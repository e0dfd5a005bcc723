"""Language ID by segmentation-marginalised unigrams over a fixed public piece vocabulary.

Each language has a probability for every piece of the vocabulary.  The probability of a word is the sum over all ways to
cut it into pieces (forward algorithm); a text's log-probability is the sum over its words, and languages are
compared by posterior with their share of the training documents as prior.  Words are runs of letters, lower-cased,
with the vocabulary's word-start mark in front; a character that is no piece has a small fixed probability.

Piece probabilities come from expectation-maximisation over all segmentations of the training words.  The fit may use
a bounded sample: about ``fit_rows`` labelled documents per language, picked by a hash of doc_id (documented bound);
scoring covers whole texts of all documents.

Defined cases: null text, or text without a letter: ``und`` with score 0; rows without lang, and empty texts, teach
nothing; with no labelled row every document is ``und``; equal posteriors go to the first language by code point; very
long words (48 letters or more) are left out of the fit and scored by the same recursion one at a time; repeated rows are scored alike; an empty table
gives an empty result; extra columns pass through, and columns named like result columns are replaced.

Scale: one pass without a shuffle for scoring, with a bounded word cache per task; the fit shuffles word counts of the
bounded sample, and the driver sees one number per piece and language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.common import shards, written
from tillscope.session import ship_package

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-7  # probability of a character that is no piece
LIFT = 1e4  # forward sums carry LIFT per character, so that they stay in range
LONG = 48  # longer words are scored one at a time
COMMON = 63  # characters of the vocabulary's tree; words with others of its characters are looked up piece by piece
#: The "other" model of ``keep_identified``: all letters equally likely out of so many.
ALPHABET = 64
#: Share of a text's characters (other than white space) that must be letters for it to be in a language.
LETTER_SHARE = 0.25


def letter_words(text: str | None) -> list[str]:
    words = LETTERS.findall(text.lower()) if text else []
    return words if any(any(c.isalpha() for c in w) for w in words) else []


def load_pieces(path: str = VOCABULARY) -> dict[str, int]:
    """Piece -> number, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    some = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: i for i, p in enumerate(dict.fromkeys(some))}


class Lattice:
    """All segmentations of words into pieces.  Probability rows: the pieces, then unknown, then zero."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.n = pieces, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        # pieces and their beginnings: a stretch that begins no piece ends the search for longer ones
        self.begins = {p[:k]: self.n + 1 for p in pieces for k in range(1, len(p))}
        self.begins.update(pieces)
        # the same as a tree: node 0 is none, 1 the root; next node by (node, column of the character), piece by node
        node = {"": 1} | {s: i for i, s in enumerate(self.begins, 2)}
        often = Counter(s[-1] for s in self.begins)
        first = lambda c: (c != START, not (LETTERS.match(c) and c == c.lower()), -often[c], c)  # noqa: E731  what words are made of
        column = {c: i for i, c in enumerate(sorted(often, key=first)[:COMMON], 1)}
        self.column = np.zeros(0x110000, np.uint8)   # 0: in no piece, 255: in pieces, but not in the tree
        self.column[[ord(c) for c in often]] = [column.get(c, 255) for c in often]
        self.next, self.piece = np.zeros((len(node) + 1, COMMON + 1), np.int32), np.full(len(node) + 1, -1, np.int32)
        edges = [(node[s[:-1]], column[s[-1]], node[s]) for s in self.begins if s[-1] in column]
        if edges:
            up, by, down = np.array(edges).T
            self.next[up, by] = down
        self.piece[[node[s] for s in pieces]] = list(pieces.values())

    def of(self, words: list[str]) -> np.ndarray:
        """ids[w, end - 1, length - 1] for words of one length (start mark included)."""
        size, n = len(words[0]), self.n
        reach = min(size, self.longest)
        ids = np.full((len(words), size, reach), n + 1, np.int32)
        ids[:, :, 0] = n
        column = self.column[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        rare = (column.reshape(len(words), size) == 255).any(1)
        # stretches from every place of every word grow together by a character until they begin no piece
        at = np.flatnonzero(np.repeat(~rare, size))
        room, node, flat = size - at % size, np.ones(len(at), np.int32), ids.reshape(-1)
        for k in range(reach):
            node = self.next[node, column[at + k]]
            piece = self.piece[node]
            got = piece >= 0
            flat[at[got] * reach + k * (reach + 1)] = piece[got]
            go = (node > 0) & (room > k + 1)
            at, room, node = at[go], room[go], node[go]
            if not len(at):
                break
        some = np.flatnonzero(rare)
        if len(some):
            ids[some] = self._one_by_one([words[i] for i in some], ids[some])
        return ids

    def _one_by_one(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """``of`` for words of any characters, a lookup for each stretch."""
        _, size, reach = ids.shape
        n, get = self.n, self.begins.get
        at: list[int] = []
        found: list[int] = []
        base, step = 0, reach + 1
        for w in words:
            for i in range(size):
                place = base + i * reach
                for k in range(i + 1, min(i + reach, size) + 1):
                    piece = get(w[i:k])
                    if piece is None:
                        break
                    if piece < n:
                        at.append(place)
                        found.append(piece)
                    place += step
            base += size * reach
        ids.reshape(-1)[at] = found
        return ids

    @staticmethod
    def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
        """alpha[w, position, language]; ``p`` has a column per language."""
        n, size, reach = ids.shape
        lift = LIFT ** np.arange(reach + 1)
        alpha = np.zeros((n, size + 1, p.shape[1]))
        alpha[:, 0] = 1
        for j in range(1, size + 1):
            for k in range(1, min(j, reach) + 1):
                alpha[:, j] += p[ids[:, j - 1, k - 1]] * (lift[k] * alpha[:, j - k])
        return alpha

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """(words, languages) log-probabilities, summed over all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(i)
        for size, group in by_size.items():
            if size > LONG:
                for i in group:
                    out[i] = self._one(START + words[i], p)
                continue
            for at in range(0, len(group), 4096):
                part = group[at: at + 4096]
                alpha = self.forward(self.of([START + words[i] for i in part]), p)
                out[part] = np.log(alpha[:, -1]) - size * np.log(LIFT)
        return out

    def _one(self, word: str, p: np.ndarray) -> np.ndarray:
        """The same sum for one long word, rescaled at every position."""
        get, reach, shift = self.pieces.get, self.longest, np.zeros(p.shape[1])
        last = [np.ones(p.shape[1])]  # alpha of the last positions, all divided by exp(shift)
        for j in range(1, len(word) + 1):
            now = np.zeros(p.shape[1])
            for k in range(1, min(j, reach) + 1):
                i = get(word[j - k: j], self.n if k == 1 else self.n + 1)
                if i <= self.n:
                    now += p[i] * last[-k]
            last = [*last[-(reach - 1):], now] if reach > 1 else [now]
            last = [a / now for a in last]
            shift += np.log(now)
        return shift

    def expected(self, words: list[str], counts: list[float], p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in ``words`` (of at most LONG characters) under one language ``p``."""
        out = np.zeros(self.n + 2)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w) + 1, []).append(i)
        for size, group in by_size.items():
            for at in range(0, len(group), 1024):
                part = group[at: at + 1024]
                ids = self.of([START + words[i] for i in part])
                alpha = self.forward(ids, p[:, None])[:, :, 0]
                reach = ids.shape[2]
                lift = LIFT ** np.arange(reach + 1)
                beta = np.zeros_like(alpha)
                beta[:, size] = np.array([counts[i] for i in part]) / alpha[:, size]
                found, weight = [], []
                for j in range(size, 0, -1):
                    for k in range(1, min(j, reach) + 1):
                        w = p[ids[:, j - 1, k - 1]] * lift[k] * beta[:, j]
                        beta[:, j - k] += w
                        found.append(ids[:, j - 1, k - 1])
                        weight.append(w * alpha[:, j - k])
                out += np.bincount(np.concatenate(found), np.concatenate(weight), minlength=self.n + 2)
        return out


class Model:
    """Languages (by code point), log priors and piece probabilities with a column per language."""

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray, pieces: dict[str, int]):
        self.languages, self.prior, self.p, self.pieces = languages, prior, p, pieces


class Scorer:
    """Scores texts; remembers up to ``cache`` words."""

    def __init__(self, model: Model, cache: int = 100_000):
        self.m, self.lattice, self.cache = model, Lattice(model.pieces), cache
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(self.m.languages)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text."""
        return [s[:2] for s in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, posterior, whether the text is in it at all) of each text; words seen for the first time are scored together.

        A text is in its best language if that explains its letters better than the "other" model does (every letter and word
        start with probability 1 / ``ALPHABET``) and at least ``LETTER_SHARE`` of its characters are letters.
        """
        if len(self.number) > self.cache:
            self._clear()
        number, known, ids, letters = self.number, len(self.number), [], []
        for t in texts:
            words = letter_words(t)
            letters.append((sum(map(len, words)), len(words)))
            ids.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        if len(number) > known and self.m.languages:
            new = list(islice(number, known, None))
            self.table = np.concatenate([self.table, self.lattice.log_probability(new, self.m.p)])
        out = []
        for t, i, (n, starts) in zip(texts, ids, letters):
            if not len(i) or not self.m.languages:
                out.append(("und", 0.0, False))
                continue
            fit = self.table[i].sum(0)
            total = self.m.prior + fit
            best = int(total.argmax())
            other = -(n + starts) * np.log(ALPHABET)
            real = bool(fit[best] >= other and n >= LETTER_SHARE * sum(map(len, t.split())))
            out.append((self.m.languages[best], float(1 / np.exp(total - total[best]).sum()), real))
        return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document by the CRC32 of its doc_id as text is kept out of training (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY,
        fit_rows: int = 1000, rounds: int = 3, smooth: float = 0.1) -> Model:
    """Learn from labelled documents that are not held out."""
    spark, pieces = docs.sparkSession, load_pieces(vocabulary)
    ship_package(spark)
    train = docs.select(F.col(doc_id), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")) \
        .where(~held_out(doc_id) & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda x: x.encode("utf-8", "surrogatepass"))
    lattice = Lattice(pieces)
    if not languages:
        return Model([], np.zeros(0), np.zeros((len(pieces) + 2, 0)), pieces)
    # a hash picks about fit_rows documents of each language
    span = 1 << 30
    limit = {k: min(span, span * fit_rows // n) for k, n in counts.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]), F.col("lang"))
    some = train.where(F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(span)) < bound).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, "text"):
            got: Counter = Counter()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, n in Counter(letter_words(t)).items():
                    if len(w) < LONG:
                        got[k, w] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([w for _, w in got], pa.string()),
                                              pa.array(list(got.values()), pa.int64())], ["lang", "word", "n"])

    table = written(some.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
                    "langid-words")
    n_rows = lattice.n + 2
    p = np.full((n_rows, len(languages)), 1 / max(1, lattice.n))
    for _ in range(rounds):
        p[-2], p[-1] = UNKNOWN, 0
        shared = spark.sparkContext.broadcast((pieces, languages, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary_, names, probs = shared.value
            lat, out = Lattice(vocabulary_), np.zeros((len(vocabulary_) + 2, len(names)))
            for batch in batches:
                by: dict[str, tuple[list, list]] = {}
                for k, w, n in zip(*(c.to_pylist() for c in batch.columns)):
                    g = by.setdefault(k, ([], []))
                    g[0].append(w)
                    g[1].append(n)
                for k, (ws, ns) in by.items():
                    i = names.index(k)
                    out[:, i] += lat.expected(ws, ns, probs[:, i])
            piece, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(at), pa.array(out[piece, at])], ["piece", "at", "n"])

        got = table.mapInArrow(expect, "piece long, at long, n double").groupBy("piece", "at").agg(F.sum("n").alias("n")).toPandas()
        c = np.zeros((n_rows, len(languages)))
        c[got["piece"].to_numpy(np.int64), got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
        c = c[: lattice.n].round(6) + smooth  # rounding hides the order of the sums
        p = np.vstack([c / c.sum(0), np.zeros((2, len(languages)))])
        shared.unpersist()
    p[-2], p[-1] = UNKNOWN, 0
    n = np.array([counts[k] for k in languages], float)
    return Model(languages, np.log(n / n.sum()), p, pieces)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"),
            real: str | None = None) -> DataFrame:
    """``docs`` with the predicted language and its posterior, called ``names``, and whether the text is in it at all (``real``)."""
    names = (*names, real) if real else names
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()),
                                                           *([T.StructField(real, T.BooleanType())] if real else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in shards(batches, text):
            got = scorer.judge(batch.column(text).to_pylist())
            found = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())) if k < len(names)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *names])

    return docs.select(*keep).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without those in no known language (``und``, or better explained by the "other" model) or with a posterior below ``least``."""
    found = predict(docs, model, names=("__lang", "__score"), real="__real")
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= least) & F.col("__real")).select(*docs.columns)


def op7_unigram_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
