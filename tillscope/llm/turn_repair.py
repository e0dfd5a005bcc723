"""Repair of conversation structure by Four-Russians block tables.

A conversation's roles should read ``(system? (user assistant)+)?``.  Every row is kept (0), given the role user or assistant
(2) or deleted (3, required for blank and duplicate rows); rows with empty text may be put in anywhere (2); a truncated row
that stays costs 1 more.  The automaton has four states, so what is left to pay at a row is a vector of four costs.  Less its
smallest entry it takes few values (inserts tie the states together); they are enumerated, and for every vector and every
block of ``BLOCK`` row symbols the table holds the vector before the block and the cost between.  Conversations are worked
off from the end, a block a lookup, all conversations of a batch together.  Each block is then expanded backward to its
cost vectors by row, and the edits are read off forward, at each place the ASCII-least letter that keeps the cost:
expansions are remembered by (vector behind, block, state before).

Fault of a row, the first that holds: blank (only white space x20, x09-x0D), duplicate (role and text stand earlier in the
conversation), truncated (the last other character is none of ``. ! ?``).  A role counts by its first character; an empty
role fits nowhere and is given a role or deleted.

Defined results: null role or text reads as one space, null turns come first, and a null conv_id is a conversation of its
own; rows of one turn are ordered by role and text, so equal rows are interchangeable; repeated rows are duplicates; a
conversation without rows (after damage) has zeros, no edits and the digest of the empty text; an empty table gives an empty
table; other columns are left out, whatever their names; texts of any length are read whole.

Scale: conversations of up to ``long_rows`` rows are shuffled by conversation and streamed, a batch at a time.  Longer ones
(found by a count that combines on the map side) are cut into runs of ``segment_rows`` rows over range partitions, so no
task holds one of them whole: first occurrences come from an aggregate and a salted lookup, each run gives its map from
vector behind to vector before, a stream over these maps fixes the vectors, the runs are traced for each of the four
states, and a last stream strings them together (a digest over one conversation is sequential, its memory is one batch).
Equal rows of one turn stay together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import lookup, written
from tillscope.session import ship_package

BLOCK = 4
LONG_ROWS = 4096
SEGMENT_ROWS = 512
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
WHITE = " \t\n\v\f\r"

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept role, by initial and state before.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: State after a role that is put in or given.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
# Row symbols: no row, must go, then initial (s, u, a, other) times truncated.
NO_ROW, GOES = 0, 1
SYMBOLS = 10
END = (0, 4, 2, 0)   # what the states pay behind the last row


def symbol(initial: str, truncated: bool) -> int:
    return 2 + 2 * ("sua".find(initial) if initial in ("s", "u", "a") else 3) + truncated


def _kept(state: int, sym: int) -> int | None:
    return KEEP.get("sua"[(sym - 2) // 2] if sym < 8 else "", {}).get(state)


def _before(behind: tuple, sym: int) -> tuple:
    """Cost vector before a row, from the one behind it."""
    if sym == NO_ROW:
        return behind
    out = []
    for q in range(4):
        best = DELETE + behind[q]
        if sym != GOES:
            t = CUT * (sym % 2)
            best = min(best, REROLE + t + behind[NEXT[q]])
            k = _kept(q, sym)
            if k is not None:
                best = min(best, t + behind[k])
        out.append(best)
    for _ in range(3):   # inserts before the row
        out = [min(c, INSERT + out[NEXT[q]]) for q, c in enumerate(out)]
    return tuple(out)


class Tables:
    """The cost vectors, their transitions by symbol and by block, and the expanded blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors, self.index = [], {}
        todo = [END]
        steps = {}
        while todo:
            v = todo.pop()
            if v in self.index:
                continue
            self.index[v] = len(self.vectors)
            self.vectors.append(v)
            for s in range(SYMBOLS):
                h = _before(v, s)
                low = min(h)
                steps[v, s] = (tuple(c - low for c in h), low)
                todo.append(steps[v, s][0])
        n = len(self.vectors)
        one = np.zeros((n, SYMBOLS), np.int64)
        pay = np.zeros((n, SYMBOLS), np.int64)
        for (v, s), (h, low) in steps.items():
            one[self.index[v], s], pay[self.index[v], s] = self.index[h], low
        # codes read first row first; blocks grow to the front
        self.to, self.cost = one, pay
        for i in range(1, block):
            size = SYMBOLS ** i
            self.to, self.cost = (np.concatenate([one[self.to, s] for s in range(SYMBOLS)], 1),
                                  np.concatenate([self.cost + pay[self.to, s] for s in range(SYMBOLS)], 1))
            assert self.to.shape == (n, size * SYMBOLS)
        self.vector = np.array(self.vectors, np.int64)
        self.known: dict[tuple[int, int, int], tuple[tuple, int]] = {}

    def codes(self, syms: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of each sequence (flat symbols, lengths), padded in front: (codes, number of blocks)."""
        blocks = -(-size // self.block)
        total = np.cumsum(blocks * self.block)
        flat = np.zeros(int(total[-1]) if len(total) else 0, np.int64)
        first = total - size   # padding stands in front
        flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(syms))] = syms
        return flat.reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1)), blocks

    def behind(self, codes: np.ndarray, blocks: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector behind every block, vector before the first block, cost) of sequences whose last vector is ``last``."""
        at, vec, cost = np.cumsum(blocks) - 1, last.copy(), np.zeros(len(blocks), np.int64)
        out = np.zeros(len(codes), np.int64)
        live, step = np.flatnonzero(blocks > 0), 0
        while len(live):
            place = at[live] - step
            v = vec[live]
            out[place] = v
            vec[live], cost[live] = self.to[v, codes[place]], cost[live] + self.cost[v, codes[place]]
            step += 1
            live = live[blocks[live] > step]
        return out, vec, cost

    def edits(self, vec: int, code: int, state: int) -> tuple[tuple, int]:
        """The block's edits ((letter, role given or None), ...) and the state behind it."""
        key = (vec, code, state)
        if key not in self.known:
            syms = [code // SYMBOLS ** i % SYMBOLS for i in range(self.block - 1, -1, -1)]
            costs = [self.vectors[vec]]
            for s in reversed(syms):
                costs.append(_before(costs[-1], s))
            costs.reverse()
            self.known[key] = self._read(syms, costs, state)
        return self.known[key]

    @staticmethod
    def _read(syms: list[int], costs: list[tuple], q: int) -> tuple[tuple, int]:
        out = []
        for i, s in enumerate(syms):
            if s == NO_ROW:
                continue
            here, behind = costs[i], costs[i + 1]
            while True:
                t, k = CUT * (s % 2), None if s == GOES else _kept(q, s)
                if here[q] == DELETE + behind[q]:
                    out.append(("D", None))
                elif here[q] == INSERT + here[NEXT[q]]:
                    q = NEXT[q]
                    out.append(("I", NAME[q]))
                    continue
                elif k is not None and here[q] == t + behind[k]:
                    q = k
                    out.append(("K", None))
                else:
                    q = NEXT[q]
                    out.append(("R", NAME[q]))
                break
        return tuple(out), q

    @staticmethod
    def closing(q: int) -> list[tuple[str, str]]:
        """Inserts behind the last row."""
        out = []
        while END[q]:
            q = NEXT[q]
            out.append(("I", NAME[q]))
        return out


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


# ---- rows to symbols ----
def faults(roles: list[str], texts: list[str], repeat: list[bool] | None = None) -> tuple[list[int], tuple[int, int, int]]:
    """Symbols of a conversation's rows and (blank, duplicate, truncated); ``repeat`` overrides the search for duplicates."""
    seen, syms, blank, duplicate, cut = set(), [], 0, 0, 0
    for i, (role, text) in enumerate(zip(roles, texts)):
        core = text.rstrip(WHITE)
        again = repeat[i] if repeat is not None else (role, text) in seen
        if repeat is None:
            seen.add((role, text))
        if not core:
            blank += 1
            syms.append(GOES)
        elif again:
            duplicate += 1
            syms.append(GOES)
        else:
            short = core[-1] not in ".!?"
            cut += short
            syms.append(symbol(role[:1], short))
    return syms, (blank, duplicate, cut)


_LEGAL = {"su", "ua", "au"}


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:]))


def repaired_lines(edits, roles: list[str], texts: list[str]) -> Iterator[str]:
    """Lines ``role:text`` after the edits."""
    i = 0
    for letter, role in edits:
        if letter == "I":
            yield f"{role}:"
            continue
        if letter != "D":
            yield f"{roles[i] if role is None else role}:{texts[i]}"
        i += 1


class Digest:
    """Running SHA-256 of newline-joined lines."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, lines) -> None:
        for line in lines:
            self.sha.update(("\n" + line if self.some else line).encode())
            self.some = True


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repair(conversations: list[tuple[list, list[str], list[str]]], block: int = BLOCK) -> list[tuple]:
    """Result tuples of whole conversations (turns, roles, texts in order), worked off together."""
    t = tables(block)
    found = [faults(roles, texts) for _, roles, texts in conversations]
    size = np.array([len(s) for s, _ in found], np.int64)
    codes, blocks = t.codes(np.array([x for s, _ in found for x in s], np.int64), size)
    behind, before, cost = t.behind(codes, blocks, np.full(len(size), t.index[END]))
    cost = cost + t.vector[before, START] if len(size) else cost
    codes, behind, edge = codes.tolist(), behind.tolist(), np.concatenate([[0], np.cumsum(blocks)]).tolist()
    out = []
    for n, ((turns, roles, texts), (_, counts)) in enumerate(zip(conversations, found)):
        q, edits = START, []
        for b in range(edge[n], edge[n + 1]):
            part, q = t.edits(behind[b], codes[b], q)
            edits.extend(part)
        edits.extend(t.closing(q))
        digest = Digest()
        digest.add(repaired_lines(edits, roles, texts))
        known = {x for x in turns if x is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        out.append((gaps, *counts, illegal_pairs(roles), int(cost[n]), "".join(e[0] for e in edits), digest.sha.hexdigest()))
    return out


# ---- Spark ----
def _by_turn():
    return F.col("turn").asc_nulls_first()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple]]:
    """Runs of equal ``key`` in sorted batches, as lists of whole groups per batch (a group over two batches is carried on)."""
    held: list[tuple] = []
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        at = batch.schema.get_field_index(key)
        if not rows:
            continue
        rows = held + rows
        last = rows[-1][at]
        cut = len(rows)
        while cut and rows[cut - 1][at] == last:
            cut -= 1
        held = rows[cut:]
        if cut:
            yield rows[:cut]
    if held:
        yield held


def _short(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "key"):
            ids, conversations, last = [], [], None
            for key, conv, there, turn, role, text in group:
                if key != last:
                    ids.append(conv)
                    conversations.append(([], [], []))
                    last = key
                if there:
                    for part, value in zip(conversations[-1], (turn, role, text)):
                        part.append(value)
            cols = list(zip(*repair(conversations)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *[pa.array(c, pa.int64()) for c in cols[:6]], *[pa.array(c, pa.string()) for c in cols[6:]]],
                names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    id_type = _arrow(rows, "conv_id")
    ordered = rows.repartition("key").sortWithinPartitions("key", F.desc("there"), _by_turn(), "role", "text")
    return ordered.select("key", "conv_id", "there", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, {RESULT}")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Runs of rows of the long conversations, in order of (part, seg): symbols, rows and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg, held, before = TaskContext.get().partitionId(), 0, [], None

        def flush():
            nonlocal seg
            roles, texts = [r[2] for r in held], [r[3] for r in held]
            syms, (blank, duplicate, cut) = faults(roles, texts, [r[4] for r in held])
            seg += 1
            return pa.RecordBatch.from_pylist([dict(
                key=held[0][0], part=part, seg=seg, syms=bytes(syms), roles=roles, texts=texts, blank=blank, duplicate=duplicate,
                truncated=cut, illegal=illegal_pairs(roles), first=roles[0][:1], last=roles[-1][:1])], schema=schema)

        for batch in batches:
            for key, turn, role, text, late in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (held[0][0] != key or len(held) >= segment_rows):
                    yield flush()
                    held = []
                held.append((key, turn, role, text, late or before == (key, turn, role, text)))
                before = (key, turn, role, text)
        if held:
            yield flush()

    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seg", pa.int64()), ("syms", pa.binary()),
                        ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("blank", pa.int64()),
                        ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()),
                        ("last", pa.string())])
    digest = F.md5(F.col("text"))
    turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    rows = rows.where("there").withColumn("digest", digest)
    firsts = written(rows.groupBy("key", "role", "digest").agg(F.min(turn).alias("earliest")), "repair-firsts")
    rows = lookup(rows, firsts, ["key", "role", "digest"])
    order = ["key", _by_turn(), "role", "text"]
    rows = rows.select("key", "turn", "role", "text", (turn > F.col("earliest")).alias("late"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "key string, part int, seg long, syms binary, roles array<string>, texts array<string>, blank long,"
                                " duplicate long, truncated long, illegal long, first string, last string")


def _segment_maps(segments: DataFrame) -> DataFrame:
    """Every run's map from the vector behind to the vector before and the cost between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        n = len(t.vectors)
        for batch in batches:
            syms = [np.frombuffer(s, np.uint8).astype(np.int64) for s in batch.column("syms").to_pylist()]
            to, cost = [], []
            for s in syms:
                codes, blocks = t.codes(s, np.array([len(s)]))
                v, c = np.arange(n), np.zeros(n, np.int64)
                for code in codes[::-1]:
                    v, c = t.to[v, code], c + t.cost[v, code]
                to.append(v)
                cost.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), batch.column("seg"),
                                              pa.array(to, pa.list_(pa.int64())), pa.array(cost, pa.list_(pa.int64()))],
                                             names=["key", "part", "seg", "to", "cost"])

    return segments.select("key", "part", "seg", "syms").mapInArrow(
        run, "key string, part int, seg long, to array<long>, cost array<long>")


def _vectors_behind(maps: DataFrame) -> DataFrame:
    """(key, part, seg, behind, cost): the vector behind every run; cost of the conversation at its first run's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        last, vec, total = None, 0, 0
        for batch in batches:
            out = []
            for key, part, seg, to, cost in zip(*[c.to_pylist() for c in batch.columns]):
                if key != last:
                    last, vec, total = key, t.index[END], 0
                behind = vec
                vec, total = to[behind], total + cost[behind]
                out.append((key, part, seg, behind, total + t.vectors[vec][START]))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int32(), pa.int64(),
                                                                                  pa.int64(), pa.int64()])],
                                             names=["key", "part", "seg", "behind", "cost"])

    ordered = maps.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seg"))
    return ordered.mapInArrow(run, "key string, part int, seg long, behind long, cost long")


def _traced(segments: DataFrame) -> DataFrame:
    """Edits of every run for each of the four states before it, and the states behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        for batch in batches:
            edits, ends = [], []
            for syms, last in zip(batch.column("syms").to_pylist(), batch.column("behind").to_pylist()):
                s = np.frombuffer(syms, np.uint8).astype(np.int64)
                codes, blocks = t.codes(s, np.array([len(s)]))
                behind = t.behind(codes, blocks, np.array([last]))[0]
                pairs = list(zip(behind.tolist(), codes.tolist()))
                mine, end = [], []
                for q in range(4):
                    said = []
                    for v, c in pairs:
                        part, q = t.edits(v, c, q)
                        said.extend(e[0] + (e[1] or " ")[0] for e in part)
                    mine.append("".join(said))
                    end.append(q)
                edits.append(mine)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.list_(pa.string())),
                                              pa.array(ends, pa.list_(pa.int32()))], names=[*batch.schema.names, "edits", "ends"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema)
    return segments.mapInArrow(run, f"{fields}, edits array<string>, ends array<int>")


_GIVEN = {"u": "user", "a": "assistant", " ": None}


def _strung(traced: DataFrame) -> DataFrame:
    """One row per long conversation from its runs in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def result():
            last = Tables.closing(now["q"])
            now["digest"].add(repaired_lines(last, [], []))
            return pa.RecordBatch.from_pylist([dict(
                key=now["key"], blank=now["n"][0], duplicate=now["n"][1], truncated=now["n"][2], illegal=now["n"][3],
                cost=now["cost"], audit="".join(now["audit"] + [e[0] for e in last]), repaired_sha256=now["digest"].sha.hexdigest())],
                schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["key"] != r["key"]:
                    if now is not None:
                        yield result()
                    now = dict(key=r["key"], q=START, n=[0] * 4, cost=r["cost"], audit=[], digest=Digest(), last=None)
                for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    now["n"][i] += r[c]
                if now["last"] is not None:
                    now["n"][3] += now["last"] + r["first"] not in _LEGAL
                now["last"] = r["last"]
                said = r["edits"][now["q"]]
                edits = [(a, _GIVEN[b]) for a, b in zip(said[::2], said[1::2])]
                now["digest"].add(repaired_lines(edits, r["roles"], r["texts"]))
                now["audit"].append(said[::2])
                now["q"] = r["ends"][now["q"]]
        if now is not None:
            yield result()

    schema = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    ordered = traced.repartition("key").sortWithinPartitions("key", "part", "seg")
    return ordered.mapInArrow(run, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
                                   " repaired_sha256 string")


def _long(rows: DataFrame, segment_rows: int) -> DataFrame:
    segments = written(_segments(rows, segment_rows), "repair-segments")
    behind = _vectors_behind(_segment_maps(segments))
    strung = _strung(_traced(segments.join(behind, ["key", "part", "seg"])))
    live = F.when(F.col("there"), F.col("turn"))
    per_turn = rows.groupBy("key", "conv_id", live.alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    gaps = per_turn.groupBy("key", "conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    return gaps.join(strung, "key", "left").select(
        "conv_id", "gaps", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text and, if given, ``there``: false keeps the conversation
    in the result without the row)."""
    ship_package(rows.sparkSession)
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = rows.select(key.alias("key"), "conv_id", F.coalesce(there, F.lit(False)).alias("there"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    many = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long_rows).select("key"), "repair-long")
    short = _short(lookup(rows, many, ["key"], "left_anti"))
    if many.isEmpty():
        return short
    return short.unionByName(_long(lookup(rows, many, ["key"], "left_semi"), segment_rows))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the stated faults put in by crc32 of ``conv_id:turn``; ``there`` is false for dropped rows."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    part = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    what = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    c = c.withColumn("what", what)
    text = (F.when(F.col("what").isin(0, 1), F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    times = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    c = c.select("conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                 text.alias("text"), (F.col("what") != 0).alias("there"), F.explode(times).alias("copy"))
    return c.drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation after damage."""
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
