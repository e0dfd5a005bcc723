import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tests.llm.helpers import Tables as Session
from tillscope.llm.turn_repair import END, LONG_ROWS, Tables, op12_turn_repair, repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, key string, there string, cost string"


def brute(rows):
    """Cheapest edits by trying them all: rows in order as (turn, role, text)."""
    seen, kinds = set(), []
    counts = [0, 0, 0]
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        kind = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
        seen.add((role, text))
        if kind is not None:
            counts[kind] += 1
        kinds.append(kind)
    ok = re.compile(r"(s?(ua)+)?")

    def fits(initials):   # may still become a whole pattern
        return any(ok.fullmatch(initials + more) for more in ("", "a", "ua"))

    @lru_cache(None)
    def best(i, initials):
        options = []
        if i == len(rows) and ok.fullmatch(initials):
            options.append((0, "", ()))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, initials)
            options.append((c + 3, "D" + a, r))
            if kinds[i] not in (0, 1):
                t = int(kinds[i] == 2)
                if role[:1] and fits(initials + role[:1]):
                    c, a, r = best(i + 1, initials + role[:1])
                    options.append((c + t, "K" + a, (f"{role}:{text}", *r)))
                for name in ("user", "assistant"):
                    if fits(initials + name[0]):
                        c, a, r = best(i + 1, initials + name[0])
                        options.append((c + 2 + t, "R" + a, (f"{name}:{text}", *r)))
        for name in ("user", "assistant"):
            if fits(initials + name[0]) and len(initials) < 2 * len(rows) + 2:
                c, a, r = best(i, initials + name[0])
                options.append((c + 2, "I" + a, (f"{name}:", *r)))
        return min(options, key=lambda o: (o[0], o[1])) if options else (10 ** 9, "", ())

    cost, audit, lines = best(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def conversation(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "u"]
    texts = ["Yes.", "No!", "cut", "", " \t", "long words end.", "why?"]
    return [(rng.choice([i, i, None]), rng.choice(roles), rng.choice(texts)) for i in range(n)]


def test_blocks_against_brute_force():
    rng = random.Random(5)
    cases = [conversation(rng, rng.randint(0, 6)) for _ in range(400)]
    got = repair([([r[0] for r in c], [r[1] for r in c], [r[2] for r in c]) for c in cases])
    for c, g in zip(cases, got):
        assert g == brute(tuple(c)), c


def test_block_length_does_not_matter():
    rng = random.Random(6)
    cases = [([r[0] for r in c], [r[1] for r in c], [r[2] for r in c]) for c in (conversation(rng, rng.randint(0, 60)) for _ in range(60))]
    assert repair(cases, 1) == repair(cases, 3) == repair(cases, 4)
    t = Tables(2)
    assert t.vectors[0] == END and len(t.vectors) < 100


@pytest.mark.parametrize("long_rows,segment_rows", [(LONG_ROWS, 512), (3, 2), (0, 5)])
def test_long_conversations_give_the_same(spark, long_rows, segment_rows):
    rng = random.Random(7)
    rows = [(c, t, r, x, "k", "t", "c") for c in [1, 2, 3, None] for t, r, x in conversation(rng, rng.choice([2, 9, 40]))]
    rows += [(9, i, rng.choice(["user", "assistant"]), f"Line {i % 50}.", "", "", "") for i in range(400)]
    got = repair_conversations(spark.createDataFrame(rows, SCHEMA).drop("there"), long_rows, segment_rows).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    for r in got:
        mine = sorted([(t, a, x) for c, t, a, x, *_ in rows if c == r["conv_id"]], key=order)
        assert tuple(r)[1:] == repair([tuple(map(list, zip(*mine)))])[0], r["conv_id"]
    assert len(got) == 5


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op12_turn_repair(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == brute(tuple(damage([r for r in rows if r[0] == c]))), c


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, 0, None, "x."), (1, 0, None, "x."),
            (2, 5, "user", "a. " * 50_000), (2, 7, "assistant", "b"), (3, 1, "", ""), (4, 2, "user", "é 😀?")]
    rows += [(c, 0, "user", "gone?") for c in range(100, 160)]   # some conversations lose their only row
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in op12_turn_repair(Session(spark, conversations=df), "x").collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == brute(tuple(damage([r for r in rows if r[0] == c]))), c
    assert any(g == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for g in got.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert op12_turn_repair(Session(spark, conversations=empty), "x").count() == 0
