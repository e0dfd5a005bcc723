import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import Tables, docs, empty_docs, odd_docs, sentences
from tillscope.llm import fm_decontam as M


def words(t):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - window + 1)) if v else []:
            p = v[i: i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j: j + len(p)] == p:
                    hit.update(range(j, j + len(p)))
                    if item is not None:
                        found.add(item)
    return len(w), len(hit), sorted(found)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_index_counts_and_places():
    rng = random.Random(1)
    for _ in range(30):
        seq = np.array([rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(1, 120))] + [0])
        index = M.FMIndex(seq, 3, sample=5)
        for n in (1, 2, 3):
            phrases = np.array([[rng.randint(1, 3) for _ in range(n)] for _ in range(8)])
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                at = sorted(i for i in range(len(seq) - n + 1) if (seq[i: i + n] == p).all())
                assert sorted(index.locate(np.arange(a, b)).tolist()) == at


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_against_brute_force(spark, block_bytes):
    texts = sentences(60, seed=2, vocabulary=6) + [None, "", "W1, w2; W3!", "w1-w2 w3"]
    items = [(10, "w1 w2 w3"), (2, "W1 W2 w0 w0 w4 w5"), (3, None), (4, "?!"), (5, "w9"), (5, "w5 w5"), (None, "w4 w4"), (6, "w0 w1 w2 w3 w4 w5 w0 w1")]
    got = M.find_benchmark(docs(spark, texts), bench(spark, items), window=4, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = brute(texts[r.doc_id], items, 4)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert sum(s.end - s.start for s in r.spans) == hit


def test_query_digest(spark):
    items = [(10, "a b c d e f g h i j k"), (9, "x y")]
    t = Tables(spark, documents=docs(spark, ["x y a b c d e f g h i j z", "clean text", None]), benchmark=bench(spark, items))
    got = {r.doc_id: r for r in M.op1_fm_decontamination(t, "t").collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (13, 12, 2, True)
    assert got[0].items_sha256 == hashlib.sha256(b"10,9").hexdigest()
    assert (got[1].n_hit, got[1].contaminated, got[2].n_words) == (0, False, 0)
    assert got[1].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_removal_keeps_clean_rows_and_columns(spark):
    d = docs(spark, ["Keep this. One TWO three four! And this.", "all clean", "one two three four", None])
    got = {r.doc_id: r for r in M.remove_benchmark(d, bench(spark, [(1, "one two three four")])).collect()}
    assert sorted(got) == [0, 1, 3] and got[0].text == "Keep this. ! And this." and got[0].n_chars == len(got[0].text)
    assert got[1].text == "all clean" and got[1].spans == "y" and got[3].text is None


def test_odd_rows(spark):
    b = bench(spark, [(1, "one two three"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")])
    d = odd_docs(spark)
    got = M.find_benchmark(d, b).collect()
    assert len(got) == d.count() and sum(r.n_hit == 3 for r in got) == 4
    assert M.find_benchmark(empty_docs(spark), b).count() == 0
    assert all(r.n_hit == 0 for r in M.find_benchmark(d, b.limit(0)).collect())
    assert M.remove_benchmark(d, b).columns == d.columns
