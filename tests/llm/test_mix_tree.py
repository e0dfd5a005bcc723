import re

import numpy as np

from tests.llm.helpers import docs, empty_docs, odd_docs, sentences
from tillscope.llm import mix_tree as M


def n_words(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def test_targets_by_hand():
    # weights 5, 2, 1 share 1.5 * 300; the first stops at 200, 250 left for 2 : 1, the second stops at 166.7 < 200
    assert M.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]
    assert M.targets([]) == [] and M.targets([0, 10]) == [0.0, 15.0]
    got = M.targets([10, 1000, 7, 30, 5])
    assert abs(sum(got) - 1.5 * 1052) < 1e-6 and all(t <= 2 * n + 1e-9 for t, n in zip(got, [10, 1000, 7, 30, 5]))


def test_splitting_tree_is_exact():
    quotas = [100, 7, 0, 33]
    q = M.split_quotas(quotas, 6, seed=3)
    assert q.sum(0).tolist() == quotas and np.ptp(q.sum(1)) <= 1 and (q >= 0).all()
    assert (q == M.split_quotas(quotas, 6, seed=3)).all() and M.split_quotas([0], 3, 1).sum() == 0


def corpus(spark):
    a, b = sentences(60, seed=1, most=80), sentences(50, seed=2, most=200)
    out = docs(spark, a, "a").unionByName(docs(spark, b, "b", start=100)).unionByName(docs(spark, ["z " * 700, "q"], None, start=300))
    return out.unionByName(docs(spark, [None, "", " "], "c", start=400)).unionByName(docs(spark, sentences(40, seed=4), "d", start=500))


def test_taken_words(spark):
    d = corpus(spark)
    texts = {r.doc_id: r for r in d.collect()}
    rows = M.taken_words(M.placed(d)).collect()
    assert len(rows) == len(texts)
    size, taken, goal = {}, {}, {}
    for r in rows:
        assert r.size == n_words(texts[r._id].text) and 0 <= r.taken <= 2 * r.size
        for x, v in ((size, r.size), (taken, r.taken)):
            x[r._source] = x.get(r._source, 0) + v
        goal[r._source] = r.target
    order = ["a", "b", "c", "d", None]
    assert [goal[s] for s in order] == M.targets([size[s] for s in order])
    for r in rows:
        assert r.source_size == size[r._source]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(2, 0.02 * goal[s])
    again = {r._id: r.taken for r in M.taken_words(M.placed(d.repartition(7))).collect()}
    assert again == {r._id: r.taken for r in rows}


def test_the_tree_decides_shards_and_not_totals(spark):
    d = corpus(spark)
    by_seed = []
    for tree_seed in (1, 2):
        at = M.placed(d, n_shards=6, tree_seed=tree_seed).persist()
        rows = M.taken_words(at).collect()
        assert all(r.taken == sum(s.words for s in r.shards) and all(s.words > 0 for s in r.shards) for r in rows)
        by_seed.append({r._id: (r.taken, [(s.shard, s.words) for s in r.shards]) for r in rows})
        # a shard's words of a source are its share of the quota in blocks, but for blocks that end short
        plan = {r._source: r for r in at.select("_source", "firsts", "block", "n_blocks", "source_size").distinct().collect()}
        words = {}
        for r in rows:
            for s in r.shards:
                words[r._source, s.shard] = words.get((r._source, s.shard), 0) + s.words
        for source, p in plan.items():
            for s in range(6):
                draws = p.firsts[s + 1] - p.firsts[s]
                short = p.block * p.n_blocks - p.source_size   # the last block of the stream
                assert 0 <= draws * p.block - words.get((source, s), 0) <= 2 * short
    assert {i: t for i, (t, _) in by_seed[0].items()} == {i: t for i, (t, _) in by_seed[1].items()}
    assert by_seed[0] != by_seed[1]


def test_blocks_lie_in_their_own_shards(spark):
    d = corpus(spark)
    want = {}
    for r in M.taken_words(M.placed(d, n_shards=6)).collect():
        for s in r.shards:
            want[r._id, s.shard] = s.words
    got = {}
    for r in M.mixed_documents(d, n_shards=6, shard="shard").collect():
        got[r.doc_id, r.shard] = got.get((r.doc_id, r.shard), 0) + n_words(r.text)
    assert got == want


def test_documents_of_the_mixture_hold_the_taken_words(spark):
    d = corpus(spark)
    taken = {r._id: r.taken for r in M.taken_words(M.placed(d)).collect()}
    got, originals = {}, {r.doc_id: r.text for r in d.collect()}
    mixed = M.mixed_documents(d)
    assert mixed.columns == d.columns
    for r in mixed.collect():
        n = n_words(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        assert r.n_chars == len(r.text) and (r.text == originals[r.doc_id] or n < n_words(originals[r.doc_id]))
    assert got == {i: n for i, n in taken.items() if n}


def test_odd_rows(spark):
    d = odd_docs(spark)
    rows = M.taken_words(M.placed(d)).collect()
    assert len(rows) == d.count() and sum(r.taken for r in rows if r._id == 1) > 0
    mixed = M.mixed_documents(d).collect()
    assert sum(n_words(r.text) for r in mixed) == sum(r.taken for r in rows)
    assert M.placed(empty_docs(spark)).count() == 0 and M.mixed_documents(empty_docs(spark)).count() == 0
