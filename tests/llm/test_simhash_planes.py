import random
import re

import numpy as np
import xxhash

from tests.llm.helpers import docs, empty_docs, odd_docs, sentences
from tillscope.llm import simhash_planes as M


def brute_fp(t, k=4):
    t = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i: i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, radius):
    """Smallest index reachable by links, by brute force."""
    v = np.array(fps, np.uint64)
    label = np.arange(len(v))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    while True:
        new = np.array([label[near[i]].min() for i in range(len(v))])
        if (new == label).all():
            return label.tolist()
        label = new


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 12):
        b = rng.getrandbits(64)
        for _ in range(12):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_bit_slices_link_what_brute_force_links():
    for radius in (1, 3, 4):
        fps = np.array(clustered(300, radius), np.uint64)
        a, b = M.bit_sliced_links(fps, np.full(len(fps), len(fps)), radius)
        where = {int(x): i for i, x in enumerate(fps)}
        label = list(range(len(fps)))
        for x, y in zip(a, b):
            label[where[int(x)]] = where[int(y)]
        assert label == roots(fps, radius)


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    for n in (10, 10**6, 10**9):
        masks = M.bucket_masks(n, 4)
        for _ in range(200):
            x = y = rng.getrandbits(64)
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_links_with_cut_buckets(spark):
    from tillscope.llm.components import components

    fps = clustered(400, 9) + [i << 3 for i in range(200)]  # the second part is one dense bucket
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components(M.near_links(frame, len(fps), 4, bucket_rows=8)).collect()
    label = {r.node: r.root for r in found}
    want = roots(fps, 4)
    groups, expect = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(label.get(x, x), set()).add(i)
        expect.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_documents(spark):
    texts = sentences(40, seed=5, vocabulary=2000, least=0, most=60)
    texts += [t + " w1" for t in texts[:10]] + texts[:5] + [None, "", "  ", "One two", "one TWO"]
    got = {r.doc_id: r for r in M.near_components(docs(spark, texts)).collect()}
    fps = [brute_fp(t) for t in texts]
    want = roots(fps, 4)
    for i, f in enumerate(fps):
        assert got[i].fp % (1 << 64) == f and got[i].component_id == want[i]


def test_one_of_each_group_stays(spark):
    d = odd_docs(spark)
    kept = M.keep_one(d)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 1 twice -> once; 2, 3, 4 share the zero fingerprint -> 2; rows without id stay
    assert [i for none, i in ids if not none] == [1, 2, 5, 6, 7] and sum(none for none, _ in ids) == 2
    assert kept.columns == d.columns
    assert M.near_components(empty_docs(spark)).count() == 0 and M.keep_one(empty_docs(spark)).count() == 0
