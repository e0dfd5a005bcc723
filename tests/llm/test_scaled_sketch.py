import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import Tables, docs, empty_docs, odd_docs, sentences
from tillscope.llm import scaled_sketch as M


def query(spark, frame):
    return {r.doc_id: r for r in M.op9_scaled_sketch(Tables(spark, documents=frame), "t").collect()}


def edited(x, y):
    x, y = x or "", y or ""
    k = len(x) // 4
    return x[: len(x) - k] + y[:k]


def test_edits_and_likeness(spark):
    texts = sentences(50, seed=1, vocabulary=500, least=60, most=200) + [None, "é😀" * 50, "a b", ""]
    got = query(spark, docs(spark, texts, start=10))
    prints = {}
    for i, t in enumerate(texts):
        r = got[10 + i]
        e = edited(t, texts[(i + 1) % len(texts)])
        assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        prints.setdefault(e, set()).add(r.edited_fingerprint)
        prints.setdefault(t or "", set()).add(r.fingerprint)
        a, b = set(r.fingerprint.split(",")) - {""}, set(r.edited_fingerprint.split(",")) - {""}
        if r.fingerprint_exact == r.edited_fingerprint_exact and a and b:
            assert abs(r.near_edited - len(a & b) / min(len(a), len(b))) < 1e-12
        if i < 49:
            assert r.near_edited > 0.5 and r.near_next < 0.1
    assert all(len(p) == 1 for p in prints.values())


def test_successors_over_many_ranges(spark):
    frame = docs(spark, [f"text {i} " * 3 for i in range(300)], start=-100).repartition(5)
    got = query(spark, frame)
    base = frame.select("doc_id", "text", F.col("doc_id").alias("_key"))
    small = {r.doc_id: r["_next"].text for r in M.with_next(base, "_key", ["text"], F.lit(1), rows_per_range=7).collect()}
    for i in range(300):
        nxt = f"text {(i + 1) % 300} " * 3
        assert small[i - 100] == nxt
        assert got[i - 100].edited_sha256 == hashlib.sha256(edited(f"text {i} " * 3, nxt).encode()).hexdigest()


def test_fraction_merge_and_containment(spark):
    long = sentences(1, seed=3, vocabulary=5000, least=4000, most=4000)[0]
    part = " ".join(long.split()[1000:1400])
    d = spark.createDataFrame([(long, part, "q " + long)], "a string, b string, c string")
    for c in "abc":
        d = M.with_sketch(d, c, "s" + c)
    r = d.select(M.containment(F.col("sa"), F.col("sb")).alias("in_long"), F.size("sa").alias("n"),
                 (M.merge(F.col("sa"), F.col("sb")) == F.col("sa")).alias("same"), F.array_except("sb", "sa").alias("out")).first()
    assert r.in_long == 1.0 and r.same and r.out == [] and abs(r.n - 3996 / M.SCALE) < 4 * (3996 * 3 / 16) ** 0.5


def test_odd_rows(spark):
    d = odd_docs(spark)
    out = M.fingerprint_documents(d)
    rows = out.collect()
    assert len(rows) == d.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({tuple(r.sketch) for r in rows if r.text == "one two three"}) == 1
    assert M.fingerprint_documents(empty_docs(spark)).count() == 0
    only = M.fingerprint_documents(docs(spark, ["a b c d e f g h"])).collect()
    assert len(only) == 1 and only[0].edited == edited("a b c d e f g h", "a b c d e f g h")


def test_short_texts_have_fingerprints(spark):
    texts = [f"word{i // 2} of text" for i in range(40)] + [f"one two three four five six w{i // 2} eight" for i in range(40)]
    got = query(spark, docs(spark, texts))
    assert all(r.fingerprint for r in got.values()) and len({r.fingerprint for r in got.values()}) == len(set(texts))
    for i in range(0, 80, 2):
        assert got[i].near_next == 1.0 and got[i].fingerprint == got[i + 1].fingerprint
        assert (got[i].near_edited == 1.0) == (edited(texts[i], texts[i + 1]) == texts[i])
    assert len(got[79].fingerprint.split(",")) == 4


def test_the_fraction_thins_long_texts(spark):
    d = spark.createDataFrame([(sentences(1, seed=5, vocabulary=5000, least=900, most=900)[0],)], "t string")
    n = [d.select(F.size(M.sketch_of(M.word_hashes(F.col("t")), scale))).first()[0] for scale in (1, 2, 4)]
    assert n[0] == 896 and 350 < n[1] < 550 and 150 < n[2] < 300
    texts = sentences(30, seed=6, vocabulary=5000, least=200, most=400)
    for r in query(spark, docs(spark, texts)).values():
        assert len(r.fingerprint) < len(texts[r.doc_id]) and not r.fingerprint_exact


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_small_sets_are_exact_on_both_sides(spark):
    """A short text against a long one that holds it: the thinned sketch alone could say nothing."""
    texts, long = [], sentences(1, seed=7, vocabulary=5000, least=600, most=600)[0].split()
    for i in range(20):
        texts += [" ".join(long[30 * i % 500:30 * i % 500 + 5 + i % 9]), " ".join(long)]
    got = query(spark, docs(spark, texts))
    for i in range(0, 40, 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        assert got[i].fingerprint_exact and not got[i + 1].fingerprint_exact
        assert got[i].near_next == len(a & b) / min(len(a), len(b)) == 1.0
    for i in (0, 39):
        n = len(shingles(texts[i]))
        assert (len(got[i].fingerprint.split(",")) == n) == (n <= M.EXACT)
