import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.helpers import DOCS, Tables, empty_docs  # noqa: E402
from tests.llm.test_fm_decontam import brute  # noqa: E402
from tests.llm.test_simhash_planes import brute_fp, roots  # noqa: E402
from tillscope.llm.common import written  # noqa: E402

JUNK = 10 ** 9
SF = "/root/testdata/sf0.001"


def test_every_stage_on_generated_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(JUNK, "xqzt vvkrp zzzq 12 %% kkjq", None, "junk", 26)], docs.schema)
    docs = docs.unionByName(junk)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), "test-stage")
        after = docs.collect()
        seen[name] = len(after)
        if name == "language_id":  # the generated documents are all in a known language, the added one is in none
            assert len(after) == len(before) - 1 and all(r.doc_id != JUNK for r in after)
        if name == "simhash_near_dedup":
            order = sorted(before, key=lambda r: r.doc_id)
            label = roots([brute_fp(r.text) for r in order], 4)
            assert {r.doc_id for r in after} == {order[i].doc_id for i in set(label)} and len(after) == len(set(label))
        if name == "benchmark_decontamination":
            left = {r.doc_id: r for r in after}
            for r in before:
                n, hit, _ = brute(r.text, bench, 10)
                if hit == 0:
                    assert left[r.doc_id] == r
                elif hit < n:
                    assert len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", left[r.doc_id].text.lower())) == n - hit
        if name == "source_mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and docs.columns == columns
        if name == "sharding":
            n = np.bincount([r.shard for r in after], minlength=40)
            assert len(after) == len(before) and n.max() - n.min() <= 1
    assert seen["language_id"] > seen["simhash_near_dedup"]


def test_run_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    odd = spark.createDataFrame([(1, "der die das und nicht", "de", "s", 5, None, None, None), (2, None, None, None, None, None, None, None),
                                 (3, "the of and with that", "en", None, 5, None, None, None), (4, "1234", "en", "s", 4, None, None, None),
                                 (5, "the of and with that", "en", None, 5, None, None, None)], DOCS)
    for documents in (odd, empty_docs(spark)):
        got = corpus_pipeline.run(Tables(spark, documents=documents, benchmark=bench), "t").collect()
        assert {r.doc_id for r in got} <= {1, 3}


def test_registered_queries():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
