import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tests.llm.helpers import Tables, docs, empty_docs, odd_docs
from tillscope.llm.piece_codec import PieceModel, encode_documents, model_bytes, op13_piece_codec


@pytest.fixture(scope="module")
def model():
    data = model_bytes()
    return PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def _same(model, texts):
    mine, library = model
    ids = mine.encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == want
    assert mine.decode(ids) == [library.decode(w) for w in want]


def test_equals_the_library_on_mixed_characters(model):
    rng = random.Random(3)
    bits = ["a", "b", "ab", " ", "  ", "▁", "é", "日", "本", "😀", "\n", "\t", "\x00", "0", "the ", "ing", "<s>", "<0x0A>",
            "<unk>", "​", "=", "--", " " * 17, "aaaa"]
    _same(model, ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(3000)])
    _same(model, ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(12))
                  for _ in range(500)])


def test_runs_and_long_words(model):
    _same(model, ["", " "] + [" " * n for n in range(40)] + ["a" * n for n in range(60)] + ["=-" * n for n in range(40)])
    _same(model, [" " * 50_000, "ab" * 50_000, "x y " * 20_000, "日本" * 5_000])


def test_known_words_are_bounded_and_do_not_change_results(model, monkeypatch):
    monkeypatch.setattr("tillscope.llm.piece_codec.MEMORY_BYTES", 200)
    for i in range(5):
        _same(model, [f"word{i} again {'z' * 100} word{i}", "again and again"])
    assert all(len(w) <= 64 for w in model[0].known)


def test_decodes_any_ids_like_the_library(model):
    mine, library = model
    rng = random.Random(4)
    rows = [[rng.choice([rng.randint(3, 258), rng.randint(0, 31999), rng.choice([0, 1, 2, 28705, 259])])
             for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    assert mine.decode([np.array(r, "<u4").tobytes() for r in rows]) == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        mine.decode([np.array([32000], "<u4").tobytes()])


def _want(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_query_on_the_whole_table(spark, model):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op13_piece_codec(spark, sf).collect())
    assert got == sorted((r["doc_id"], *_want(model[1], r["text"])) for r in rows)


def test_odd_rows_and_empty_table(spark, model):
    t = odd_docs(spark)
    got = op13_piece_codec(Tables(spark, documents=t), "x")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(r["doc_id"], *_want(model[1], r["text"])) for r in t.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert op13_piece_codec(Tables(spark, documents=empty_docs(spark)), "x").count() == 0


def test_operator_keeps_real_ids(spark, model):
    out = encode_documents(docs(spark, ["Hello world", None]), model_bytes()).orderBy("doc_id").collect()
    assert np.frombuffer(out[0]["ids"], "<u4").tolist() == model[1].encode("Hello world", add_bos=True, add_eos=True)
    assert out[0]["decoded"] == "Hello world" and out[1]["n_tokens"] == 2 and out[1]["decoded"] == ""
