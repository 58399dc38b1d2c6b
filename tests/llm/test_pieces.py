import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from gapgrid.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_made_texts_equal_the_library(library):
    model, rng = pieces.model_of(PATH), random.Random(1)
    letters = list("aeist rvmldnotc  '  \n\t1290.,!?-éñß中文字😀▁ 　’²\0ingth")
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(4000)] + ["".join(rng.choices(names, k=rng.randint(0, 20))) for _ in range(4000)]
    texts += [x * 20000 for x in ("ab", "a", " ", "x1", "▁", "中", "th", "  a", "😀")] + [" " * k + x for k in range(70) for x in ("", "a", "\n", "▁b")]
    for t in texts:
        ids = np.frombuffer(model.encode(t), np.int32)
        assert ids.tolist() == library.encode(t), t[:80]
        assert model.decode(ids) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(library):
    model, rng = pieces.model_of(PATH), random.Random(2)
    for _ in range(3000):
        ids = [rng.randint(0, 31999) if rng.random() < 0.6 else rng.randint(0, 258) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_blocks_and_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK", 7)
    monkeypatch.setattr(pieces, "CACHED_WORDS", 5)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 5)
    model, rng = pieces.PieceModel(PATH), random.Random(3)
    for _ in range(300):
        t = "".join(rng.choices(list("the of  in,.\n'"), k=rng.randint(0, 200)))
        assert np.frombuffer(model.encode(t), np.int32).tolist() == library.encode(t)


def test_rows(spark, library):
    texts = ["", None, " ", "<s> </s> <unk>", "word " * 50000, "a" * 70000, "tie", "tie", "▁x ▁", "é\n"]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)] + [(None, "n", 0, "k"), (6, "tie", 0, "k")], "doc_id long, text string, ids int, key string")
    rows = pieces.encode_documents(df, PATH).collect()
    want = sorted((repr(r.doc_id), library.encode(r.text or "") + [2]) for r in df.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in rows) == want
    assert [r.ids for r in pieces.encode_documents(df.where("doc_id = 0"), PATH, end=False).collect()] == [[]]
    back = pieces.decode_documents(pieces.encode_documents(df, PATH), PATH).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(r.doc_id), library.decode(library.encode(r.text or ""))) for r in df.collect())
    assert pieces.decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""
    assert pieces.encode_documents(df.limit(0), PATH).count() == 0 == pieces.decode_documents(df.limit(0).selectExpr("doc_id", "array(ids) AS ids"), PATH).count()


def test_query_equals_the_library(spark, library):
    from tests.conftest import SF_DIR

    got = {r.doc_id: r for r in queries.op13_sentencepiece(spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs:
        ids = library.encode(r.text or "") + [2]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
