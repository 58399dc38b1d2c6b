import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from gapgrid.llm import langid, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_spliced_counts():
    tok, rng = token_counts.tokens_of(MODEL), random.Random(2)
    letters = list("aeist rvmld '  \n\t1290.,!?-éñß中文字😀▁ 　’²")
    for i in range(150):
        s = "".join(rng.choices(letters, k=rng.randint(0, 3000)))
        if i % 10 == 0:
            s = rng.choice(["ab", "a", " ", "x1", "▁", "中"]) * rng.randint(1, 2000)
        assert token_counts.count_tokens(tok, s, chunk=200, overlap=16) == len(tok.whole.encode(s))


def test_the_pair_that_meets_is_checked():
    tok, rng = token_counts.tokens_of(MODEL), random.Random(5)
    parts = ["e", "ing", "inge", "s", "ed", " the", "er", "in", "g", " "]
    for chunk, overlap, n, size in ((40, 4, 1500, 300), (4096, 4, 8, 40_000)):
        for _ in range(n):
            s = "".join(rng.choices(parts[:3] if rng.random() < 0.5 else parts, k=rng.randint(size // 6, size // 2)))
            assert token_counts.count_tokens(tok, s, chunk=chunk, overlap=overlap) == len(tok.whole.encode(s))


def test_count_rows(spark):
    texts = ["", None, " ", "<s> </s> <unk>", "word " * 20000, "中" * 40000, "a" * 70000, "tie", "tie", "▁x ▁"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "n", 0)], "doc_id long, text string, n_tokens int")
    tok = token_counts.tokens_of(MODEL)
    got = {r.doc_id: r for r in token_counts.token_counts(df, MODEL).collect()}
    for i, t in [*enumerate(texts), (None, "n")]:
        n = len(tok.whole.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.token_counts(df.limit(0), MODEL).count() == 0


def phrases(text, reference):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in reference:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    refs = {k: "".join(rng.choices(a, k=400)).encode() for k, a in (("one", "ab c"), ("two", "bcd é"))}
    parser = langid.Parser(refs)
    texts = [b"", b"zzz", *("".join(rng.choices("abcdxé  .Z", k=rng.randint(1, 1500))).encode() for _ in range(30))]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, size = parser.parse(np.frombuffer(b"".join(texts), np.uint8), off)
    plain = lambda x: bytes(parser.squeeze(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0])
    for k, name in enumerate(parser.names):
        ref = plain(refs[name])
        for i, t in enumerate(texts):
            code, a, b = parser.squeeze(np.frombuffer(b"".join(texts), np.uint8), off)[0], *parser.squeeze(np.frombuffer(b"".join(texts), np.uint8), off)[1][i:i + 2]
            mine = bytes(code[a:b])
            assert size[i] == len(mine)
            assert got[i, k] == sum(phrases(mine[j:j + langid.WINDOW], ref) for j in range(0, len(mine), langid.WINDOW))


def test_language_rows(spark):
    from tests.conftest import SF_DIR

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    out = langid.identify(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r.doc_id: r for r in out.collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    test = [i for i in truth if held(i)]
    assert len(got) == len(truth) and np.mean([got[i].lang_pred == truth[i] for i in test]) > 0.93
    assert all(0 <= r.score <= 1 for r in got.values())
    # what is told of a row does not change what is predicted for it
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2, F.col("lang")).otherwise("xx"))
    again = {r.doc_id: r.lang_pred for r in langid.identify(other, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).collect()}
    assert again == {i: r.lang_pred for i, r in got.items()}


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "hello world", "en", 1), (2, None, "en", 1), (3, "123 !!", "en", 1), (4, "", None, 1), (None, "hello", None, 1), (5, "中文", "zh", 1), (1, "hello world", "en", 1)],
                               "doc_id long, text string, lang string, score int")
    got = sorted((repr(r.doc_id), r.lang_pred) for r in langid.identify(df, F.lit(True)).collect())
    assert got == sorted([("1", "en"), ("1", "en"), ("2", "und"), ("3", "und"), ("4", "und"), ("None", "en"), ("5", "zh")])
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0
