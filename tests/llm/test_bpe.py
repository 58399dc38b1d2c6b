import base64
import gc
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from gapgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", "'", "'s", " 's", "'ll", "'lla", "''s", "a'", "  ", "\n", " \n ", "a" * 5000, "ab" * 3000, " " * 3000, "x\x00y", "é中😀", "　’²", "<|endoftext|>"]


def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library():
    assert bpe.PATTERN == public_tokenizers.PATTERN
    rng = random.Random(1)
    letters = list("aeist'rvmld '  \n\t\r1290.,!?-éñß中文字😀 　’²")
    texts = EDGE + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(rng.choices("etaoin", k=20000))]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    enc, ranks, n_seen = encoding(), bpe.ranks_of(PATH), 0
    for i, j, ids, n in bpe.encode_batches(PATH, data, off):
        for k, mine in zip(range(i, j), np.split(ids, np.cumsum(n)[:-1])):
            assert mine.tolist() == enc.encode_ordinary(texts[k]), texts[k][:50]
            n_seen += 1
        back, end = ranks.decode(ids, n)
        assert back.tobytes() == data[off[i]:off[j]].tobytes() and (end == off[i:j + 1] - off[i]).all()
    assert n_seen == len(texts)


def test_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(EDGE)] + [(None, None, None, None), (0, "", "x", 1), (0, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, key int")
    enc = encoding()
    want = sorted((repr(r[0]), len(e := enc.encode_ordinary(r[1] or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, PATH).collect())
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r[1] or "").encode() for r in rows)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_batches_leave_no_views_behind(spark, monkeypatch):
    """A worker runs many tasks: what a batch was encoded to must go with it."""
    kept = []
    whole = bpe.map_batches
    monkeypatch.setattr(bpe, "map_batches", lambda df, run, schema: kept.append(run) or whole(df, run, schema))
    bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([b"word %d" % k for k in range(499)] + [b""])], ["key", "text"])
    views = lambda: sum(isinstance(x, memoryview) for x in gc.get_objects())
    before = views()
    out = pa.Table.from_batches(list(kept[0](iter([batch, batch]))))
    assert out.num_rows == 1000 and out["ids"][999].as_py() == b""
    lone = bpe.ranks_of(PATH).encode(np.frombuffer(b"word 7", np.uint8), np.array([0, 6]))[0]
    assert out["ids"][507].as_py() == lone.astype("<u4").tobytes()
    assert out["decoded_sha256"][507].as_py() == hashlib.sha256(b"word 7").hexdigest()
    assert views() - before < 10
