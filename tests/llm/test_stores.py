import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gapgrid.llm import topk, warc


def test_archives(spark):
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(3000)).decode("latin-1")
    inner = gzip.compress(b"WARC/1.1\r\nno record").decode("latin-1")
    html = ["", None, "same", "same", noise, noise + inner, "é\r\n\r\nWARC/1.1", "x" * 400_000, "same", ""]
    rows = [(i, "http://a/ b\r\n" + "u" * (i * 9000 % 100_000), h, 5, "c") for i, h in enumerate(html)] + [(None, None, "same", 1, "c"), (None, "u", "alone", 1, "c"), (8, "z", "same", 1, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int, digest string").repartition(3)
    groups = {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    want = []
    for payload, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            to = None if i == top else top
            want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if to is None else "revisit", to))
    for split in (200, 5000, 1 << 20):
        out = warc.archive_round_trip(pages, split=split)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    small = warc.archive_round_trip(pages, least=5).where("record_type = 'revisit'").collect()
    assert {r.page_id for r in small} == set()
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def brute(rows, k):
    import math

    good = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        mine = min(good[q])
        s = sorted((-sum(a * b for a, b in zip(mine, c)), i) for i, vs in good.items() if i != q for c in vs)[:k]
        out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return out


def test_top_k(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(5)]) for i in range(400)]
    rows += [(i, rows[i - 400][1]) for i in range(400, 460)] + [(500, None), (520, [1.0, None, 1.0, 1.0, 1.0]), (540, [float("nan")] * 5), (560, [float("inf")] * 5), (None, [1.0] * 5), (3, rows[3][1]), (580, [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect())
    assert got == sorted(brute(rows, 7))
    few = df.where("vec_id < 5")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(few, F.col("vec_id") % 20 == 0, 7).collect()) == sorted(brute([r for r in rows if r[0] is not None and r[0] < 5], 7))
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0


def test_top_k_ties_and_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = random.Random(8)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(150)] + [(150 + i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, is_query boolean")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 9).collect())
    assert got == sorted(brute(rows, 9))
    wide = [(i, [(1 << 22) + rng.random(), float(rng.randrange(1 << 22)), rng.random()]) for i in range(60)]  # products beyond 2^53
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 9).collect())
    assert got == sorted(brute(wide, 9))
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.lit(True))
