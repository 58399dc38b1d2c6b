import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from gapgrid.llm import exact_dedup, mixture, similar, training_order
from gapgrid.llm.files import shared_folder

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_permutation():
    for n in (0, 1, 2, 3, 17, 1000, 4097):
        p = training_order.Permutation(n, 5)
        slots = p.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.sequence(slots) == np.arange(n)).all()
    a, b = (training_order.Permutation(1000, k).slot(np.arange(1000)) for k in (1, 2))
    assert (a != b).any() and (a != np.arange(1000)).mean() > 0.9


def test_every_id_has_one_place(spark):
    texts = ["", None, "a", "some words, and more of them " * 30, "é中😀" * 50, "last"]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "a", "x", 0), (2, "a", "x", 0)], "doc_id long, text string, part string, start int").repartition(3).cache()
    layout = training_order.Layout(length=16, shard=5)
    folder = shared_folder(spark, "t")
    out = {r.slot: r for r in training_order.training_order(df, PATH, layout, 9, folder).collect()}
    n = len(out)
    assert sorted(out) == list(range(n)) and len({r.sequence for r in out.values()}) == n
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    manifest = training_order.write_shards(df, PATH, shared_folder(spark, "t"), layout, 9)
    sizes = {r.shard: (r.first_slot, r.n_sequences) for r in manifest.collect()}
    assert all(r.byte_offset == (r.slot - sizes[r.shard][0]) * 32 and sizes[r.shard][1] <= 5 for r in out.values())
    # slots are ranks by the permuted number
    perm = training_order.Permutation(int(training_order.part_bounds(df, layout)[-1]), 9)
    keys = perm.slot(np.array([out[t].sequence for t in range(n)]))
    assert (np.diff(keys) > 0).all()
    back = {r.slot: bytes(r.ids) for r in training_order.read_slots(manifest, layout).collect()}
    order = sorted(range(n), key=lambda t: out[t].sequence)
    flat = np.concatenate([np.frombuffer(back[t], "<u2") for t in order])
    assert sum(x == layout.pad for x in flat) < 3 * 16  # three splits
    flat = flat[flat != layout.pad].tolist()
    docs, now = [], []
    for x in flat:
        if x == layout.end:
            docs.append(enc.decode_bytes(now).decode())
            now = []
        else:
            now.append(x)
    assert not now and sorted(docs) == sorted([t for t in texts if t] + ["a", "a"])
    some = {r.slot: bytes(r.ids) for r in training_order.read_slots(manifest, layout, 3, 12).collect()}
    assert some == {k: v for k, v in back.items() if 3 <= k < 12}
    assert all(hashlib.sha256(v).hexdigest() == out[k].ids_sha256 for k, v in back.items())
    assert training_order.training_order(df.limit(0), PATH, layout).count() == 0


def fill(children, budget):
    """{name: share} by repeatedly capping the children that can't take their share."""
    out, left = {}, dict(children)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if c < level * w}
        if not full:
            return out | {k: min(c, int(level * w)) for k, (w, c) in left.items()}
        for k, c in full.items():
            out[k] = c
            budget -= c
            left.pop(k)
    return out


def test_shortages_stay_among_siblings(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "a", 5), ("d1", "en", "a", 40), ("d1", "fr", "c", 0), ("d2", "xx", "q", 3)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"d0": 2}, "lang": {"de": 3}, "source": {"a": 5}}
    for percent in (10, 50, 90, 300):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixture.leaf_budgets(df, percent, 2, weights).collect()}
        w = lambda level, name: weights[level].get(name, 1)
        total = sum(x[3] for x in leaves) * percent // 100
        want = {}
        tops = {d: (w("domain", d), sum(2 * x[3] for x in leaves if x[0] == d)) for d in {x[0] for x in leaves}}
        for d, b in fill(tops, total).items():
            mids = {lang: (w("lang", lang), sum(2 * x[3] for x in leaves if x[:2] == (d, lang))) for lang in {x[1] for x in leaves if x[0] == d}}
            for lang, b2 in fill(mids, b).items():
                ends = {x[2]: (w("source", x[2]), 2 * x[3]) for x in leaves if x[:2] == (d, lang)}
                want |= {(d, lang, s): b3 for s, b3 in fill(ends, b2).items()}
        assert got == want, percent


def test_mixture_rows(spark):
    rows = [(i, ["en", "de", None][i % 3], f"s{i % 4}", "x" * (i * 7 % 50), "clash", 3) for i in range(300)] + [(None, None, None, None, "c", 1), (7, "en", "s1", "zz", "c", 1), (7, "en", "s1", "zz", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, domain string, tokens int")
    out = mixture.mixture(df, {}, 60, 3, 1)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 4 for r in got)
    total = sum(r.tokens for r in got)
    assert 0.5 * total < sum(r.tokens * r.copies for r in got) <= 0.6 * total
    mixed = mixture.mixed_documents(df, {}, 60, 3, 1)
    assert mixed.columns == df.columns and mixed.count() >= sum(r.copies for r in got if r.doc_id not in (7, None))
    assert mixture.mixture(df.limit(0), {}).count() == 0 and mixture.mixed_documents(df.limit(0), {}, 50, 2, 1).count() == 0
    again = mixture.mixture(df.repartition(7), {}, 60, 3, 1)
    assert sorted(map(repr, again.select(*sorted(out.columns)).collect())) == sorted(map(repr, out.select(*sorted(out.columns)).collect()))
    assert out.where(F.col("tokens") > 0).groupBy("domain", "lang", "source").agg((F.max("copies") - F.min("copies")).alias("d")).where("d > 1").count() == 0


def test_rows_of_one_id_have_decisions_of_their_own(spark):
    rows = [(1, "en", "s", "x" * 8), *((1, "en", "s", "y" * 400 + str(i)) for i in range(20)), *((None, "en", "s", f"null {i} " * 20) for i in range(50))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    for percent in (20, 60, 150):
        mixed = [r.text for r in mixture.mixed_documents(df, {}, percent, 3, 1).collect()]
        total = sum(-(-len(r[3]) // 4) for r in rows)
        got = sum(-(-len(t) // 4) for t in mixed)
        assert total * percent / 100 - 150 < got <= total * percent / 100
    assert {t.startswith("null") for t in mixed} == {True, False}


def test_clashing_names(spark):
    names = ["__n", "__id", "__sha", "__digest", "__copies", "row_number", "copies", "copy_number", "kept_id", "kept_sha", "kept_rows", "own_sha", "own_digest", "kept_digest", "id", "salt"]
    rows = [(i, "en", "s", t, *(f"{n}{i}" for n in names)) for i, t in enumerate(["a b c d e f", "A b c d e f", "a b c d e f", "other words"])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, " + ", ".join(f"`{n}` string" for n in names))
    for stage, ids in ((exact_dedup.drop_copies, [1, 2, 3]), (similar.drop_similar, [0, 3]), (lambda d: mixture.mixed_documents(d, {}, 100, 1, 1), [0, 1, 2, 3])):
        out = stage(df)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[i] for i in ids]
