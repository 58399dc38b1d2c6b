import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from gapgrid.llm import exact_dedup, simhash
from gapgrid.llm.components import components

SCHEMA = "doc_id long, text string, kept string, cls long, component long, text_sha256 string"


def rows_of(pairs):
    return [(i, t, "x", 7, 7, "y") for i, t in pairs]


def test_exact_copies(spark):
    rng = random.Random(3)
    pairs = [(i, rng.choice(["hot", "hot", "a", "b ", "b", "", None, f"t{i}"])) for i in range(400)] + [(399, "hot"), (None, "hot"), (None, "only"), (None, "only"), (5, None)]
    df = spark.createDataFrame(rows_of(pairs), SCHEMA)
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    for support in (0.001, 0.05, 0.4):
        got = [tuple(r) for r in exact_dedup.exact_duplicates(df, support=support).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    assert sorted(got, key=repr) == sorted({(top, t) for t, ids in groups.items() for top in [max((i for i in ids if i is not None), default=None)]}, key=repr)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def brute_fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def brute_components(fp):
    """{id: smallest id reachable} for {id: fingerprint}."""
    low, left = {}, set(fp)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [j for j in left if (fp[i] ^ fp[j]).bit_count() <= 4]
        low |= dict.fromkeys(group, min(group))
    return low


def test_near_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))
    texts = ["", None, "  \n", "A", "a b", "A\tB\nc", "x" * 5000 + " y", "é ñ " * 20, " ".join(["again"] * 3000)]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(rows_of([*enumerate(texts), (3, "A"), (3, "A")]), SCHEMA)
    low = brute_components(fp)
    want = sorted([(i, f"{fp[i]:016x}", low[i]) for i in fp] + [(3, f"{fp[3]:016x}", low[3])] * 2)
    assert sorted(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted({r.doc_id for r in kept.collect()}) == sorted(set(low.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame(rows_of([(None, "q r s t u"), (None, "q r s t u"), (9, "q r s t u"), (None, "lone one")]), SCHEMA)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(null).collect()), key=repr) == sorted([(None, 9), (None, 9), (9, 9), (None, None)], key=repr)


def test_links_of_made_fingerprints(spark):
    """Chains and dense balls of fingerprints, links across every split of four bits over the blocks."""
    rng = random.Random(7)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            for k in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << k
    ball = rng.getrandbits(64)
    for _ in range(300):
        y = ball
        for k in rng.sample(range(64), 3):
            y ^= 1 << k
        fps.add(y)
    fp = dict(enumerate(sorted(fps)))
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fp.items()}
    one = spark.createDataFrame([(x, i) for i, x in signed.items()], "fp long, low long").repartition(5)
    first = {r.node: r.component for r in components(simhash.home_links(one)).collect()}
    cls = spark.createDataFrame([(x, first.get(x, x)) for x in signed.values()], "fp long, cls long")
    second = {r.node: r.component for r in components(simhash.class_links(cls)).collect()}
    group = defaultdict(set)
    for i, x in signed.items():
        c = first.get(x, x)
        group[second.get(c, c)].add(i)
    want = defaultdict(set)
    for i, c in brute_components(fp).items():
        want[c].add(i)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


def test_every_pair_within_four_bits_meets():
    rng = random.Random(2)
    pairs = []
    for _ in range(4000):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << k
        pairs.append((x, y))
    a = np.array(pairs, np.uint64).view(np.int64)
    home = [simhash.home_anchors(np.ascontiguousarray(a[:, k])) for k in (0, 1)]
    far = [simhash.other_anchors(np.ascontiguousarray(a[:, k])) for k in (0, 1)]
    for i in range(len(pairs)):
        h = [set(home[k][i].tolist()) for k in (0, 1)]
        every = [h[k] | set(far[k][i].tolist()) - {-1} for k in (0, 1)]
        assert h[0] & every[1] or h[1] & every[0]


def test_components_of_long_paths(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i % 100 != 99] + [(7, 7), (1, 0)], "a long, b long")
    got = defaultdict(set)
    for r in components(links).collect():
        got[r.component].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(0, 100)), list(range(100, 200)), list(range(200, 300))]
