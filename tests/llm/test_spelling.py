import random
import re
import zlib
from collections import Counter

import numpy as np

from gapgrid.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return a[p + 1:] == b[p + 1:]
    a, b = sorted((a, b), key=len)
    return a[p:] == b[p + 1:]


def brute(rows, least_letters=7, least=2, factor=10):
    n = Counter()
    for key, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_letters and k >= least}
    near, form = {}, {}
    for w in n:
        near[w] = [v for v in n if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def found(df, **kw):
    return {tuple(r) for r in spelling.spelling_groups(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_near_words_of_made_vocabularies():
    rng = random.Random(3)
    for letters, size in (("ab", 300), ("abcé", 400), ("a", 20)):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(2, 11))) for _ in range(size)})
        n = np.array([rng.randint(1, 9) for _ in words])
        want = {w: [v for v in words if one_edit(w, v)] for w in words}
        got = {w: (0, None) for w in words}
        for left in (True, False):
            rows = [(i, k) for i, w in enumerate(words) for k in {(m // 2 if left else m - m // 2) for m in (len(w) - 1, len(w), len(w) + 1)}]
            at = np.array([i for i, _ in rows])
            q, m, best = spelling.search([words[i] for i in at], n[at], np.array([k for _, k in rows]), words, left)
            for i, k, b in zip(q, m, best):
                c, old = got[words[i]]
                new = words[at[b]]
                got[words[i]] = (c + k, min([x for x in (old, new) if x], key=lambda x: (-n[words.index(x)], x)))
        for w in words:
            assert got[w] == (len(want[w]), min(want[w], key=lambda x: (-n[words.index(x)], x), default=None)), w


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdeéÀ", k=rng.randint(6, 12))) for _ in range(60)]

    def variant(w):
        k, c = rng.randrange(len(w)), rng.choice("abcdeéÀ")
        return rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])

    rows = []
    for i in range(400):
        words = [w if rng.random() < 0.8 else variant(w if rng.random() < 0.8 else variant(w)) for w in rng.choices(base, range(1, 61), k=40)]
        rows.append((i % 390, rng.choice([" ", "-", "1×\n"]).join(x.upper() if rng.random() < 0.2 else x for x in words)))
    rows += [(None, "Abcdefgh abcdefgh"), (7, None), (8, ""), (9, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + " " + "z" * 2999)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    want = brute(rows)
    assert found(df) == want and any(r[1] for r in want) and any(r[1] != r[2] != r[0] for r in want if r[1])
    # halves that are dealt to many small indexes
    monkeypatch.setattr(spelling, "HOT", 5)
    monkeypatch.setattr(spelling, "SHARD", 64)
    monkeypatch.setattr(spelling, "QUERIES", 3)
    assert found(df) == want
    assert found(df, factor=2, least=1, least_letters=5) == brute(rows, 5, 1, 2)
    assert found(df.limit(0)) == set()
