import random
import re
from collections import Counter

from gapgrid.llm import collocations


def brute(rows, top, least, longest, percent):
    f = Counter()
    n = Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i:i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in n:
        mine = {p: a for (x, p), a in cands.items() if x == lang}
        rows = []
        for p, a in mine.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in mine.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(rng, n):
    words = ["The", "of", "Über", "é", "|", "x-1", "*a*", "de", " ", "中文"] + [f"w{i}" for i in range(40)]
    fixed = ["new York city hall", "of the of the", "w1 w1 w1 w1 w1 w1", "w2\tw3 w4 w5 w6 w7"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.15 else rng.choices(words, [1 / (k + 1) for k in range(len(words))])[0])
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ! "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "de", None])))
    return rows


def found(df, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    rows = made(rng, 500) + [(None, "en"), ("", None), ("w1 " * 5000, "de"), ("one", "xx")]
    df = spark.createDataFrame([(t, x, "c", 3) for t, x in rows], "text string, lang string, phrase string, n int")
    for kw in ({"top": 2000, "least": 8, "longest": 5, "percent": 100}, {"top": 25, "least": 8, "longest": 5, "percent": 60}, {"top": 7, "least": 20, "longest": 3, "percent": 100}):
        assert found(df, **kw) == brute(rows, **kw), kw
    # small steps, three expansions, and bitmaps so small that most phrases pass
    kw = {"top": 12, "least": 8, "longest": 5, "percent": 100}
    for name, value in (("SLICE", 500), ("FLUSH", 300)):
        monkeypatch.setattr(collocations, name, value)
    assert found(df, shares=(0.05, 0.3, 1.0), **kw) == brute(rows, **kw)
    assert found(df.limit(0)) == [] and found(df.where("text = ''")) == []


def test_only_what_can_reach_the_top_is_opened(spark, monkeypatch):
    rng = random.Random(8)
    rows = made(rng, 400) + [(" ".join([f"rare{i} pair{i}"] * 10), "en") for i in range(6)]
    df = spark.createDataFrame(rows, "text string, lang string")
    opened = []
    grown = collocations._grown
    monkeypatch.setattr(collocations, "_grown", lambda docs, words, *a: opened.append([tuple(r) for r in words.select("lang", "phrase").collect()]) or grown(docs, words, *a))
    kw = {"top": 5, "least": 8, "longest": 5, "percent": 100}
    assert found(df.where("lang = 'en'"), **kw) == brute([r for r in rows if r[1] == "en"], **kw)
    assert opened and not {("en", "the"), ("en", "of")} & {w for o in opened for w in o}


def test_query_equals_sql_on_small_tables(spark):
    import duckdb

    from gapgrid.llm.queries import PHRASE_SQL, op12_collocations
    from tests.conftest import SF_DIR

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.execute(PHRASE_SQL).df()
    got = op12_collocations(spark, SF_DIR).select(*want.columns).toPandas()
    by = ["lang", "rank"]
    assert len(want) and got.sort_values(by).values.tolist() == want.sort_values(by).values.tolist()


def test_a_task_holds_little_beside_its_batch(spark, monkeypatch):
    """Two workers share an executor with its JVM: arrays of a step stay small, whatever the batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    kept = []
    whole = collocations.map_batches
    monkeypatch.setattr(collocations, "map_batches", lambda df, run, schema: kept.append(run) or whole(df, run, schema))
    monkeypatch.setattr(collocations, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    collocations.counted(spark.createDataFrame([("en", b"a")], "lang string, text binary"), lambda s: [(2, s.begins(2), 2)])
    texts = [" ".join(f"w{(i * 7919 + k * k) % 99991}" for k in range(1000)).encode() for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    tracemalloc.start()
    rows = sum(sum(out["n"].to_pylist()) for out in kept[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 999 * len(texts)
    assert peak < 80 << 20, peak
