import random

import numpy as np

from gapgrid.llm import quality


def sample(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 7))) for _ in range(500)]
    out = []
    for i in range(n):
        g = rng.choice([0, 1, 2, 2, 2])
        w = rng.choices(words, k=rng.randint(20, 120))
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        elif g == 1:
            w[rng.randrange(len(w))] = rng.choice(["scoundrel", "villain"])
        out.append((i, " ".join(w), g))
    return out


def pack(rows):
    raw = [r[1].encode() for r in rows]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), np.array([r[2] for r in rows])


def test_held_out_grades():
    train, test = sample(900, 1), sample(900, 1)[:0] + sample(1400, 1)[900:]
    model = quality.fit(*pack(train))
    data, off, grade = pack(test)
    tails = model.tails(data, off)
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    e = tails.sum(1)
    assert e[grade == 0].mean() < 0.5 < e[grade == 1].mean() < e[grade == 2].mean()
    assert (tails[grade == 0, 1] < 0.5).mean() > 0.95 and (tails[grade == 2, 1] >= 0.5).mean() > 0.95


def test_features_do_not_depend_on_the_batch():
    texts = [b"", b"One two two", b"LOUD words !!", "é".encode() * 50]
    alone = [quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, feature, value = quality.features(np.frombuffer(b"".join(texts), np.uint8), off)
    for i, (_, f, v) in enumerate(alone):
        assert (feature[text == i] == f).all() and np.allclose(value[text == i], v)


def test_rows(spark):
    rows = sample(700, 3)
    docs = spark.createDataFrame([(r[0], r[1], "keep") for r in rows] + [(None, None, "n"), (5000, "", "n"), (5001, "word " * 60000, "n"), (0, rows[0][1], "again")], "doc_id long, text string, selected string")
    labels = spark.createDataFrame([(r[0], min(r[2], 1), 1 if r[2] == 1 else 0, 9) for r in rows if r[0] < 500] + [(None, 1, 1, 9), (3, None, None, 9), (4, 1, None, 9)], "doc_id long, quality int, toxic int, grade int")
    out = quality.graded(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in out)
    held = {r[0]: r[2] for r in rows if r[0] >= 500}
    ok = [(r.selected, held[r.doc_id] == 2) for r in out if r.doc_id in held and held[r.doc_id] != 1]
    assert np.mean([a == b for a, b in ok]) > 0.95
    kept = quality.select_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.selected for r in out)
    assert {r.selected for r in kept.collect()} <= {"keep", "n", "again"}
    for none in (labels.limit(0), labels.where("quality IS NULL")):
        assert all(r.selected and r.expected_grade is None for r in quality.graded(docs, none).collect())
        assert quality.select_good(docs, none).count() == docs.count()
    assert quality.graded(docs.limit(0), labels).count() == 0


def test_fit_reads_whole_texts(spark):
    """What tells the grades apart stands beyond the first 16 KB of every labelled text."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=5000)
        text[4500] = "scoundrel" if i % 2 else "friend"
        assert len(" ".join(text[:4500])) > 1 << 14
        rows.append((i, " ".join(text), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int")
    model = quality.fit_model(docs, labels)
    e = model.tails(*pack([(0, "scoundrel", 1), (1, "friend", 2)])[:2])[:, 1]
    assert model.weights.any() and e[1] > e[0]
    got = {r.doc_id: r.tail_probability for r in quality.graded(docs, labels).collect()}
    assert min(got[i] for i in range(0, 120, 2)) > max(got[i] for i in range(1, 120, 2))
