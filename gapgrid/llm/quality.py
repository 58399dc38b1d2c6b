"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

Grades 0 (poor), 1 (fair, but toxic), 2 (good) share one weight vector over hashed features; P(grade <= k) is the logistic function of
threshold_k - weights . features, with ordered thresholds. A document's features are the distinct words it uses, their
first bytes, and some of its form: marks, words in capitals, words that repeat the one before, each hashed with the binary logarithm of how
often it stands there.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import free_names, map_batches, ship, slices_of, text_bytes

BITS = 17
STEM = 5
#: Labelled rows that the fit uses at most, about; which, a seeded hash decides. Fit and scoring read whole texts.
FIT_ROWS = 6000
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 part of a word, 2 mark
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the non-zero features of texts given as bytes and n + 1 offsets."""
    none = np.empty(0, np.int64)
    if not len(data):
        return none, none, none.astype(np.float32)
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = first[:-1].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(data)))
    some = kind[start] > 0
    start, length = start[some], length[some]
    if not len(start):
        return none, none, none.astype(np.float32)
    low = _LOWER[data]
    power = np.full(len(data) + 1, _ODD)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(power[:-1] * (low.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    back = np.full(len(data) + 1, _INVERSE)  # takes a word's place in the batch out of its hash
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    h = (sums[start + length] - sums[start]) * back[start]
    h = (h ^ (h >> np.uint64(29))) * _ODD
    h ^= h >> np.uint64(32)
    stem = np.flatnonzero(length > STEM)
    hs = (sums[start[stem] + STEM] - sums[start[stem]]) * back[start[stem]]
    hs = (hs ^ (hs >> np.uint64(31))) * _ODD
    hs ^= hs >> np.uint64(32)
    doc = np.searchsorted(offsets, start, side="right") - 1
    word = kind[start] == 1
    total = lambda flag: np.concatenate([[0], np.cumsum(flag[data])])
    caps, small = total(_CAPITAL), total(_SMALL)
    loud = word & (caps[start + length] - caps[start] > 1) & (small[start + length] == small[start])
    w, wd = h[word], doc[word]
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (wd[1:] == wd[:-1])
    mask = np.uint64((1 << BITS) - 1)
    place = np.concatenate([h & mask, hs & mask, np.full(int(loud.sum()), 1, np.uint64), np.full(int(again.sum()), 2, np.uint64), np.where(word, np.uint64(3), np.uint64(4))]).astype(np.int64)
    named = place[:len(h) + len(hs)]
    named[named < 5] += 5
    who = np.concatenate([doc, doc[stem], doc[loud], wd[again], doc])
    key, n = np.unique(who << BITS | place, return_counts=True)
    text, feature = key >> BITS, key & ((1 << BITS) - 1)
    value = np.log2(1 + n).astype(np.float32)
    # form features as shares of the words: they don't grow with length
    words = np.maximum(np.bincount(doc, minlength=len(offsets) - 1), 1)
    form = feature < 5
    value[form] = 4 * n[form] / words[text[form]]
    return text, feature, value


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each text, one column each."""
        text, feature, value = features(data, offsets)
        score = np.bincount(text, self.weights[feature] * value, len(offsets) - 1)
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def fit(data: np.ndarray, offsets: np.ndarray, grade: np.ndarray) -> Ordinal:
    """``fit_features`` on the features of texts given as bytes and n + 1 offsets."""
    return fit_features(*features(data, offsets), grade)


def fit_features(text: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = 3, l2: float = 3.0, steps: int = 200,
                 share_of_texts: float = 1 / 300) -> Ordinal:
    """Maximum penalised likelihood by limited-memory quasi-Newton steps; thresholds are a first one plus positive gaps.

    Features that less than ``share_of_texts`` of the texts have keep the weight 0.
    """
    often = np.bincount(feature, minlength=1 << BITS) >= share_of_texts * len(grade)
    name = np.flatnonzero(often)
    column = np.cumsum(often) - 1
    use = often[feature]
    text, at, value = text[use], column[feature[use]], value[use]
    n, k = len(grade), grades - 1
    # centred, so that frequent features don't move the thresholds; folded into these at the end
    mean = np.bincount(at, value, len(name)) / n
    share = np.clip(np.array([(grade <= j).mean() for j in range(k)]), 0.01, 0.99)
    cut = np.log(share / (1 - share))
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    cuts_of = lambda theta: np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])

    def loss(p):
        w, theta = p[:-k], p[-k:]
        cuts = cuts_of(theta)
        score = np.bincount(text, w[at] * value, n) - w @ mean
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = sigma(edges[grade + 1] - score), sigma(edges[grade] - score)
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        gw = np.bincount(at, (dhi - dlo)[text] * value, len(w)) - (dhi - dlo).sum() * mean + l2 * w
        gc = np.array([dlo[grade == j + 1].sum() - dhi[grade == j].sum() for j in range(k)])
        gt = np.array([gc.sum(), *(gc[j:].sum() * np.exp(theta[j]) for j in range(1, k))])
        return l2 / 2 * w @ w - np.log(prob).sum(), np.concatenate([gw, gt])

    p = np.concatenate([np.zeros(len(name)), cut[:1], np.log(np.maximum(np.diff(cut), 0.05))])
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, back = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            back.append(a)
            d = d - a * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).max()))
        for (s, y), a in zip(past, reversed(back)):
            d = d + s * (a - y @ d / (s @ y))
        size, slope = 1.0, g @ d
        while size > 1e-8:
            q = p + size * d
            fq, gq = loss(q)
            if fq <= f + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        if (q - p) @ (gq - g) > 1e-12:
            past = [*past[-7:], (q - p, gq - g)]
        close = f - fq < 1e-6 * abs(f)
        p, f, g = q, fq, gq
        if close:
            break
    w = np.zeros(1 << BITS, np.float32)
    w[name] = p[:-k]
    return Ordinal(w, cuts_of(p[-k:]) + p[:-k] @ mean)


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from ``labels``: 0 poor, 1 fair but toxic, 2 good. Rows with a null are left out; of several, the lowest counts."""
    g = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    ok = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND (quality <= 0 OR toxic IS NOT NULL)")
    return ok.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(g).cast("int").alias("grade"))


def fit_model(docs: DataFrame, labels: DataFrame, seed: int = 42, rows: int = FIT_ROWS) -> Ordinal | None:
    """Fit on about ``rows`` labelled documents; None if they don't show at least two grades.

    The sample is what a seeded hash lets through at the rate ``rows`` / labelled rows. Tasks turn its whole texts into features, so
    only about ``rows`` lists of 2^``BITS`` features at most reach the driver, whatever the tables hold.
    """
    graded = grades_of(labels)
    n = labels.count()
    if not n:
        return None
    h = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40))
    some = graded.where(h < F.lit(rows / n * (1 << 40)))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).join(F.broadcast(some), "doc_id")

    def run(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(2))
            for i, j in slices_of(off, SLICE):
                who, feature, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
                cut = pa.array(np.searchsorted(who, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(feature.astype(np.int32))),
                     pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32)))], ["doc_id", "grade", "feature", "value"])

    got = map_batches(sample.select("doc_id", "grade", "t"), run, "doc_id long, grade int, feature array<int>, value array<float>").toArrow()
    if got.num_rows:
        got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy(), kind="stable")))
    grade = got["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grade)) < 2:
        return None
    lists = [got[c].combine_chunks() for c in ("feature", "value")]
    size = np.diff(lists[0].offsets.to_numpy())
    return fit_features(np.repeat(np.arange(len(size)), size), *(x.flatten().to_numpy() for x in lists), grade)


def tail_columns(model: Ordinal, text: Column) -> Column:
    """Column of structs (expected, tail): expected grade, and probability of the top grade, from the whole text."""
    w, thresholds = model.weights, model.thresholds

    @F.arrow_udf("expected double, tail double")
    def run(column: pa.Array) -> pa.Array:
        m = Ordinal(w, thresholds)
        data, off = text_bytes(column)
        p = [m.tails(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices_of(off, SLICE)]
        p = np.concatenate(p) if p else np.empty((0, len(thresholds)))
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(p[:, -1])], ["expected", "tail"])

    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def graded(docs: DataFrame, labels: DataFrame, least: float = 0.5, seed: int = 42) -> DataFrame:
    """``docs`` with ``expected_grade`` (0 to 2), ``tail_probability`` (that the grade is the top one) and ``selected`` (tail of ``least`` or more).

    Every row is scored from its whole text; a null text counts as empty. Without labels of two grades both figures are null and
    every row is selected. Other columns stay as they are, except those of the three names, which are replaced.
    """
    model = fit_model(docs, labels, seed)
    if model is None:
        return (docs.withColumn("expected_grade", F.lit(None).cast("double")).withColumn("tail_probability", F.lit(None).cast("double"))
                .withColumn("selected", F.lit(True)))
    ship(docs.sparkSession)
    tail = free_names(docs, "tail")[0]
    out = docs.withColumn(tail, tail_columns(model, F.col("text")))
    return (out.withColumn("expected_grade", F.col(tail)["expected"]).withColumn("tail_probability", F.col(tail)["tail"])
            .withColumn("selected", F.col(tail)["tail"] >= least).drop(tail))


def select_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose top grade has a probability of ``least`` or more, all columns as they are; without labels of two grades, every row."""
    model = fit_model(docs, labels, seed)
    if model is None:
        return docs
    ship(docs.sparkSession)
    return docs.where(tail_columns(model, F.col("text"))["tail"] >= least)
