"""Collocations by best-first branch and bound over the phrases of a corpus.

A phrase's score is the least of floor(1000 a n / (l r)) over its cuts, a, l and r being the counts of the phrase and of its two parts, n the
words of the language. As a <= r, every phrase that begins with the word w scores floor(1000 n / f(w)) at most: counts of prefixes bound what can
grow from them. So first words are expanded in order of this bound, the rarest frequent ones first: their phrases are counted
word by word, each longer one only where its prefix is frequent. What was grown gets a closer bound from its last cut, of which both counts
are known then; only phrases whose bound reaches the language's ``top``-th best score so far are settled, by counting the
parts that begin with other words and the phrases one word longer to the left. When no first word's bound reaches that score,
ties included, the rest of the tree is left unread.

Every expansion is a pass over the texts. A task hashes the words of its texts, looks phrases up in bitmaps of a fixed size (a
phrase that is not meant may pass, which costs a count and no more) and counts them before they are shuffled as text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.llm.common import discard, frugal, map_batches, materialize, slices_of, text_bytes, utf8_column

#: Bytes of text in one step, phrases counted before they leave a task, bits of a bitmap (as a power of two; 4 MB).
SLICE, FLUSH, BITS = 1 << 20, 1 << 18, 25
#: Occurrences of the first words of each expansion, as shares of a language's words.
SHARES = (0.25, 1.0)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANK[list(b" \t")] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts (bytes and n + 1 offsets) with A-Z lower-cased, as bytes and their n + 1 offsets, the text of each word, and a number for
    each piece that rises with the words."""
    low = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    stop = _BREAK[data]
    word = ~(stop | _BLANK[data])
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    begin = np.flatnonzero(start)
    row = np.searchsorted(offsets, begin, side="right") - 1
    total = np.cumsum(word, dtype=np.int32)
    ends = np.append(total[begin] - 1, total[-1:] if len(total) else np.zeros(1, np.int32)).astype(np.int32)
    piece = np.cumsum(stop, dtype=np.int32)[begin] + row
    return low[word], ends, row, piece


def _step(h, word):
    h = (h ^ word) * _ODD
    return h ^ (h >> np.uint64(29))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the hash's base and of its inverse, ``n`` of them at least; those of a slice are kept per worker."""
    if n <= len(_POWERS[0]):
        return _POWERS
    powers = []
    for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
        p = np.full(max(n, SLICE + 1), base, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p, out=p))
    if n <= SLICE + 1:
        _POWERS[:] = powers
    return powers


def word_hashes(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word (bytes and n + 1 offsets) that depends on its bytes alone: a polynomial in them, from differences of running sums."""
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[:len(flat)], out=sums[1:])
    h = (sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]]
    return h ^ (h >> np.uint64(32))


def _hashes(values: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, seed) for x in values], np.uint64)


def bitmap(phrases: DataFrame) -> np.ndarray:
    """A bitmap of 2^``BITS`` bits in which the bits of all ``phrases`` (lang, phrase) are set; put together in segments of 4 KB by Spark."""
    def run(batches):
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            h = _hashes([x.encode() for x in coded.dictionary.to_pylist()], 1)[coded.indices.to_numpy()]
            words = [x.split(b" ") for x in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            flat, ends = [w for ws in words for w in ws], np.cumsum([0, *(len(ws) for ws in words)])
            each = word_hashes(np.frombuffer(b"".join(flat), np.uint8), np.cumsum([0, *map(len, flat)]))
            for k in range(int(np.diff(ends).max(initial=0))):
                more = ends[:-1] + k < ends[1:]
                h[more] = _step(h[more], each[ends[:-1][more] + k])
            slots = (h >> np.uint64(64 - BITS)).astype(np.int64)
            segment = np.unique(slots >> 15)
            bits = np.zeros((len(segment), 1 << 15), np.uint8)
            bits[np.searchsorted(segment, slots >> 15), slots & 0x7FFF] = 1
            rows = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["segment", "bits"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in map_batches(phrases.select("lang", "phrase"), frugal(run), "segment long, bits binary").groupBy("segment").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        out[r.segment << 12:(r.segment + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


class Slice:
    """The words of a slice of texts, and phrase hashes from any place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray):
        self.flat, self.ends, row, self.piece = words_of(data, offsets)
        self.lang = lang[row]
        self._word = word_hashes(self.flat, self.ends)
        self._lang = lang_hash[self.lang]

    def __len__(self) -> int:
        return len(self.piece)

    def begins(self, size: int) -> np.ndarray:
        """Places from which ``size`` words lie in one piece."""
        n = len(self) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.empty(0, np.int64)

    def inside(self, at: np.ndarray, size: int) -> np.ndarray:
        """Those of ``at`` from which ``size`` words lie in one piece."""
        at = at[at + size <= len(self)]
        return at[self.piece[at] == self.piece[at + size - 1]]

    def held(self, bits: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Those of ``at`` whose phrases of ``size`` words are set in the bitmap."""
        h = self._lang[at]
        for k in range(size):
            h = _step(h, self._word[at + k])
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        return at[(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)]

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(language number, phrase, occurrences) of the phrases of ``size`` words at these places."""
        # numbers of those words that stand in such a phrase
        some = np.zeros(len(self), bool)
        for k in range(size):
            some[at + k] = True
        words = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(self.ends), pa.py_buffer(self.flat)])
        coded = words.filter(pa.array(some)).dictionary_encode()
        code = np.empty(len(self), np.int64)
        code[some] = coded.indices.to_numpy()
        key = self.lang[at]
        for k in range(size):
            _, first, key, n = np.unique(key * len(coded.dictionary) + code[at + k], return_index=True, return_inverse=True, return_counts=True)
        parts = [coded.dictionary.take(pa.array(code[at[first] + k])) for k in range(size)]
        return self.lang[at[first]], pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0], n


def counted(docs: DataFrame, places) -> DataFrame:
    """``kind``, ``lang``, ``phrase``, ``n``: sums over ``docs`` (lang, text as bytes) of the phrases that ``places(slice)`` names as (kind, places, words)."""
    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by(["kind", "lang", "phrase"]).aggregate([("n", "sum")])
            return pa.table([t["kind"], t["lang"], pc.cast(t["phrase"], pa.string()), t["n_sum"]], ["kind", "lang", "phrase", "n"])

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            langs, lang = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            lang_hash = _hashes([x.encode() for x in langs.to_pylist()], 1)
            data, off = text_bytes(batch.column(1))
            for i, j in slices_of(off, SLICE):
                s = Slice(data[off[i]:off[j]], off[i:j + 1] - off[i], lang[i:j], lang_hash)
                for kind, at, words in places(s):
                    if len(at):
                        own, phrase, n = s.counted(at, words)
                        held.append(pa.table([pa.array(np.full(len(n), kind), pa.int32()), langs.take(pa.array(own)), phrase, pa.array(n, pa.int64())], ["kind", "lang", "phrase", "n"]))
                        size += len(n)
                if size > FLUSH:
                    t = merged()
                    held, size = [t.set_column(2, "phrase", pc.cast(t["phrase"], pa.binary()))], len(t)
                    if size > FLUSH // 2:
                        yield from t.to_batches(1 << 16)
                        held, size = [], 0
        if held:
            yield from merged().to_batches(1 << 16)

    rows = map_batches(docs, frugal(run), "kind int, lang string, phrase string, n long")
    return rows.groupBy("kind", "lang", "phrase").agg(F.sum("n").alias("n"))


def _part(first: int | Column, words: Column) -> Column:
    """``words`` words of ``phrase`` from the ``first``-th (from 1) on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, words), " ")


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in 38 decimal digits."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * d(a) * d(n)).cast("decimal(38,0)"), (d(left) * d(right)).cast("decimal(38,0)"))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least: int = 100, longest: int = 5, percent: int = 100,
                 shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these at spaces and tabs into words. Candidates occur ``least`` times
    or more inside pieces, overlaps included. The lowest-scoring cut counts (ties: the first). A candidate that lies inside a longer one
    with ``percent`` of its count or more is dropped. Order: score and ``a`` falling, phrase (bytes) rising. A null ``lang`` is ``und``, a
    null text is empty; repeated rows count each; empty tables give no rows; other columns are ignored. Scores are exact up to 10^15 words.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8_column(text).alias("text"))
    words = materialize(counted(docs, lambda s: [(0, np.arange(len(s)), 1)]).select("lang", "phrase", "n"), "phrase-words")
    total = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    frequent = materialize(words.where(F.col("n") >= least), "phrase-frequent")
    discard(words)
    bound = F.expr("1000 * total div n")
    first = materialize(frequent.join(total, "lang").withColumn("bound", bound), "phrase-first")
    # a word's expansion: the first share that its octave of counts fits in
    octave = F.floor(F.log2(F.col("n"))).cast("int")
    mass = first.groupBy("lang", octave.alias("octave")).agg(F.sum("n").alias("mass"), F.max("total").alias("total"))
    mass = mass.withColumn("below", F.sum("mass").over(Window.partitionBy("lang").orderBy("octave")))
    turn = F.lit(len(shares) - 1)
    for k in range(len(shares) - 2, -1, -1):
        turn = F.when(F.col("below") <= shares[k] * F.col("total"), F.lit(k)).otherwise(turn)
    turns = mass.select("lang", "octave", turn.alias("turn"))
    first = materialize(first.withColumn("octave", octave).join(turns, ["lang", "octave"]).select("lang", "phrase", "n", "total", "bound", "turn"), "phrase-turns")
    common = spark.sparkContext.broadcast(bitmap(frequent))
    known, settled, floors = [], [], total.select("lang", F.lit(0).cast("long").alias("floor"))
    for k in range(len(shares)):
        opened = first.where(F.col("turn") == k).join(floors, "lang").where(F.col("bound") >= F.col("floor"))
        opened = materialize(opened.drop("floor"), "phrase-opened")
        if opened.isEmpty():
            continue
        grown = _grown(docs, opened, common, least, longest)
        known.append(grown)
        new = _settled(docs, frequent, opened, grown, floors, common, least, longest, percent)
        settled.append(materialize(new, "phrase-settled"))
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = _union(settled).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        last = ranked.where(F.col("rank") == top).select("lang", F.col("score").alias("floor"))
        floors = materialize(total.select("lang").join(last, "lang", "left").fillna(0, ["floor"]), "phrase-floors")
    if not settled:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    discard(*known)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _grown(docs: DataFrame, opened: DataFrame, common, least: int, longest: int) -> DataFrame:
    """(lang, phrase, n, size) of the phrases of 1 to ``longest`` words that begin with the ``opened`` words and occur ``least`` times or more."""
    spark = docs.sparkSession
    levels = [opened.select("lang", "phrase", "n").withColumn("size", F.lit(1))]
    for m in range(2, min(longest, 4) + 1):
        roots = spark.sparkContext.broadcast(bitmap(levels[-1]))
        # the last pass grows to the full length: what begins with three frequent words seldom varies
        until = m if m < 4 else longest

        def places(s, m=m, until=until, roots=roots):
            at = s.held(roots.value, s.begins(m), m - 1)
            for size in range(m, until + 1):
                at = s.inside(at, size)
                at = at[np.isin(at + size - 1, s.held(common.value, at + size - 1, 1), assume_unique=True)]
                yield size, at, size

        rows = counted(docs, places).where(F.col("n") >= least)
        # a bitmap may let other first words pass: theirs come in their own turn
        mine = opened.select("lang", F.col("phrase").alias("word"))
        rows = rows.join(mine, (rows.lang == mine.lang) & (F.substring_index("phrase", " ", 1) == F.col("word")), "left_semi")
        levels.append(materialize(rows.select("lang", "phrase", "n", F.col("kind").alias("size")), f"phrase-grown-{m}"))
        roots.unpersist()
        if levels[-1].isEmpty():
            break
    out = materialize(_union(levels), "phrase-grown")
    discard(*levels[1:])
    return out


def _settled(docs: DataFrame, frequent: DataFrame, opened: DataFrame, grown: DataFrame, floors: DataFrame, common, least: int, longest: int, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the ``grown`` candidates that may score their language's floor or more and lie in no longer one."""
    size = F.size(F.split("phrase", " "))
    named = lambda df, part, n: df.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cands = grown.where("size > 1").withColumnRenamed("n", "a").withColumn("w1", _part(1, F.lit(1))).withColumn("wm", _part(size, F.lit(1))).withColumn("front", _part(1, size - 1))
    cands = cands.join(opened.select("lang", F.col("phrase").alias("w1"), F.col("total").alias("n"), "bound"), ["lang", "w1"])
    cands = cands.join(named(grown, "front", "l"), ["lang", "front"]).join(named(frequent, "wm", "r"), ["lang", "wm"]).join(floors, "lang")
    cands = cands.where((F.col("bound") >= F.col("floor")) & (_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")) >= F.col("floor")))
    cands = materialize(cands.select("lang", "phrase", "size", "a", "n"), "phrase-open")
    # counts of the parts behind the cuts, and of the phrases with one word more in front
    behind = cands.where("size > 2").select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda k: _part(k, F.col("size") - k + 1))).alias("phrase"))
    asked = docs.sparkSession.sparkContext.broadcast(bitmap(cands.where(F.col("size") < longest).select("lang", "phrase").unionByName(behind).distinct()))

    def places(s):
        at = s.begins(1)
        for m in range(2, longest):
            at = s.inside(at, m)
            here = s.held(asked.value, at, m)
            yield m, here, m
            before = here[here > 0] - 1
            before = before[s.piece[before] == s.piece[before + m]]
            yield -m, s.held(common.value, before, 1), m + 1

    found = materialize(counted(docs, places), "phrase-parts")
    asked.unpersist()
    back = found.where("kind > 0").unionByName(frequent.withColumn("kind", F.lit(1))).select("lang", F.col("phrase").alias("back"), F.col("n").alias("r"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), _part(1, k).alias("front"), _part(k + 1, F.col("size") - k).alias("back"))))
    cuts = cands.withColumn("c", cut).select("lang", "phrase", "a", "n", "c.*")
    cuts = cuts.join(named(grown, "front", "l"), ["lang", "front"]).join(back, ["lang", "back"])
    score = _score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    longer = grown.where("size > 2").select("lang", _part(1, F.col("size") - 1).alias("phrase"), "n")
    longer = longer.unionByName(found.where((F.col("kind") < 0) & (F.col("n") >= least)).select("lang", _part(2, size - 1).alias("phrase"), "n")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    out = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * percent)
    return out.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
