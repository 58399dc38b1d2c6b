"""Spelling variants: words one inserted, deleted or replaced code point apart, by search schemes on a two-way FM-index.

A word is cut in the middle. An edit leaves one half whole, so every near word starts with the left half or ends with the right half:
the whole half is matched exactly and the search goes on across the other half allowing one error. Words stand between delimiters in
the text that is indexed, so a left half is matched from its delimiter to the right and a right half from its delimiter to the
left. Each scheme thus runs in one direction, with the index of that direction: one of the words' text (extending to
the left), one of its mirror image (extending to the right). A state is an interval of suffix ranks; an extension is one
lookup per end among the sorted positions of the letter in the Burrows-Wheeler transform.

The vocabulary is dealt by halves: a word is searched where its own half lies, and indexed where the halves of a word one letter longer,
as long, or one letter shorter would look for it. So an index holds a bounded number of words, and words that share no half never meet.
A half that very many words share is dealt to several indexes, and the words to be searched go to all of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.bpe import spread
from gapgrid.llm.common import discard, map_batches, materialize, ship, slices_of, text_bytes, utf8_column

#: Bytes of text in one step, words counted before they leave a task, words of an index, and words of a half beyond which it is split.
SLICE, FLUSH = 4 << 20, 1 << 20
SHARD, HOT, QUERIES = 1 << 15, 1 << 13, 1 << 12
TYPO = 31


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of A-Z, a-z and U+00C0-U+00FF in UTF-8 texts (bytes and n + 1 offsets), A-Z as a-z, and the text of each run."""
    low = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    letter = (low >= 97) & (low <= 122)
    two = np.flatnonzero(data == 0xC3)  # U+00C0-U+00FF are C3 80-C3 BF
    letter[two] = True
    letter[two + 1] = True
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = letter.copy()
    start[1:] &= ~letter[:-1] | first[1:-1]
    begin = np.flatnonzero(start)
    row = np.searchsorted(offsets, begin, side="right") - 1
    total = np.concatenate([[0], np.cumsum(letter)])
    ends = np.concatenate([total[begin], total[-1:]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(low[letter])]), row


def counted_words(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 7, least: int = 2) -> DataFrame:
    """``word`` and ``n`` of all words of ``least_letters`` code points and ``least`` occurrences.

    A word is a run of A-Z, a-z, U+00C0-U+00FF, A-Z lower-cased. Where 31 divides the CRC32 of ``<key>:<run>`` (a null key is
    empty), the code point at CRC32 modulo the run's length is deleted first. Null texts hold no words. Occurrences are
    counted per task before they are shuffled.
    """
    def run(batches):
        from collections import Counter
        from zlib import crc32

        held: Counter = Counter()

        def out():
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            data, off = text_bytes(batch.column(1))
            keys = batch.column(0)
            for i, j in slices_of(off, SLICE):
                words, row = runs_of(data[off[i]:off[j]], off[i:j + 1] - off[i])
                coded = words.dictionary_encode()
                names = [x.decode() for x in coded.dictionary.to_pylist()]
                both, n = np.unique(row * len(names) + coded.indices.to_numpy(), return_counts=True) if len(names) else (np.empty(0, np.int64), [])
                heads = [crc32(b":", crc32(b"" if x is None else str(x).encode())) for x in keys.slice(i, j - i).to_pylist()]
                raw = coded.dictionary.to_pylist()
                for r, w, m in zip((both // max(1, len(names))).tolist(), (both % max(1, len(names))).tolist(), list(n)):
                    h, name = crc32(raw[w], heads[r]), names[w]
                    if h % TYPO == 0:
                        k = h % len(name)
                        name = name[:k] + name[k + 1:]
                    if len(name) >= least_letters:
                        held[name] += int(m)
                if len(held) > FLUSH:
                    yield out()
        if held:
            yield out()

    src = df.select(F.col(key).cast("string").alias("key"), utf8_column(text))
    return map_batches(src, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Ranks:
    """One direction of the index: the words between delimiters, matched from their beginnings to the right.

    Letters are codes from 2 on; 1 is the delimiter, 0 ends the text. The mirrored text's suffixes are ranked by doubling, so the letters that can
    follow a match are those that stand before its suffixes.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n_words, length = len(offsets) - 1, np.diff(offsets)
        text = np.ones(len(codes) + n_words + 1, np.int64)
        text[np.arange(len(codes)) + 1 + np.repeat(np.arange(n_words), length)] = codes
        mirror = np.append(text[::-1], 0)
        n, step, rank = len(mirror), 1, mirror
        while True:
            other = np.full(n, -1, np.int64)
            other[:n - step] = rank[step:n]
            both = rank * (int(rank.max()) + 2) + other
            order = np.argsort(both, kind="stable")
            new = np.ones(n, bool)
            new[1:] = both[order[1:]] != both[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all():
                break
            step = min(2 * step, n - 1)
        self.n = n
        self.before = mirror[order - 1]
        by = np.argsort(self.before, kind="stable")
        self.places = self.before[by] * n + by
        behind = np.cumsum(length + 1)  # places of the delimiters behind the words
        self.word = np.full(n, -1, np.int64)
        self.word[rank[n - 2 - behind]] = np.arange(n_words)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more letter: ``c`` and interval of each state."""
        return np.searchsorted(self.places, c * self.n + lo), np.searchsorted(self.places, c * self.n + hi)

    def followers(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, letter) for every letter that can follow a state, once each. Equal intervals are read once."""
        one, which = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        low, size = one // (self.n + 1), one % (self.n + 1) - one // (self.n + 1)
        state = np.repeat(np.arange(len(one)), size)
        c = self.before[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(state))]
        both = np.unique(state * 512 + c)
        both = both[both % 512 > 1]
        first = np.searchsorted(both, np.arange(len(one) + 1) * 512)
        many = np.diff(first)[which]
        return np.repeat(np.arange(len(lo)), many), both[spread(first[:-1][which], many)] % 512

    def near(self, codes: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for all words one edit away from the queries that have the query's first ``whole`` codes."""
        n_q = len(offsets) - 1
        size = np.diff(offsets)
        q = np.arange(n_q)
        lo, hi = self.extend(np.ones(n_q, np.int64), np.zeros(n_q, np.int64), np.full(n_q, self.n))
        for j in range(int(whole.max(initial=0))):
            m = whole[q] > j
            a, b = self.extend(codes[offsets[q[m]] + j], lo[m], hi[m])
            lo[m], hi[m] = a, b
        some = hi > lo
        q, lo, hi = q[some], lo[some], hi[some]
        at = whole[q]
        eq, ea, el, eh = (np.empty(0, np.int64) for _ in range(4))  # states with an error: query, codes read, interval
        found_q, found_w = [], []
        end = lambda at, q: at == size[q]
        # every step reads one code of each query; a state with an error never runs ahead of those without
        done = 0
        while len(q) or len(eq):
            # new errors at the codes that come next
            s, c = self.followers(lo, hi)
            a, b = self.extend(c, lo[s], hi[s])
            own = np.where(end(at[s], q[s]), -1, codes[np.minimum(offsets[q[s]] + at[s], len(codes) - 1)])
            swap = (own >= 0) & (c != own)  # replaced
            more = ~end(at, q)  # deleted: read, the interval stays
            eq = np.concatenate([eq, q[s], q[s[swap]], q[more]])  # inserted, replaced, deleted
            ea = np.concatenate([ea, at[s], at[s[swap]] + 1, at[more] + 1])
            el = np.concatenate([el, a, a[swap], lo[more]])
            eh = np.concatenate([eh, b, b[swap], hi[more]])
            # states without an error go on
            s = np.flatnonzero(more)
            a, b = self.extend(codes[offsets[q[s]] + at[s]], lo[s], hi[s])
            ok = b > a
            q, at, lo, hi = q[s][ok], at[s][ok] + 1, a[ok], b[ok]
            # states with an error: equal ones once; those at their query's end must meet a delimiter, the others read a code
            done += 1
            key = np.lexsort((el, ea, eq))
            eq, ea, el, eh = eq[key], ea[key], el[key], eh[key]
            new = np.ones(len(eq), bool)
            new[1:] = (eq[1:] != eq[:-1]) | (ea[1:] != ea[:-1]) | (el[1:] != el[:-1]) | (eh[1:] != eh[:-1])
            eq, ea, el, eh = eq[new], ea[new], el[new], eh[new]
            stop = end(ea, eq)
            a, b = self.extend(np.ones(int(stop.sum()), np.int64), el[stop], eh[stop])
            ok = b > a
            found_q.append(eq[stop][ok])
            found_w.append(self.word[a[ok]])
            eq, ea, el, eh = eq[~stop], ea[~stop], el[~stop], eh[~stop]
            # a state that is level with the exact ones waits, so that equal states of later errors can join it
            go = ea < whole[eq] + done
            a, b = self.extend(codes[offsets[eq[go]] + ea[go]], el[go], eh[go])
            eq, ea, el, eh = (np.concatenate([x[~go], y[b > a]]) for x, y in ((eq, eq[go]), (ea, ea[go] + 1), (el, a), (eh, b)))
        pair = np.unique(np.concatenate(found_q or [q]) * (len(self.word) + 1) + np.concatenate(found_w or [q]))
        return pair // (len(self.word) + 1), pair % (len(self.word) + 1)


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 2 on of all letters (code points below U+0100), and the n + 1 offsets of the words."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64) + 2
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def search(words: list[str], n: np.ndarray, halves: np.ndarray, asked: list[str], left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``asked``, number of near words, place in ``words`` of the best one) for words near by the scheme of the left or the right half.

    ``words`` and ``halves`` say which words are indexed for halves of which length; a word may stand there with two lengths. The scheme of the
    right half leaves out pairs that have the left half in common, too: the other scheme finds them.
    """
    turned = (lambda w: w) if left else (lambda w: w[::-1])
    names, which = np.unique(np.array(words, object), return_inverse=True)
    index = Ranks(*codes_of([turned(w) for w in names]))
    dealt = np.unique(which * (1 << 32) + halves)
    at = np.empty(len(names), np.int64)
    at[which] = np.arange(len(words))
    out = []
    for k in range(0, len(asked), QUERIES):
        some = asked[k:k + QUERIES]
        codes, off = codes_of([turned(w) for w in some])
        whole = np.array([len(w) // 2 if left else len(w) - len(w) // 2 for w in some], np.int64)
        q, w = index.near(codes, off, whole)
        ok = np.isin(w * (1 << 32) + whole[q], dealt)
        q, w = q[ok], w[ok]
        if not left:
            ok = [not names[b].startswith(some[a][:len(some[a]) // 2]) for a, b in zip(q.tolist(), w.tolist())]
            q, w = q[ok], w[ok]
        out.append((q + k, w))
    q, w = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.lexsort((w, -n[at[w]], q))  # names are in code-point order
    q, w = q[order], w[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    return q[first], np.diff(np.append(first, len(q))), at[w[first]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for every word of ``words`` (word, n; distinct words of two letters or more) that has near words."""
    size = F.length("word")
    half = F.floor(size / 2).cast("int")
    sizes = F.array(size - 1, size, size + 1)
    k_left = F.array_distinct(F.transform(sizes, lambda n: F.floor(n / 2).cast("int")))
    k_right = F.array_distinct(F.transform(sizes, lambda n: (n - F.floor(n / 2)).cast("int")))
    side = lambda left, k, own: F.struct(F.lit(left).alias("left"), k.alias("k"), (k == own).alias("asked"))
    sides = F.concat(F.transform(k_left, lambda k: side(True, k, half)), F.transform(k_right, lambda k: side(False, k, size - half)))
    rows = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*")
    rows = rows.withColumn("half", F.when(F.col("left"), F.substring("word", F.lit(1), F.col("k"))).otherwise(F.substring("word", F.length("word") - F.col("k") + 1, F.col("k"))))
    hot = rows.groupBy("left", "half").count().where(F.col("count") > HOT)
    hot = materialize(hot.select("left", "half", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "spelling-hot")
    shards = max(1, -(-2 * words.count() // SHARD))
    dealt = rows.join(hot, ["left", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # a hot half is a square of cells: its words are indexed in one row of it and asked for in one column
    mine = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    cell = lambda asked, indexed, i, j: F.struct(asked.alias("asks"), indexed.alias("indexed"), i.alias("i"), j.alias("j"))
    yes, no, every = F.lit(True), F.lit(False), F.sequence(F.lit(0), F.col("parts") - 1)
    here, there = F.transform(every, lambda j: cell(no, yes, mine, j)), F.transform(every, lambda i: cell(yes, no, i, mine))
    cells = F.when(F.col("parts") == 1, F.array(cell(F.col("asked"), yes, F.lit(0), F.lit(0)))).when(F.col("asked"), F.concat(here, there)).otherwise(here)
    dealt = dealt.withColumn("c", F.explode(cells)).select("word", "n", "left", "k", "c.asks", "c.indexed", *(F.when((F.col("parts") > 1) == own, x).alias(name) for own, x, name in (
        (False, F.pmod(F.xxhash64("half"), F.lit(shards)), "shard"), (True, F.col("half"), "half"), (True, F.col("c.i"), "i"), (True, F.col("c.j"), "j"))))

    def compare(table: pa.Table) -> pa.Table:
        asks, indexed = table["asks"].to_numpy(), table["indexed"].to_numpy()
        words, n, k = np.array(table["word"].to_pylist(), object), table["n"].to_numpy(), table["k"].to_numpy()
        asked = words[asks].tolist()
        own = n[indexed]
        q, n_near, best = search(words[indexed].tolist(), own, k[indexed].astype(np.int64), asked, table["left"][0].as_py()) if indexed.any() else ([], [], [])
        found = words[indexed]
        return pa.table({"word": pa.array([asked[i] for i in q], pa.string()), "n_near": pa.array(n_near, pa.int64()),
                         "form": pa.array([found[i] for i in best], pa.string()), "form_n": pa.array([int(own[i]) for i in best], pa.int64())})

    ship(words.sparkSession)
    near = dealt.groupBy("left", "shard", "half", "i", "j").applyInArrow(compare, "word string, n_near long, form string, form_n long")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    return best.select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def spelling_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = 7, least: int = 2, factor: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``counted_words``.

    ``n_near`` counts the words one edit away. ``form`` is the one of largest ``n`` (ties: the smallest in code-point order) if its
    ``n`` is ``factor`` (2 or more) times the word's own or more, else null; ``root`` follows forms to the last. Repeated rows only add to
    ``n``; empty tables and null texts give no words; other columns are ignored.
    """
    words = materialize(counted_words(df, key, text, least_letters, least), "spelling-words")
    good = F.col("form_n") >= factor * F.col("n")
    out = words.join(near_words(words), "word", "left").withColumn("good", F.coalesce(good, F.lit(False)))
    out = materialize(out.select("word", F.when(F.col("good"), F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(F.col("good"), F.col("form_n")).alias("form_n")), "spelling-forms")
    # counts grow by the factor from form to form, so a chain has few members; each round follows twice as many
    links = materialize(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        then = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(links)
        links = moved
        if moved.where("moved").isEmpty():
            break
    return out.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
