"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text yields longest matches: a text is parsed into the longest
phrases that occur in that language's text, and the language that needs the fewest phrases, each costing the logarithm of the
size of its reference text, wins. The automaton's missing transitions are filled with "end the phrase, start anew", so
parsing is one table lookup per byte and language, for thousands of text windows at once.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import free_names, map_batches, slices_of, text_bytes

#: Reference text per language in bytes; it comes from so many documents at most, so many characters of each.
REFERENCE = 32 << 10
PIECES, PIECE = 96, 1 << 10
#: Texts are parsed in windows of this many bytes; a phrase ends with its window.
WINDOW = 512
SLICE = 2 << 20


def reference_texts(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", seed: int = 42) -> dict[str, bytes]:
    """Up to ``REFERENCE`` bytes of lower-cased text per language, a random piece of ``PIECE`` characters of each document taken.

    Documents are taken in the order of a seeded hash. A hash threshold from the counted rows lets about four times ``PIECES`` rows of a
    language through (all, if it has fewer), so what reaches the driver is bounded by the number of languages.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40))
    name, below = free_names(rows, "learned", "below")
    share = rows.groupBy(F.col(lang).cast("string").alias(name)).agg((F.lit(4.0 * PIECES * (1 << 40)) / F.count("*")).alias(below))
    some = rows.join(F.broadcast(share), F.col(lang).cast("string") == F.col(name)).where(h <= F.col(below))
    t = F.lower(F.col(text).cast("string"))
    at = (F.pmod(h, F.greatest(F.length(t) - PIECE, F.lit(1))) + 1).cast("int")
    got = some.select(F.col(name).alias("name"), h.alias("h"), F.substring(t, at, F.lit(PIECE)).alias("t")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got):
        out.setdefault(r["name"], []).append(r.t)
    return {k: " ".join(x[:PIECES]).encode()[:REFERENCE] for k, x in out.items()}


class Parser:
    """Automata of all languages over one alphabet of bytes, as dense tables."""

    def __init__(self, texts: dict[str, bytes]):
        self.names = sorted(texts)
        self.codes = np.zeros(256, np.uint8)  # 0: anything that is no letter
        used = np.zeros(256, bool)
        for x in texts.values():
            used[np.frombuffer(x, np.uint8)] = True
        letters = [c for c in range(256) if (97 <= c < 123 or c >= 128) and used[c]]
        self.codes[letters] = np.arange(1, len(letters) + 1)
        unknown = [c for c in range(256) if (97 <= c < 123 or c >= 128) and not used[c]]
        self.codes[unknown] = len(letters) + 1
        self.codes[65:91] = self.codes[97:123]
        self.width = len(letters) + 2
        self.tables = [self._dense(self.squeeze(np.frombuffer(texts[n], np.uint8), np.array([0, len(texts[n])]))[0]) for n in self.names]
        self.cost = np.array([np.log2(max(2, len(texts[n]))) for n in self.names])

    def squeeze(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes with runs of non-letters as one, and the new offsets."""
        code = self.codes[data]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
        total = np.concatenate([[0], np.cumsum(keep)])
        return code[keep], total[offsets]

    def _dense(self, code: np.ndarray) -> np.ndarray:
        """The next row's place, times 2, plus 1 if a phrase starts with this byte: for each state and code."""
        link, length, step, last = [-1], [0], [{}], 0
        for c in code.tolist():
            cur = len(step)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = cur
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    new = len(step)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    step.append(dict(step[q]))
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = new
                        p = link[p]
                    link[q] = link[cur] = new
            last = cur
        w = self.width
        table = np.full((len(step), w), -1, np.int32)
        for s, t in enumerate(step):
            if t:
                table[s, list(t)] = list(t.values())
        root = np.maximum(table[0], 0)  # a byte that never occurs is a phrase of its own
        out = np.where(table >= 0, table * w * 2, root * w * 2 + 1).astype(np.int32)
        out[0] |= 1  # what leaves the root starts a phrase
        return out.ravel()

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases of each text in each language, codes of each text)."""
        code, off = self.squeeze(data, offsets)
        size = np.diff(off)
        n_win = -(-size // WINDOW)
        text = np.repeat(np.arange(len(size)), n_win)
        begin = off[:-1][text] + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win))
        length = np.minimum(WINDOW, off[1:][text] - begin)
        phrases = np.zeros((len(size), len(self.names)), np.int64)
        order = np.argsort(-length, kind="stable")
        for i in range(0, len(order), 4096):
            mine = order[i:i + 4096]
            n = length[mine]
            wide = int(n.max(initial=0))
            pos = begin[mine] + np.arange(wide)[:, None]
            block = code[np.minimum(pos, len(code) - 1)].astype(np.int32)
            live = np.searchsorted(-n, -np.arange(wide), side="left")  # windows longer than each position
            for k, table in enumerate(self.tables):
                state = np.zeros(len(mine), np.int32)
                count = np.zeros(len(mine), np.int64)
                for j in range(wide):
                    m = live[j]
                    x = table[state[:m] + block[j, :m]]
                    count[:m] += x & 1
                    state[:m] = x >> 1
                phrases[:, k] += np.bincount(text[mine], count, len(size)).astype(np.int64)
        return phrases, size


_PARSERS: OrderedDict[tuple, Parser] = OrderedDict()


def parser_of(texts: dict[str, bytes]) -> Parser:
    """Built once per Python worker."""
    key = tuple(sorted(texts.items()))
    if key not in _PARSERS:
        while len(_PARSERS) > 1:
            _PARSERS.popitem(last=False)
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def predict(df: DataFrame, texts: dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` for every row of ``df``, from its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. The score is 1 - (best cost / second best
    cost), 1 if only one language was learned; ties go to the first name. Rows come back as often as they stand in the input.
    """
    def run(batches):
        parser = parser_of(texts) if texts else None
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            some = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices_of(off, SLICE):
                pred, score = np.full(j - i, "und", object), np.zeros(j - i)
                if parser:
                    phrases, size = parser.parse(data[off[i]:off[j]], off[i:j + 1] - off[i])
                    cost = phrases * parser.cost / np.maximum(size, 1)[:, None]
                    best = cost.argmin(1)
                    ranked = np.sort(cost, axis=1)
                    ok = some[i:j].astype(bool) & (size > 0)
                    pred[ok] = np.array(parser.names, object)[best[ok]]
                    margin = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-300) if len(parser.names) > 1 else np.ones(j - i)
                    score[ok] = margin[ok]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score)], ["key", "lang_pred", "score"])

    src = df.select(F.col(key).cast("long").alias("key"), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary").alias("data"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("some"))
    return map_batches(src, run, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def identify(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows where ``learn`` holds and ``lang`` is not null; predict every row's language from its text alone.

    Null keys and texts, repeated rows and other columns are as in ``predict``; rows with a null text teach nothing; without any
    row to learn from, every prediction is ``und``. Empty in, empty out.
    """
    return predict(df, reference_texts(df.where(learn), text, lang, key), key, text)
