"""Byte-level BPE: encoding and decoding of whole texts in numpy, batch by batch.

Texts are cut into pieces by character classes, equal pieces of a batch are merged once, and the distinct pieces are
encoded as padded matrices, one per length class: in each round every row merges its leftmost pair of minimum rank, found
in an open-addressed table of token pairs, and rows are compacted. Rows of over ``SHORT`` bytes merge all
occurrences of that pair in one round where no pair so created ranks below it (then the result is the same); otherwise they
merge one, too. Memory is bounded by ``SLICE`` bytes of text (or the longest single text) per step.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import frugal, map_batches, slices_of, text_bytes, utf8_column

# The pattern that this implementation follows, and the endings it cuts off after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SHORT = 64
SLICE = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (p + 0x800 * (p >= 0xD800) for p in m.span())
            out[a:b] = kind
    return out


def piece_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a piece of the pattern starts; ``offsets`` are the starts of the texts (n + 1) in characters."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    last, first = first[1:], first[:-1]
    kind = char_classes()[cp]
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[first] = 255
    space, blank = kind == SPACE, cp == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank[first] = False
    start = (kind != prev) & (space | ~after_blank)
    ends = np.zeros(n, bool)  # last character of a white-space run that text follows
    ends[:-1] = space[:-1] & ~space[1:]
    start |= ends & ~last
    i = np.flatnonzero((cp == 39) & start)
    if len(i):
        end = offsets[np.searchsorted(offsets, i, side="right")]
        at = lambda k: np.where(i + k < end, cp[np.minimum(i + k, n - 1)], 0)
        a, b = at(1), at(2)
        two = np.zeros(len(i), bool)
        for x in ENDINGS_2:
            two |= (a == ord(x[0])) & (b == ord(x[1]))
        one = np.isin(a, [ord(x) for x in ENDINGS_1])
        start[i[one | two] + 1] = False
        past = i + 1 + np.where(one, 1, 2)
        past = past[(one | two) & (past < end)]
        start[past] = True
    return start


class Ranks:
    """A rank file as arrays: a hash table from token pairs to ranks, and the bytes of every token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, r in ranks.items():
            tokens[r] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        a, b, r = np.array(pairs, np.int64).reshape(-1, 3).T
        self.shift = np.uint64(64 - max(4, int(4 * len(a)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        keys, at = a << 32 | b, self._slot(a << 32 | b)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = r[done]
            keys, r, at = keys[~done], r[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that the pair makes, ``NONE`` where there is none or a side is padding (-1)."""
        keys = (a.astype(np.int64) << 32 | b.astype(np.int64)).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        out[(found != keys)] = NONE
        todo = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found >= 0)
            todo, at = todo[go], at[go]
        return out.reshape(a.shape)

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of padded rows of byte ids (-1 fills the ends), flat in row order, and the number of ids per row."""
        n, width = rows.shape
        count = (rows >= 0).sum(1)
        result = np.full((n, width), -1, np.int32)
        live, ids = np.arange(n), rows.copy()
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), np.int32)
        many = width > SHORT
        while len(live):
            low = rank.min(1, initial=NONE)
            done = low == NONE
            if done.any():
                result[live[done], :ids.shape[1]] = ids[done]
                go = ~done
                live, ids, rank, low = live[go], ids[go], rank[go], low[go]
                if not len(live):
                    break
                w = max(2, int(count[live].max()))
                ids, rank = ids[:, :w], rank[:, :w - 1]
            if many:
                ids, rank, count[live] = self._merge_all(ids, rank, low)
            else:
                k, row = rank.argmin(1), np.arange(len(live))
                col = np.arange(ids.shape[1] - 1)
                ids[row, k] = low
                moved = np.where(col > k[:, None], ids[:, 1:], ids[:, :-1])
                ids = np.concatenate([moved, np.full((len(live), 1), -1, np.int32)], 1)
                if rank.shape[1] > 1:
                    tail = np.where(col[:-1] >= k[:, None], rank[:, 1:], rank[:, :-1])
                    rank = np.concatenate([tail, np.full((len(live), 1), NONE, np.int32)], 1)
                else:
                    rank = np.full_like(rank, NONE)
                last = ids.shape[1] - 1
                a, b = ids[row, k], ids[row, np.minimum(k + 1, last)]
                rank[row, np.minimum(k, last - 1)] = np.where(k < last, self.pair_ranks(a, b), NONE)
                left = np.maximum(k - 1, 0)
                rank[row, left] = np.where(k > 0, self.pair_ranks(ids[row, left], a), rank[row, left])
                count[live] -= 1
        return result[result >= 0], count

    def _merge_all(self, ids, rank, low):
        n, w = ids.shape
        hit = rank == low[:, None]
        # of a run of overlapping hits every second one merges, from the left
        col = np.arange(w - 1)
        since = np.maximum.accumulate(np.where(hit, -1, col), 1)
        take = hit & ((col - since) % 2 == 1)
        for once in (False, True):
            if once:  # a new pair ranks below: such rows merge their leftmost pair only
                first = np.zeros_like(take)
                first[np.arange(n), hit.argmax(1)] = True
                take = np.where(bad[:, None], first, take)
            new = ids.copy()
            r, c = np.nonzero(take)
            new[r, c] = low[r]
            new[r, c + 1] = -2
            keep = new >= 0
            size = keep.sum(1)
            out = np.full((n, max(2, int(size.max()))), -1, np.int32)
            out[np.arange(out.shape[1]) < size[:, None]] = new[keep]
            ranks = self.pair_ranks(out[:, :-1], out[:, 1:])
            bad = ranks.min(1) < low
            if not bad.any():
                break
        return out, ranks, size

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte ranges, flat in their order, and the number of ids of each."""
        n = len(start)
        counts, parts, where = np.zeros(n, np.int64), [], []
        edges = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, SHORT]
        top = int(length.max(initial=1))
        while edges[-1] < top:
            edges.append(edges[-1] * 2)
        bucket = np.searchsorted(edges, length)
        for b, width in enumerate(edges):
            mine = np.flatnonzero(bucket == b)
            step = max(1, (1 << 20) // width)
            for k in range(0, len(mine), step):
                at = mine[k:k + step]
                cols = np.arange(width)
                pos = np.minimum(start[at][:, None] + cols, len(data) - 1)
                rows = np.where(cols < length[at][:, None], self.byte_id[data[pos]], np.int32(-1))
                ids, counts[at] = self.merge(rows)
                parts.append(ids)
                where.append(at)
        if not parts:
            return np.empty(0, np.int32), counts
        flat, order = np.concatenate(parts), np.concatenate(where)
        first = np.empty(n, np.int64)
        first[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
        return flat[spread(first, counts)], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, only_count: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts (bytes and n + 1 offsets), flat in order (none with ``only_count``), and the number of ids of each text."""
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        starts = np.flatnonzero(piece_starts(cp, np.searchsorted(head, offsets)))
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        begin = head[starts]
        length = np.diff(np.append(begin, len(data)))
        one, which = distinct(data, begin, length)
        ids, n = self.encode_pieces(data, begin[one], length[one])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        size = n[which]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(total[np.searchsorted(begin, offsets)])
        return (ids[:0] if only_count else ids[spread(first[which], size)]), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of flat ids, and the n + 1 offsets of the texts they make."""
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[spread(self.first[ids], size)], total[np.concatenate([[0], np.cumsum(counts)])]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[i], first[i] + 1, ... (size[i] of them), one range after the other."""
    total = np.cumsum(size)
    if not len(total) or not total[-1]:
        return np.empty(0, np.int64)
    return np.repeat(first - (total - size), size) + np.arange(total[-1])


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's base; those of a usual slice are kept."""
    global _POWERS
    if n > len(_POWERS):
        p = np.full(max(n, 1 << 16), _ODD)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if n > 2 * SLICE:
            return p[:n]
        _POWERS = p
    return _POWERS[:n]


def distinct(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one piece for each distinct content, and for each piece its place among them.

    Pieces are grouped by a polynomial hash and then compared byte by byte; a piece that only shares a hash stands alone.
    """
    power = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(power[:-1] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    # the same power for equal content: times the power that is left to the end
    h = (sums[begin + length] - sums[begin]) * power[len(data) - begin]
    h ^= h >> np.uint64(29)
    h = h * _ODD + length.astype(np.uint64)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    rep = one[which]
    same = length[rep] == length
    ok = np.flatnonzero(same & (rep != np.arange(len(rep))))
    n = length[ok]
    if len(ok):
        wrong = data[spread(begin[ok], n)] != data[spread(begin[rep[ok]], n)]
        if wrong.any():
            same[np.repeat(ok, n)[wrong]] = False
    odd = np.flatnonzero(~same)
    which[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), which


@lru_cache(4)
def ranks_of(path: str) -> Ranks:
    return Ranks(path)


def encode_batches(path: str, data: np.ndarray, offsets: np.ndarray, only_count: bool = False):
    """(first, last, ids, counts) for runs of rows of bounded size."""
    ranks = ranks_of(path)
    for i, j in slices_of(offsets, SLICE):
        yield i, j, *ranks.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], only_count)


def binary_array(raw: bytes, offsets: np.ndarray) -> pa.Array:
    """The ranges of ``raw`` between n + 1 offsets as a binary column over the same memory (``pa.array`` never frees memoryviews that it is given)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.array(offsets, pa.int32()).buffers()[1], pa.py_buffer(raw)])


def digests(raw: bytes, offsets: np.ndarray) -> pa.Array:
    """SHA-256 of the ranges of ``raw`` between n + 1 offsets."""
    view = memoryview(raw)
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets, offsets[1:])], pa.string())


def _encoded(df: DataFrame, path: str, key: str, text: str, keep_ids: bool) -> DataFrame:
    def run(batches):
        ranks = ranks_of(path)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j, ids, n in encode_batches(path, data, off):
                raw, end = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(n)])
                back, stop = ranks.decode(ids, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), binary_array(raw, end) if keep_ids else digests(raw, end),
                     digests(back.tobytes(), stop)], ["key", "n_tokens", ids_name, "decoded_sha256"])

    ids_name = "ids" if keep_ids else "ids_sha256"
    src = df.select(F.col(key).cast("long").alias("key"), utf8_column(text))
    return map_batches(src, frugal(run), f"key long, n_tokens long, {ids_name} {'binary' if keep_ids else 'string'}, decoded_sha256 string").withColumnRenamed("key", key)


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` of the whole text (little-endian unsigned 32-bit; null text: none), ``decoded_sha256`` of what they decode to.

    Repeated rows and null keys stay as they are, one row each; other columns are ignored; empty in, empty out.
    """
    return _encoded(df, path, key, text, True)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Like ``encode_documents``, with the SHA-256 of the ids in their place (``ids_sha256``)."""
    return _encoded(df, path, key, text, False)


def decode_documents(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``data``, the bytes that the ids stand for; null ids decode to none."""
    def run(batches):
        ranks = ranks_of(path)
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in slices_of(off, SLICE):
                raw, end = ranks.decode(np.frombuffer(data[off[i]:off[j]].tobytes(), "<u4").astype(np.int64), np.diff(off[i:j + 1]) // 4)
                raw = raw.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[a:b] for a, b in zip(end, end[1:])], pa.binary())], ["key", "data"])

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return map_batches(src, run, "key long, data binary").withColumnRenamed("key", key)
