"""SimHash fingerprints of word shingles, and groups of near copies by anchor-point covering.

Anchors: a fingerprint is four blocks of 16 bits; for two blocks, the anchor space is the product of two perfect codes
of length 15 (11 free bits each, covering radius 1; the sixteenth bit of a block is left out). Every fingerprint lies within 1
of exactly one codeword per block, its home; words at distance e from it have their homes within 1 + e of it. Of four
distances that sum to 4 at most, the smallest two are (0, 0), (0, 1) or, if all are 1, (1, 1): so replicating a
fingerprint to the anchors within (1, 1) of it, for some ordered block pairs within (1, 2), and for one pair within (2, 2)
brings every linked pair together at a home of one of the two.

Homes are compared first and joined into classes; then fingerprints are replicated with their class, and only links between
different classes come out of the comparison. So a large group of near copies makes few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import map_batches, materialize, slices_of, text_bytes, utf8_column
from gapgrid.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
SLICE = 1 << 20
# Primes of the XXH64 definition.
P1, P2, P3 = np.uint64(11400714785074694791), np.uint64(14029467366897019727), np.uint64(1609587929392839161)
P4, P5 = np.uint64(9650029242287828579), np.uint64(2870177450012600261)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rotl(x, k):
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_ranges(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range of ``data``, ranges of one length together."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8 + (-len(data)) % 8 + 8, np.uint8)])
    word = np.empty(len(padded) - 8 - len(padded) % 8, np.uint64)
    for k in range(8):
        part = padded[k:k + (len(padded) - k) // 8 * 8].view("<u8")
        word[k::8] = part[:len(word[k::8])]
    order = np.argsort(length, kind="stable")
    ends = np.flatnonzero(np.diff(length[order])) + 1
    for mine in np.split(order, ends):
        n = int(length[mine[0]])
        at = start[mine]
        if n > 4096:  # rare; stripes would be longer than the ranges are many
            raw = data.tobytes()
            out[mine] = [xxhash.xxh64_intdigest(raw[a:a + n], seed) for a in at]
            continue
        p = 0
        if n >= 32:
            v = [np.full(len(at), x % (1 << 64), np.uint64) for x in (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))]
            while p + 32 <= n:
                v = [_round(v[i], word[at + (p + 8 * i)]) for i in range(4)]
                p += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.uint64(0), x)) * P1 + P4
        else:
            h = np.full(len(at), (seed + int(P5)) % (1 << 64), np.uint64)
        h = h + np.uint64(n)
        while p + 8 <= n:
            h = _rotl(h ^ _round(np.uint64(0), word[at + p]), 27) * P1 + P4
            p += 8
        if p + 4 <= n:
            h = _rotl(h ^ ((word[at + p] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            p += 4
        while p < n:
            h = _rotl(h ^ (data[at + p].astype(np.uint64) * P5), 11) * P1
            p += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[mine] = h ^ (h >> np.uint64(32))
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
    """(hashes, their texts) of all word shingles, in order and in slices; a text of fewer words is one shingle, one without words none."""
    n_docs = len(offsets) - 1
    white = _WHITE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    word = ~white
    begin = word.copy()
    begin[1:] &= white[:-1] | first[1:-1]
    # texts as words joined by one space: keep word bytes, and one space before each word
    n_out = np.cumsum(word.astype(np.int64) + begin)
    size = int(n_out[-1]) if len(data) else 0
    flat = np.full(size, 32, np.uint8)
    flat[n_out[word] - 1] = _LOWER[data[word]]
    starts = n_out[begin] - 1
    doc = np.searchsorted(offsets, np.flatnonzero(begin), side="right") - 1
    n_words = np.bincount(doc, minlength=n_docs)
    ends = np.append(starts[1:] - 1, size) if len(starts) else starts
    n_sh = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    first_word = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    sh_doc = np.repeat(np.arange(n_docs), n_sh)
    a = np.arange(len(sh_doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + first_word[sh_doc]
    b = np.minimum(a + width, first_word[sh_doc] + n_words[sh_doc]) - 1
    for i in range(0, len(a), 1 << 17):
        s, e, d = starts[a[i:i + (1 << 17)]], ends[b[i:i + (1 << 17)]], sh_doc[i:i + (1 << 17)]
        lo = int(s[0])
        yield xxh64_ranges(flat[lo:int(e.max())], s - lo, e - s), d


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text (bytes and n + 1 offsets)."""
    n_docs = len(offsets) - 1
    counts = np.zeros((n_docs, 64), np.int64)
    n_sh = np.zeros(n_docs, np.int64)
    for h, d in shingle_hashes(data, offsets, width):
        n_sh += np.bincount(d, minlength=n_docs)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1])
        counts[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    on = (2 * counts > n_sh[:, None]).astype(np.uint8)
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``fp``: the fingerprint's bits as a long). Null and blank texts have fingerprint 0."""
    def run(batches):
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            fp = [fingerprints_of(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in slices_of(off, SLICE)]
            fp = np.concatenate(fp).view(np.int64) if fp else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["key", "fp"])

    src = df.select(F.col(key).cast("long").alias("key"), utf8_column(text))
    return map_batches(src, run, "key long, fp long").withColumnRenamed("key", key)


# ---- anchors
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
# (exact block, block that may differ by one): with these, the exact block meets one of any two others that differ by one
ONE_OFF = [(z, (z + k) % 4) for z in range(4) for k in (1, 2)]


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its home codeword's free bits, and those of the other codewords within 2 (-1: none)."""
    v = np.arange(1 << 15)
    syndrome = np.zeros_like(v)
    for i in range(15):
        syndrome ^= np.where(v >> i & 1, i + 1, 0)
    data_bits = [i for i in range(15) if (i + 1) & i]
    free = lambda x: sum((x >> b & 1) << k for k, b in enumerate(data_bits))
    flip = lambda x, i: np.where(i > 0, x ^ (1 << np.maximum(i - 1, 0)), x)
    near = []
    for i in range(1, 16):
        j = i ^ syndrome
        ok = (syndrome > 0) & (j > i)
        near.append(np.where(ok, free(flip(flip(v, np.full_like(v, i)), j)), -1))
    near = -np.sort(-np.stack(near, 1), axis=1)[:, :7]
    return free(flip(v, syndrome)).astype(np.int64), near.astype(np.int64)


_HOME, _NEAR = _code_tables()


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [((u >> np.uint64(16 * k)) & np.uint64(0x7FFF)).astype(np.int64) for k in range(4)]


def home_anchors(fp: np.ndarray) -> np.ndarray:
    """(n, 6) anchors that hold the fingerprints as home."""
    x = [_HOME[b] for b in _blocks(fp)]
    return np.stack([p << 22 | x[a] << 11 | x[b] for p, (a, b) in enumerate(PAIRS)], 1)


def other_anchors(fp: np.ndarray) -> np.ndarray:
    """(n, m) further anchors within covering radius and threshold; -1 where a row has fewer."""
    blocks = _blocks(fp)
    home, near = [_HOME[b] for b in blocks], [_NEAR[b] for b in blocks]
    out = []
    for z, o in ONE_OFF:
        p = PAIRS.index((min(z, o), max(z, o)))
        h, m = home[z][:, None], near[o]
        key = (h << 11 | m) if z < o else (m << 11 | h)
        out.append(np.where(m >= 0, p << 22 | key, -1))
    a, b = near[0][:, :, None], near[1][:, None, :]
    both = np.where((a >= 0) & (b >= 0), a << 11 | b, -1)  # pair 0
    return np.concatenate([*out, both.reshape(len(fp), -1)], 1)


def _cluster(fp: np.ndarray, distance: int):
    """Links (i, j) that connect, and connect only, what links of ``distance`` connect."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = np.bitwise_count(fp[left] ^ fp[i]) <= distance
            if hit.any():
                for j in left[hit]:
                    yield i, j
                    queue.append(j)
                left = left[~hit]


def _runs(batches, columns: int):
    """Arrays of whole runs of equal anchor out of batches sorted by it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:columns]]
        if not len(cols[0]):
            continue
        last = np.searchsorted(cols[0], cols[0][-1])
        if last or (held and held[-1][0][-1] != cols[0][0]):
            parts = [*held, [c[:last] for c in cols]]
            yield [np.concatenate(x) for x in zip(*parts)]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def home_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between fingerprints with a home in common; of each anchor no more than connect its members."""
    def expand(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp).ravel()), pa.array(np.repeat(fp, 6))], ["anchor", "fp"])

    def compare(batches):
        for anchor, fp in _runs(batches, 2):
            u = fp.view(np.uint64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
            size = np.diff(first)
            a, b = [], []
            two = first[:-1][size == 2]
            ok = two[np.bitwise_count(u[two] ^ u[two + 1]) <= distance]
            a.append(fp[ok])
            b.append(fp[ok + 1])
            for k in np.flatnonzero(size > 2):
                mine = fp[first[k]:first[k + 1]]
                ij = np.array(list(_cluster(mine.view(np.uint64), distance)), np.int64).reshape(-1, 2)
                a.append(mine[ij[:, 0]])
                b.append(mine[ij[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = map_batches(fps.select("fp"), expand, "anchor long, fp long")
    return map_batches(rows.repartition("anchor").sortWithinPartitions("anchor"), compare, "a long, b long").distinct()


def class_links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between classes: ``classes`` has (fp, cls), each fingerprint once."""
    def expand(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                fp, cls = part.column(0).to_numpy(), part.column(1).to_numpy()
                far = other_anchors(fp)
                row, col = np.nonzero(far >= 0)
                anchor = np.concatenate([home_anchors(fp).ravel(), far[row, col]])
                home = np.concatenate([np.ones(6 * len(fp), bool), np.zeros(len(row), bool)])
                who = np.concatenate([np.repeat(np.arange(len(fp)), 6), row])
                # the lowest bit tells a home from a visit: homes come first within an anchor
                yield pa.RecordBatch.from_arrays([pa.array(anchor << 1 | ~home), pa.array(fp[who]), pa.array(cls[who])], ["anchor", "fp", "cls"])

    def compare(batches):
        seen: set[tuple[int, int]] = set()
        for place, fp, cls in _runs_of_anchor(batches):
            anchor, u = place >> 1, fp.view(np.uint64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
            last = np.append(first[1:], len(anchor))
            homes = np.add.reduceat((place & 1 == 0).astype(np.int64), first)
            mixed = np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)
            links = []
            go = mixed & (homes > 0) & (last - first > homes)
            f, h, v = first[go], homes[go], (last - first - homes)[go]
            n = h * v
            few = n <= 4096
            if few.any():
                start = np.cumsum(n[few]) - n[few]
                which = np.repeat(np.flatnonzero(few), n[few])
                k = np.arange(len(which)) - np.repeat(start, n[few])
                i, j = f[which] + k // v[which], f[which] + h[which] + k % v[which]
                ok = (cls[i] != cls[j]) & (np.bitwise_count(u[i] ^ u[j]) <= distance)
                links.append((cls[i[ok]], cls[j[ok]]))
            for k in np.flatnonzero(~few):
                vs = slice(f[k] + h[k], f[k] + h[k] + v[k])
                for i in range(f[k], f[k] + h[k]):
                    ok = (cls[vs] != cls[i]) & (np.bitwise_count(u[vs] ^ u[i]) <= distance)
                    if ok.any():
                        other = np.unique(cls[vs][ok])
                        links.append((np.full(len(other), cls[i]), other))
            out = set()
            for a, b in links:
                out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
            out -= seen
            if len(seen) < 1 << 20:
                seen |= out
            ab = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    rows = map_batches(classes.select("fp", "cls"), expand, "anchor long, fp long, cls long")
    by = F.shiftright("anchor", 1)
    return map_batches(rows.repartition(by).sortWithinPartitions("anchor"), compare, "a long, b long").distinct()


def _runs_of_anchor(batches):
    """Like ``_runs``, where the two halves of an anchor stay together."""
    def halved():
        for b in batches:
            place = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(place >> 1), b.column(1), b.column(2), b.column(0)], ["anchor", "fp", "cls", "place"])

    for _, fp, cls, place in _runs(halved(), 4):
        yield place, fp, cls


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest reachable key).

    Texts link if their fingerprints differ in ``distance`` (4 at most) bits or fewer; null, empty and blank texts have fingerprint zero
    and link like any other. Null keys never name a component unless all its keys are null. Repeated rows come back as
    often as they stand in the input; other columns are ignored; empty in, empty out.
    """
    if distance > DISTANCE:
        raise ValueError("the anchors cover four differing bits at most")
    fp = materialize(fingerprints(df, key, text), "fingerprints")
    one = materialize(fp.groupBy("fp").agg(F.min(key).alias("low")), "distinct-fp")
    first = components(home_links(one, distance), "home")
    cls = materialize(one.join(first.withColumnRenamed("node", "fp"), "fp", "left")
                      .select("fp", "low", F.coalesce("component", "fp").alias("cls")), "classes")
    second = components(class_links(cls, distance), "class")
    comp = materialize(cls.join(second.withColumnRenamed("node", "cls"), "cls", "left").select("fp", "low", F.coalesce("component", "cls").alias("cls")), "groups")
    low = comp.groupBy("cls").agg(F.min("low").alias("component_id"))
    named = materialize(comp.join(low, "cls").select("fp", "component_id"), "named")
    return fp.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The row of ``docs`` with the smallest ``doc_id`` of each group; rows without ``doc_id`` stay only in groups without any."""
    groups = near_duplicates(docs, distance=distance)
    keep = materialize(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct(), "near-kept")
    return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
