"""Exact SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A model's merges are ordered by score, so a sequence of pieces is the encoding of its text exactly if every piece encodes to
itself and every two neighbours stay apart when their text is merged again from its characters. The encoder walks a text
from the left: Aho-Corasick gives the longest piece at each position; a piece is taken if it is compatible with the one before
and the position behind it is not known to fail; else its next shorter prefix is tried, and when none is left the position is marked
as failed in a bitfield and the piece before is taken back. Every position fails once at most, so the walk is linear.

No piece spans a space and what stands before it, so a text is cut at spaces, and words between letters and the characters that no piece
holds beside a letter (found from the pieces); equal parts are encoded once per worker, within the caches' bounds.
Runs of spaces are the only pieces with equal scores, the lowest of all: what the word leaves of the run is filled from the left.
"""

from __future__ import annotations

import codecs
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.bpe import spread
from gapgrid.llm.common import map_batches

MARK = "▁"
#: Characters of a text that are cut into words at a time, rows' characters per result batch, and what the caches of a worker hold.
BLOCK = 1 << 20
CACHED_WORDS, CACHED_LETTERS, CACHED_PAIRS = 1 << 19, 64, 1 << 20

codecs.register_error("one-by-one", lambda e: ("�", e.start + 1))


class Words(dict):
    """Ids of words, encoded when they are first asked for; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(word)
        if len(word) <= CACHED_LETTERS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _filled(n: int, lengths: set[int]) -> list[int]:
    """Lengths of the pieces that a run of ``n`` marks merges to when all merges are equal: the leftmost possible pair, again and again."""
    parts = [1] * n
    while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in lengths), -1)) >= 0:
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return parts


class PieceModel:
    """A SentencePiece BPE model with byte fallback whose normaliser only writes spaces as marks and puts one before a text.

    Raises ``ValueError`` for models that this way of encoding doesn't cover: another normaliser, user-defined or unused pieces,
    marks inside of pieces, letters that are no pieces themselves, or equal scores of other pieces than runs of marks.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if (norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.treat_whitespace_as_suffix or train.model_type != 2 or not train.byte_fallback):
            raise ValueError("only byte-pair models with byte fallback and an identity normaliser are covered")
        self.size = len(model.pieces)
        self.texts = [p.piece for p in model.pieces]
        normal = [i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not covered")
        self.end = next(i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL and p.piece == (train.eos_piece or "</s>"))
        runs = {len(self.texts[i]): i for i in normal if set(self.texts[i]) == {MARK}}
        self.longest_run = max(runs)
        self.mark = runs[1]
        plain = [i for i in normal if i == self.mark or i not in runs.values()]
        self.ids = {self.texts[i]: i for i in plain}
        made = [i for i in plain if len(self.texts[i]) > 1]
        scores = {model.pieces[i].score for i in made}
        low = {model.pieces[i].score for k, i in runs.items() if k > 1}
        if len(scores) < len(made) or len(low) > 1 or low and max(low) >= min(scores):
            raise ValueError("equal scores are covered for runs of marks only")
        if any(MARK in t[1:] or not set(t) <= self.ids.keys() for t in self.ids):
            raise ValueError("pieces with inner marks or unknown letters are not covered")
        self.runs = [[runs[k] for k in _filled(n, set(runs))] for n in range(2 * self.longest_run + 1)]
        if any(self.runs[n] != self.runs[self.longest_run] + self.runs[n - self.longest_run] for n in range(self.longest_run, len(self.runs))):
            raise ValueError("runs of marks that don't repeat are not covered")
        self.score = [p.score for p in model.pieces]
        self.bytes = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:-1], 16)] = i
        # the longest piece that is a proper prefix, and the automaton of all pieces
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
            self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
        self.automaton.make_automaton()
        self.width = [len(t) for t in self.texts]
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        # between a letter and such a character every piece ends, so words are cut there
        letter = re.compile(r"[^\W\d_]").match
        near = {c for t in self.ids for x, y in zip(t, t[1:]) for c in (x, y) if bool(letter(x)) != bool(letter(y))}
        alone = "".join(c for c in map(chr, range(128)) if not letter(c) and c not in near)
        self.cut = re.compile(rf"(?<=[^\W\d_])(?=[{re.escape(alone)}])|(?<=[{re.escape(alone)}])(?=[^\W\d_])")
        self.words, self.parts = Words(self._word), Words(self._part)
        # decoding: the bytes of every id
        out = []
        for p in model.pieces:
            if p.type == kinds.BYTE:
                out.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type == kinds.CONTROL:
                out.append(b"")
            elif p.type == kinds.UNKNOWN:
                out.append((train.unk_surface or " ⁇ ").encode())
            else:
                out.append(p.piece.replace(MARK, " ").encode())
        self.lengths = np.array([len(x) for x in out], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.marked = np.array([p.type == kinds.NORMAL and p.piece[0] == MARK for p in model.pieces])

    def merge(self, text: str) -> tuple[list[str], int]:
        """Parts of ``text`` by merging from its letters, the pair of highest score (then the leftmost) first, and where the last merge met."""
        parts, met = list(text), 0
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts, met
            met = len(parts[at])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces that make piece ``i`` last; (-1, -1) for a letter, None if its text doesn't merge to it."""
        if i not in self.split:
            t = self.texts[i]
            parts, met = self.merge(t)
            self.split[i] = None if len(parts) > 1 else (self.ids[t[:met]], self.ids[t[met:]]) if met else (-1, -1)
        return self.split[i]

    def apart(self, a: int, b: int) -> bool:
        """Whether two pieces stay as they are when their text is merged again.

        The merges that made them are undone from the last to the first. At each step the two parts that meet must not make a piece
        that scores higher than the merge just undone, or it would have come before; with an equal score the left one comes first.
        """
        if self.halves(a) is None or self.halves(b) is None:
            return False
        limit, left_last = None, False
        while True:
            i = self.ids.get(self.texts[a] + self.texts[b])
            if i is not None and (limit is None or self.score[i] > limit or self.score[i] == limit and not left_last):
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha[0] < 0 and hb[0] < 0:
                return True
            left_last = hb[0] < 0 or ha[0] >= 0 and self.score[a] < self.score[b]
            if left_last:
                limit, a = self.score[a], ha[1]
            else:
                limit, b = self.score[b], hb[0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` can follow ``a``, which is -1 at the beginning and after a letter without a piece."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a * self.size + b] = self.apart(a, b) if a >= 0 else self.halves(b) is not None
        return ok

    def backtrack(self, text: str) -> list[int]:
        """Pieces of ``text``; a letter without a piece is ``size`` + its code point."""
        n = len(text)
        longest = array("i", [-1]) * n
        width, shorter, size, known = self.width, self.shorter, self.size, self.pairs.get
        for stop, i in self.automaton.iter(text):
            longest[stop + 1 - width[i]] = i  # later ends are longer matches
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            if token < 0:
                token = size + ord(text[at])
            if token < size:
                stop, fits = at + width[token], known(last * size + token)
                if fits is None:
                    fits = self.compatible(last, token)
            else:
                stop, fits = at + 1, True
            if fits and not failed[stop >> 3] >> (stop & 7) & 1:
                taken.append(token)
                if stop == n:
                    return taken
                at, last, token = stop, token if token < size else -1, longest[stop]
                continue
            token = shorter[token] if token < size else -1
            if token < 0:  # nothing fits here: back to the piece before, which then takes a shorter one as its end has failed
                failed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                at -= width[token] if token < size else 1
                last = taken[-1] if taken and taken[-1] < size else -1

    def _part(self, text: str) -> bytes:
        ids = array("i")
        for t in self.backtrack(text):
            if t < self.size:
                ids.append(t)
            else:
                ids.extend(self.bytes[b] for b in chr(t - self.size).encode())
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        parts = self.cut.split(MARK + word)
        return b"".join(map(self.parts.__getitem__, parts)) if len(parts) > 1 else self.parts[parts[0]]

    def _run(self, n: int) -> bytes:
        top = self.longest_run
        return array("i", self.runs[top] * (n // top) + self.runs[n % top]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit numbers, without an end id."""
        if not text:
            return b""
        text = text.replace(MARK, " ")
        lone = array("i", [self.mark]).tobytes()
        out, spaces, at = [], 0, 0
        while at >= 0:
            cut = text.find(" ", at + BLOCK)
            words = (text[at:cut] if cut >= 0 else text[at:]).split(" ")
            at = cut + 1 if cut >= 0 else -1
            if not spaces and "" not in words:
                out.extend(map(self.words.__getitem__, words))
                continue
            for w in words:
                if not w:
                    spaces += 1
                    continue
                ids = self.words[w]
                if spaces:
                    if ids.startswith(lone):
                        spaces, ids = spaces + 1, ids[4:]
                    out.append(self._run(spaces))
                    spaces = 0
                out.append(ids)
        if spaces:
            out.append(self._run(spaces))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library's ``decode`` gives it: controls vanish, one mark at the beginning too, bytes that are no UTF-8 are
        replaced one by one."""
        raw = self.flat[spread(self.first[ids], self.lengths[ids])].tobytes()
        seen = np.flatnonzero(~self.control[ids])
        if len(seen) and self.marked[ids[seen[0]]]:
            raw = raw[1:]
        return raw.decode("utf-8", "one-by-one")


@lru_cache(2)
def model_of(path: str) -> PieceModel:
    """Built once per Python worker."""
    return PieceModel(path)


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text, with the end id behind it unless ``end`` is false.

    A null text counts as empty (the end id alone). Null keys and repeated rows stay, one row each; other columns are
    ignored; an empty table gives an empty one. A task holds the ids of one batch of about ``BLOCK`` characters or of one longer text.
    """
    def run(batches):
        model = model_of(path)
        tail = array("i", [model.end]).tobytes() if end else b""

        def packed(keys, own):
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in own])]), pa.int32())
            ids = pa.Array.from_buffers(pa.int32(), sum(map(len, own)) // 4, [None, pa.py_buffer(b"".join(own))])
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, ids)], ["key", "ids"])

        for batch in batches:
            own, held, start = [], 0, 0
            for k in range(len(batch)):
                t = batch.column(1)[k].as_py()
                own.append(model.encode(t) + tail)
                held += len(t)
                if held >= BLOCK:
                    yield packed(batch.column(0).slice(start, k + 1 - start), own)
                    own, held, start = [], 0, k + 1
            if own:
                yield packed(batch.column(0).slice(start), own)

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return map_batches(src, run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``text``, what the ids decode to; null ids decode to an empty text, an id outside of the model is an error.

    Null keys and repeated rows stay, one row each; other columns are ignored; an empty table gives an empty one.
    """
    def run(batches):
        model = model_of(path)
        for batch in batches:
            lists = batch.column(1)
            flat, off = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            if len(flat) and not 0 <= flat.min() <= flat.max() < model.size:
                raise ValueError("ids outside of the model")
            start = 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(off, off[start] + BLOCK, side="right")) - 1)
                texts = pa.array([model.decode(flat[a:b]) for a, b in zip(off[start:stop], off[start + 1:stop + 1])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists.slice(start, stop - start), texts], ["key", "ids", "text"])
                start = stop

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    return map_batches(src, run, "key long, ids array<int>, text string").withColumnsRenamed({"key": key, "ids": "ids"})
