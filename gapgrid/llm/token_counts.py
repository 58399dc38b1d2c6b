"""Token counts of whole texts, huge ones encoded in overlapping chunks that are spliced where the tokens provably agree.

A chunk's ids are turned into offsets. Where two neighbouring chunks both end a token in their overlap, the left chunk's
tokens before the cut and the right chunk's tokens from it on are joined if the two tokens that meet stay apart when they
are encoded together: each part is then a canonical encoding, and so is the whole, since byte-pair merges between
neighbours are decided pair by pair. The pair checked at last is the pair that meets: the next chunk starts at the cut and its encoding
may begin with another token than the overlap's, so the token before the cut is held against the first token of the encoding that is counted.
If no cut of an overlap passes, the overlap is doubled; if a pair that meets would merge, chunks and overlaps are, at last to the whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.llm.common import map_batches

CHUNK = 1 << 15
OVERLAP = 256


class PieceTokens:
    """A sentencepiece BPE model whose normaliser is the identity but for the space mark and the mark put before a text."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        model.normalizer_spec.add_dummy_prefix = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size())]
        # bytes that an id stands for; the mark counts as the one byte of a space
        self.lengths = np.array([1 if self.whole.is_byte(i) else len(p.replace(self.MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)

    def encode_many(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.whole.encode(texts, num_threads=1)]

    def encode(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the byte offsets at which they end (the mark before the text counts from -1)."""
        ids = np.array((self.whole if first else self.inner).encode(text), np.int64)
        ends = np.cumsum(self.lengths[ids]) - (1 if first and len(ids) else 0)
        if len(ids) and ends[-1] != len(text.encode()):
            raise ValueError("the model's normaliser is not the identity")
        return ids, ends

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay apart if encoded together."""
        try:
            text, n = (left + right).decode(), len(left)
        except UnicodeDecodeError:
            return False  # a cut inside a character is no cut
        return n in self.encode(text, False)[1] if left and right else True


@lru_cache(2)
def tokens_of(path: str) -> PieceTokens:
    return PieceTokens(path)


def count_tokens(tok: PieceTokens, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of ids of ``text``, holding the ids of one chunk at a time."""
    text = text.replace(tok.MARK, " ")  # the model reads both as the same mark
    meets = None  # the token before ``at``
    total, at = 0, 0  # ids of text[:at] are counted, and a token ends at ``at``
    while at < len(text):
        size = chunk
        ids, ends, cut = None, None, None
        lap = overlap
        while cut is None:
            end = min(len(text), at + size)
            left = text[at:end]
            ids, ends = tok.encode(left, at == 0)
            if end == len(text):
                break
            lap_at = max(0, len(left) - lap)
            cut = splice(tok, left, ids, ends, lap_at, text[at + lap_at:end + lap])
            if cut is None:
                lap *= 2
                size = max(size, 2 * lap)
        if meets is not None and not tok.apart(meets, left.encode()[:int(ends[0])]):
            return count_tokens(tok, text, 2 * chunk, 2 * overlap)
        if cut is None:
            return total + len(ids)
        n, chars = cut
        meets = left.encode()[max(0, int(ends[n - 2])) if n > 1 else 0:int(ends[n - 1])]
        total += n
        at += chars
    return total


def splice(tok: PieceTokens, left: str, ids: np.ndarray, ends: np.ndarray, lap_at: int, right: str) -> tuple[int, int] | None:
    """(ids before the cut, characters before the cut) for the last proven common boundary in the overlap ``left[lap_at:]``.

    ``right`` is the text from ``lap_at`` on, reaching past the end of ``left``.
    """
    raw, base = left.encode(), len(left[:lap_at].encode())
    right_raw = right.encode()
    _, r_ends = tok.encode(right, False)
    common = np.intersect1d(ends, np.concatenate([[0], r_ends]) + base)
    common = common[(common > base) & (common < len(raw))]
    for c in common[::-1]:
        if raw[c] & 0xC0 == 0x80:
            continue
        i = int(np.searchsorted(ends, c))
        j = int(np.searchsorted(r_ends, c - base, side="right"))
        before = raw[max(0, int(ends[i - 1])) if i else 0:c]
        after = right_raw[c - base:int(r_ends[j])]
        if tok.apart(before, after):
            return i + 1, len(raw[:c].decode())
    return None


def token_counts(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) of every row's whole text.

    A null text counts as empty. Rows come back as often as they stand in the input, null keys too; other columns are
    ignored. A task holds one batch of texts and the ids of a few short texts or of one chunk.
    """
    def run(batches):
        tok = tokens_of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, few, size = [0] * len(texts), [], 0
            for i, t in enumerate(texts):
                if len(t) > CHUNK:
                    n[i] = count_tokens(tok, t)
                elif t:
                    few.append(i)
                    size += len(t)
                if few and (size > 1 << 20 or i == len(texts) - 1):
                    for k, m in zip(few, tok.encode_many([texts[k] for k in few])):
                        n[k] = m
                    few, size = [], 0
            if few:
                for k, m in zip(few, tok.encode_many([texts[k] for k in few])):
                    n[k] = m
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    src = df.select(F.col(key).cast("long").alias("key"), t.alias("t"), F.octet_length(t).cast("long").alias("n_bytes"))
    return (map_batches(src, run, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", key)
            .withColumn("over_limit", F.col("n_tokens") > limit))
