"""Training-order materialisation: token ids packed into sequences, permuted by a keyed Feistel network, written as fixed-stride shards.

Each split of the input is a stream of ids (its texts in order, each followed by an end mark), cut every ``length`` ids; its
last sequence is filled up. A split with b bytes can't hold more than a known number of sequences, since an id stands for a byte
at least, so every sequence has a number of its own before anything is encoded. A keyed permutation of these numbers
(Feistel network, walked until it falls below their count) gives each sequence its key, and its global slot is its
rank by key: ranges of keys are the partitions that write the shards, and the slots of a shard follow from the sizes of those
before it. Slot t of a shard stands at byte (t - first slot) * stride, so any slot range is one seek and one sequential
read per shard, and a stopped run resumes at its slot. Texts are encoded once and shuffled once, nothing is stored in between.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapgrid.llm.bpe import encode_batches
from gapgrid.llm.common import map_batches, materialize, text_bytes, utf8_column
from gapgrid.llm.files import open_store, publish, shared_folder

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 .. n - 1 chosen by ``key``: a Feistel network on the next even number of bits, walked until it falls below n."""

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _round(self, r: int, x: np.ndarray) -> np.ndarray:
        salt = int.from_bytes(hashlib.sha256(f"{self.key}:{r}".encode()).digest()[:8], "little")
        return _mix(x ^ np.uint64(salt)) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        b, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> b, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(r, left), left
            else:
                left, right = right, left ^ self._round(r, right)
        return left << b | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = self._once(out[far], back)
            far = far[out[far] >= self.n]
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """``length`` ids per sequence (little-endian unsigned 16-bit), ``shard`` sequences per file; ``end`` follows each text, ``pad`` fills the last sequence."""

    length: int = 1024
    shard: int = 8192
    end: int = 50256
    pad: int = 65535

    @property
    def stride(self) -> int:
        return 2 * self.length


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(utf8_column(text))


def part_bounds(df: DataFrame, layout: Layout, text: str = "text") -> np.ndarray:
    """Where the sequence numbers of every split start, and their count: one number per task reaches the driver.

    A text of b bytes has at most b ids and an end mark.
    """
    n = F.octet_length(F.col(text))
    rows = _texts(df, text).groupBy(F.spark_partition_id().alias("part")).agg(F.sum(n + (n > 0).cast("int")).cast("long").alias("n")).collect()
    most = np.zeros(max([r.part for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        most[r.part] = -(-r.n // layout.length)
    return np.concatenate([[0], np.cumsum(most)])


def write_shards(df: DataFrame, ranks: str, folder: str, layout: Layout, key: int, text: str = "text") -> DataFrame:
    """Write the shards; manifest: shard, path, first_slot, n_sequences, sha256, sequences (their numbers in order).

    Texts that are null or empty add nothing. Both passes over the input read the same splits; a split that outgrows its numbers is an error.
    """
    base = part_bounds(df, layout, text)
    total = int(base[-1])
    perm = Permutation(total, key)
    length, shard = layout.length, layout.shard
    n_parts = max(1, -(-total // (2 * shard)))  # an id stands for two bytes or more as a rule

    def cut(batches):
        """(place, key, sequence, ids) of the sequences of this split."""
        part = TaskContext.get().partitionId()
        number, end = (int(base[part]), int(base[part + 1])) if part < len(base) - 1 else (0, 0)
        rest = np.empty(0, "<u2")

        def rows(flat: np.ndarray):
            nonlocal number
            n = len(flat) // length
            if number + n > end:
                raise ValueError(f"split {part} has changed between the two passes")
            numbers = np.arange(number, number + n)
            number += n
            keys = perm.slot(numbers)
            ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), n, [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array((keys * n_parts // total).astype(np.int32)), pa.array(keys), pa.array(numbers), ids], ["place", "key", "sequence", "ids"])

        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for _, _, ids, n in encode_batches(ranks, data, off):
                if not len(ids):
                    continue
                if ids.max() >= layout.end:
                    raise ValueError("ids reach the end mark")
                m = n + (n > 0)
                flat = np.full(len(rest) + int(m.sum()), layout.end, "<u2")
                flat[:len(rest)] = rest
                own = np.ones(len(flat) - len(rest), bool)
                own[np.cumsum(m)[n > 0] - 1] = False
                flat[len(rest):][own] = ids
                whole = len(flat) // length * length
                rest = flat[whole:]
                if whole:
                    yield rows(flat[:whole])
        if len(rest):
            yield rows(np.concatenate([rest, np.full(length - len(rest), layout.pad, "<u2")]))

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        place, out, n_files, attempt, digest, held = None, None, 0, "", None, []

        def close():
            nonlocal out, n_files
            out.close()
            out = None
            final = f"{root}/shard-{place:06d}-{n_files:04d}.bin"
            n_files += 1
            publish(store, attempt, final)
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n_files - 1], pa.int32()), pa.array([final]), pa.array([len(held)], pa.int64()),
                                               pa.array([digest.hexdigest()]), pa.array([list(held)], pa.list_(pa.int64()))], ["place", "file", "path", "n_sequences", "sha256", "sequences"])

        for batch in batches:
            for at, number, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if out is not None and (at != place or len(held) == shard):
                    yield close()
                if at != place:
                    place, n_files = at, 0
                if out is None:
                    attempt = f"{root}/_attempt-{TaskContext.get().taskAttemptId()}-{place}-{n_files}"
                    out, digest, held = store.open_output_stream(attempt, compression=None), hashlib.sha256(), []
                raw = ids.as_buffer()
                out.write(raw)
                digest.update(raw)
                held.append(number)
        if out is not None:
            yield close()

    pieces = map_batches(_texts(df, text), cut, "place int, key long, sequence long, ids binary")
    ordered = pieces.repartitionById(n_parts, F.col("place")).sortWithinPartitions("key").select("place", "sequence", "ids")
    written = materialize(map_batches(ordered, write, "place int, file int, path string, n_sequences long, sha256 string, sequences array<long>"), "shards")
    # one row per shard: the slots of a shard follow those before it
    w = Window.orderBy("place", "file")
    before = F.coalesce(F.sum("n_sequences").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = written.select("path", (F.row_number().over(w) - 1).cast("long").alias("shard"), before.cast("long").alias("first_slot"))
    return materialize(written.join(index, "path").select("shard", "path", "first_slot", "n_sequences", "sha256", "sequences"), "manifest")


def read_slots(manifest: DataFrame, layout: Layout, first: int = 0, end: int | None = None) -> DataFrame:
    """(slot, sequence, shard, byte_offset, ids) of the slots from ``first`` to before ``end``; shards outside are not opened."""
    def run(batches):
        for batch in batches:
            for shard, path, slot, n, numbers in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = open_store(path)
                a, b = max(first, slot), slot + n if end is None else min(end, slot + n)
                with store.open_input_file(name) as f:
                    f.seek((a - slot) * layout.stride)
                    while a < b:
                        k = min(b - a, 512)
                        raw = f.read(k * layout.stride)
                        at = np.arange(a, a + k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(at), pa.array(numbers[a - slot:a - slot + k], pa.int64()), pa.array(np.full(k, shard)), pa.array((at - slot) * layout.stride),
                             pa.array([raw[i * layout.stride:(i + 1) * layout.stride] for i in range(k)], pa.binary())], ["slot", "sequence", "shard", "byte_offset", "ids"])
                        a += k

    rows = manifest.where(F.col("first_slot") + F.col("n_sequences") > first)
    if end is not None:
        rows = rows.where(F.col("first_slot") < end)
    return map_batches(rows.select("shard", "path", "first_slot", "n_sequences", "sequences"), run, "slot long, sequence long, shard long, byte_offset long, ids binary")


def training_order(df: DataFrame, ranks: str, layout: Layout = Layout(), key: int = 42, folder: str | None = None, text: str = "text") -> DataFrame:
    """Write the shards and read them back: slot, sequence, shard, byte_offset, n_tokens, ids_sha256 (of the stride's bytes).

    Every id of every text stands in exactly one slot; the last sequence of a split is filled with ``pad``. Repeated rows count
    like any other; null and empty texts add nothing; without any id there are no shards. Other columns are ignored.
    """
    spark: SparkSession = df.sparkSession
    manifest = write_shards(df, ranks, folder or shared_folder(spark, "shards"), layout, key, text)

    def run(batches):
        for batch in batches:
            raw = batch.column(4).to_pylist()
            n_tokens = [int((np.frombuffer(x, "<u2") != layout.pad).sum()) for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_tokens, pa.int32()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])],
                                             ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_sha256"])

    # shards are few rows; deal them out evenly
    shards = manifest.repartition(max(1, spark.sparkContext.defaultParallelism))
    return map_batches(read_slots(shards, layout), run, "slot long, sequence long, shard long, byte_offset long, n_tokens int, ids_sha256 string")
