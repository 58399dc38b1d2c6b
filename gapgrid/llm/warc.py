"""WARC archives: a writer with revisit records for equal payloads, and a splittable reader.

Archives hold one gzip member per record. A reading task gets a byte range: it looks for the gzip magic from the start of its range on,
accepts a member if its first bytes decode to a record's header, reads member after member, and owns the records
whose members start inside its range (the last may end beyond it).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.llm.common import map_batches, materialize
from gapgrid.llm.files import open_store, publish, shared_folder

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
READ = 1 << 18
HEAD = 1 << 26  # no record's header is longer
LEVEL = 1
# Names and forms of the WARC/1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = "null" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {re.sub(r'[\s\x00-\x1f]', lambda m: '%%%02X' % ord(m[0]) if ord(m[0]) < 128 else '', url or '')}",
            f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame, payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload as bytes) with ``refers_to``: the largest page_id with an equal payload, null for that page itself.

    Payloads of fewer than ``least`` bytes are never revisits. Null payloads are empty. Null page ids are never referred to;
    in a group without any id, and for rows that repeat the largest id, ``refers_to`` is null. Payloads are matched by SHA-256;
    only digests are grouped, minima and maxima before the shuffle, and the join back may be split where a payload is frequent.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    groups = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "top"), "equal-payloads")
    return p.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """One archive per partition of ``records`` (page_id, url, payload, refers_to); returns (path, n_records) once written.

    An attempt writes under a name of its own and renames the file when it is complete, so a repeated task does no harm.
    """
    def run(batches):
        store, root = open_store(folder)
        ctx = TaskContext.get()
        final = f"{root}/part-{ctx.partitionId():05d}.warc.gz"
        attempt = f"{root}/_attempt-{ctx.taskAttemptId()}"
        store.create_dir(root, recursive=True)
        n = 0
        with store.open_output_stream(attempt, compression=None) as out:
            for batch in batches:
                page, url, payload, refers = batch.columns
                for i in range(batch.num_rows):
                    to = refers[i].as_py()
                    out.write(record("response" if to is None else "revisit", page[i].as_py(), url[i].as_py(), payload[i].as_py(), to))
                    n += 1
        publish(store, attempt, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], ["path", "n_records"])

    return materialize(map_batches(records.select("page_id", "url", "payload", "refers_to"), run, "path string, n_records long"), "warc-files")


class Members:
    """Gzip members of a file from a position on, at most ``READ`` compressed bytes ahead."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""
        file.seek(at)

    def _more(self) -> bool:
        x = self.file.read(READ)
        self.held += x
        return bool(x)

    def find(self, end: int) -> int | None:
        """Move to the first valid member that starts before ``end``; its position."""
        while self.at < end:
            i = self.held.find(MAGIC)
            if i < 0:
                keep = min(len(self.held), len(MAGIC) - 1)
                self.at += len(self.held) - keep
                self.held = self.held[len(self.held) - keep:]
                if not self._more():
                    return None
                continue
            self.at += i
            self.held = self.held[i:]
            if self.at >= end:
                return None
            if self.valid():
                return self.at
            self.at += 1
            self.held = self.held[1:]
        return None

    def valid(self) -> bool:
        """Whether the member here decodes to a WARC header."""
        z, head, used = zlib.decompressobj(31), b"", 0
        while True:
            piece = self.held[used:used + 4096]
            if not piece:
                if not self._more():
                    return False
                continue
            used += len(piece)
            try:
                head += z.decompress(piece, HEAD - len(head))
            except zlib.error:
                return False
            if len(head) >= 5 and not head.startswith(b"WARC/"):
                return False
            if b"\r\n\r\n" in head:
                names = head[:head.index(b"\r\n\r\n")].lower()
                return b"\r\nwarc-record-id:" in names and b"\r\ncontent-length:" in names
            if z.eof or len(head) >= HEAD:
                return False

    def read(self) -> bytes | None:
        """Content of the member here, and move behind it; None at the end of the file. A member that breaks off is an error."""
        if not self.held and not self._more():
            return None
        z, out = zlib.decompressobj(31), []
        while True:
            out.append(z.decompress(self.held))
            if z.eof:
                self.at += len(self.held) - len(z.unused_data)
                self.held = z.unused_data
                return b"".join(out)
            self.at += len(self.held)
            self.held = b""
            if not self._more():
                raise ValueError("the archive ends inside a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload (what follows the block's own HTTP header) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[:int(fields["content-length"])]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return fields, block


def read_warc(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """Records of all archives of a folder: page_id, url, record_type, payload (null for revisits), payload_digest, refers_to.

    A response whose payload doesn't match its digest is an error. ``split`` is the length of a task's byte range. Empty archives give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    n = max(1, parts.count())

    def number(urn: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(m[1]) if m else None

    def run(batches):
        for batch in batches:
            for path, length, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = open_store(path)
                end, rows, held = min(start + split, length), [], 0
                with store.open_input_file(name) as f:
                    members = Members(f, start, length)
                    here = members.find(end)
                    while here is not None and here < end:
                        raw = members.read()
                        if raw is None:
                            break
                        h, payload = parse(raw)
                        kind = h.get("warc-type", "")
                        rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, None if kind == "revisit" else payload,
                                     h.get("warc-payload-digest", "").removeprefix("sha1:"), number(h.get("warc-refers-to"))))
                        if kind == "response" and rows[-1][4] != sha1_base32(payload):
                            raise ValueError(f"{path}: the payload at {here} does not match its digest")
                        held += len(payload)
                        here = members.at
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    def table(rows):
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "record_type", "payload", "payload_digest", "refers_to"])

    return map_batches(parts.repartition(n), run, "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long")


def archive_round_trip(pages: DataFrame, least: int = 0, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    One row per page, repeated and null ids too. A revisit's
    length is that of the response it refers to.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)  # also without any task
    write_warc(with_revisits(pages, least=least), folder)
    back = read_warc(spark, folder, split).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
    back = materialize(back, "warc-read")
    length = back.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("__n"))
    seen = back.where("record_type = 'revisit'").drop("payload_bytes").join(length, ["refers_to", "payload_digest"], "left").withColumnRenamed("__n", "payload_bytes")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return back.where("record_type = 'response'").select(*cols).unionByName(seen.select(*cols))
