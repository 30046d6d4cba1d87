"""WARC archives: a writer with payload deduplication and a splittable reader.

Every record is a gzip member of its own. Of records with equal payloads of
at least ``min_bytes``, the one with the largest id is written as response,
the others as revisits that refer to it and hold the HTTP header alone. Equal
payloads are found by a grouped maximum over payload hashes (combined before
the shuffle and saved) and a join, which adaptive execution splits where one
payload holds many rows.

The reader takes byte ranges of files. A task looks for the gzip magic in its
range, validates a candidate by decoding its header (it must begin a WARC
record) and then the whole member with its checksum, and owns the records that
start inside the range; the last may end beyond it. After a valid member the
next is expected right behind; where there is none, the search goes on.

A null payload counts as empty; a null url leaves out the target. A record
with a null id is never what others refer to. Rows that share the largest id
are all responses. Files are written through Arrow file systems to the given
folder, which driver and executors must share; each attempt of a task writes
files with names of their own, and only those named in the manifest (itself
committed by Spark) are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import saved

FILE_BYTES = 256 << 20
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
RECORD = ("path string, offset long, record_id string, record_type string, refers_to string, uri string, "
          "payload binary, payload_bytes long, payload_digest string, intact boolean")


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_types(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, uri, payload, record_type, refers_to) from (id, uri, payload)."""
    rows = records.select("id", "uri", F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("hash", F.sha2("payload", 256))
    # saved, so that the join has a shuffle on both sides and a hot payload can be split
    most = saved(rows.groupBy("hash").agg(F.max("id").alias("response_id")))
    again = F.col("response_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("response_id")) & (F.octet_length("payload") >= min_bytes)
    return rows.join(most, "hash").select(
        "id", "uri", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("response_id")).alias("refers_to"))


def record(urn: str, uri: str | None, payload: bytes, kind: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, prefix: str = "urn:page:", date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the output of ``with_types``; the manifest (path, bytes, records)."""
    typed = records.select("id", "uri", F.col("payload").cast("binary"), "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        out = path = None
        size = count = 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            if out is not None:
                out.close()
                done.append((path, size, count))

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in range(5)]
                if out is None or size >= file_bytes:
                    close()
                    name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    path = f"{folder.rstrip('/')}/{name}"
                    out = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                urn = f"<{prefix}{'' if row[0] is None else row[0]}>"
                to = None if row[4] is None else f"<{prefix}{row[4]}>"
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(urn, row[1], row[2], row[3], to, date)) + pack.flush()
                out.write(member)
                size += len(member)
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "bytes", "records"])

    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    typed.mapInArrow(run, "path string, bytes long, records long").write.parquet(folder.rstrip("/") + "/manifest")
    return records.sparkSession.read.parquet(folder.rstrip("/") + "/manifest")


class Window:
    """Bytes of a file from some place on, read as needed."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.size = file, start, b"", file.size()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        self.data += self.file.read(READ_BYTES)
        return True

    def drop(self, at: int) -> None:
        """Forget what lies before ``at``, once that is much."""
        if at - self.base >= READ_BYTES:
            self.data, self.base = self.data[at - self.base:], at

    def magic(self, at: int, end: int) -> int | None:
        """The first gzip magic that starts in [at, end)."""
        while True:
            found = self.data.find(MAGIC, at - self.base)
            if found >= 0:
                return found + self.base if found + self.base < end else None
            at = max(at, self.base + len(self.data) - 2)
            if at >= end or not self.more():
                return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """(content, end) of the member at ``at`` if it is a sound WARC record."""
        unpack, out, fed = zlib.decompressobj(31), [], at
        checked = False
        try:
            while not unpack.eof:
                if fed >= self.base + len(self.data) and not self.more():
                    return None
                chunk = self.data[fed - self.base:fed - self.base + (READ_BYTES if checked else 512)]
                out.append(unpack.decompress(chunk))
                fed += len(chunk)
                if not checked and sum(map(len, out)) >= 7:
                    if not b"".join(out).startswith(b"WARC/1."):
                        return None
                    checked = True
        except zlib.error:
            return None
        return (b"".join(out), fed - len(unpack.unused_data)) if checked else None


def parse(content: bytes) -> dict | None:
    head, gap, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not gap or not fields.get("Content-Length", "").isdigit() or len(rest) != int(fields["Content-Length"]) + 4:
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), len(payload))
    kind = fields.get("WARC-Type")
    said = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    found = digest(payload) if kind == "response" else said
    uri = fields.get("WARC-Target-URI")
    return {"record_id": fields.get("WARC-Record-ID", "").strip("<>"), "record_type": kind, "refers_to": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
            "uri": None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "payload": payload if kind == "response" else None,
            "payload_bytes": len(payload) if kind == "response" else length, "payload_digest": found, "intact": found == said and (kind != "response" or length == len(payload))}


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in [start, end)."""
    window, at = Window(file, start), start
    while (at := window.magic(at, end)) is not None:
        got = window.member(at)
        fields = got and parse(got[0])
        if fields:
            yield at, fields
            at = got[1]
        else:
            at += 1
        window.drop(at)


def read(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files in ``manifest`` (path, bytes), by byte ranges."""
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    n = ranges.count()
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = dict(string=pa.string(), long=pa.int64(), binary=pa.binary(), boolean=pa.bool_())
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in range(3))):
                store, where = file_system(path)
                rows, size = [], 0
                with store.open_input_file(where) as file:
                    for at, fields in records_in(file, start, end):
                        rows.append({"path": path, "offset": at, **fields})
                        size += len(fields["payload"] or b"")
                        if size > BATCH_BYTES or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(max(1, n)).mapInArrow(run, RECORD).select(*names)
