"""WARC archives: a writer, and a reader whose tasks each own a byte range.

A task scans its range for gzip magic and accepts a member only if the bytes inflate
to a WARC header; it then follows members from end to end and owns every record that
starts inside the range, reading past the range's end to finish the last. So a file
is read by as many tasks as it has ranges, without an index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, new_path, stage
from tessera.llm.files import Attempt, filesystem

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20  # of an archive, about
RANGE_BYTES = 8 << 20  # that one reading task owns
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "path string, offset long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record_id(page_id: int | None) -> str:
    """A page's record id; ``page_of`` gives the page back."""
    return f"<urn:uuid:{uuid.UUID(int=(page_id + (1 << 63)) if page_id is not None else 1 << 64)}>"


def page_of(field: str | None) -> int | None:
    number = uuid.UUID(field.strip("<>")).int if field else 1 << 64
    return None if number >= 1 << 64 else number - (1 << 63)


def member(kind: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def dedupe_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of pages with equal payloads of at
    least ``min_bytes`` the largest page_id is referred to by the others. Counts are
    pre-aggregated by digest, and a digest that very many pages share is split by the
    join."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    )
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("nullif(last, page_id)").alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a gzip member per row of ``pages`` (page_id, url, html) into archives in
    ``folder`` (one or more a task, of about FILE_BYTES) and return (path, length).

    A null html is an empty payload; a null url leaves out the target; a null page_id
    is written without number and is never referred to, unless equal payloads have
    no other, when all are responses. Rows that share the largest page_id are all
    responses. An empty table gives no archive. The result is staged, so the
    archives are written when this returns."""

    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = Attempt(folder, f"pages-{part:06d}-{number:05d}.warc.gz")
                    out.write(member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{number}')}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                payload, revisit = row["payload"], row["refers_to"] is not None
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                headers = [("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if row["url"] is not None:
                    headers.append(("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A")))
                if revisit:
                    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"]))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                out.write(member("revisit" if revisit else "response", headers, http if revisit else http + payload, level))
                if out.at >= FILE_BYTES:
                    size, path = out.at, out.close()
                    out, number = None, number + 1
                    yield pa.record_batch({"path": [path], "length": pa.array([size], pa.int64())})
        if out is not None:
            size, path = out.at, out.close()
            yield pa.record_batch({"path": [path], "length": pa.array([size], pa.int64())})

    return stage(dedupe_payloads(pages, min_bytes).mapInArrow(run, "path string, length long"), "warc-files")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class RangeScanner:
    """Records whose gzip member starts in [start, end) of an open file."""

    STEP = 1 << 20

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.start, self.end = file, size, start, end
        self.at, self.buffer = start, b""

    def bytes_at(self, offset: int, least: int) -> bytes:
        """At least ``least`` bytes from ``offset`` on, fewer at the file's end."""
        have = self.at + len(self.buffer)
        if not self.at <= offset <= have:
            self.at, self.buffer = offset, b""
        elif offset > self.at:
            self.buffer, self.at = self.buffer[offset - self.at :], offset
        while len(self.buffer) < least and self.at + len(self.buffer) < self.size:
            self.buffer += self.file.read_at(min(self.STEP, self.size - self.at - len(self.buffer)), self.at + len(self.buffer))
        return self.buffer

    def inflate(self, offset: int) -> tuple[bytes, int] | None:
        """The member at ``offset`` and where it ends; None if no WARC record is there."""
        unpacker, out, at, checked = zlib.decompressobj(31), [], offset, False
        while True:
            data = self.bytes_at(at, 4096)
            if not data:
                return None
            try:
                out.append(unpacker.decompress(data))
            except zlib.error:
                return None
            if not checked and (sum(map(len, out)) >= 7 or unpacker.eof):
                if not b"".join(out).startswith(b"WARC/1."):
                    return None
                checked = True
            at += len(data) - len(unpacker.unused_data)
            if unpacker.eof:
                return b"".join(out), at

    def records(self) -> Iterator[tuple[int, bytes]]:
        offset = self.start
        while offset < self.end:
            data = self.bytes_at(offset, self.STEP)
            hit = data.find(MAGIC)
            if hit < 0:
                if offset + len(data) >= self.size:
                    return
                offset += max(1, len(data) - len(MAGIC) + 1)
                continue
            offset += hit
            if offset >= self.end:
                return
            found = self.inflate(offset)
            if found is None:
                offset += 1
                continue
            yield offset, found[0]
            offset = found[1]


def parse(record: bytes) -> dict | None:
    """Fields of a response or revisit record; None for records of other types."""
    head, _, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    kind = warc.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    size = len(payload) if kind == "response" else int(fields(http).get("content-length", 0))
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else warc.get("warc-payload-digest", "").removeprefix("sha1:")
    return {"page_id": page_of(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": kind, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": page_of(warc.get("warc-refers-to"))}


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Response and revisit records of the archives ``files`` (path, length), one row
    each: path, offset, page_id, url, record_type, payload (null for revisits),
    payload_bytes and payload_digest of the full payload, refers_to.

    Digests of responses are computed from the payload read. No archive gives no
    rows; bytes between members that are no record are passed over."""
    spark = files.sparkSession
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {range_bytes}L)")).alias("start"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for offset, record in RangeScanner(file, row["length"], row["start"], min(row["start"] + range_bytes, row["length"])).records():
                        if found := parse(record):
                            rows.append(found | {"path": row["path"], "offset": offset})
                            held += len(record)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(parts, "path", "start").mapInArrow(run, READ_SCHEMA)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files under ``path``, by metadata alone."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# five hex digits of a SHA-1 are four letters of base 32
_LETTERS = "list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INT >> (15 - 5 * (k % 4))) & 31)::INT, 1))"
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
     g AS (SELECT page_id, payload, h, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, array_to_string({_LETTERS}, '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
