"""WARC in seekable Zstandard bundles.

Each task writes archives of at most BUNDLE bytes of records. Records are grouped into independent frames of about FRAME
bytes; a skippable frame at the end holds the seek table (compressed and plain size of each frame), as in the seekable
format of Zstandard. The index maps a record's identifier to archive, frame, and the record's offset and length in the
plain frame, so one record costs a read of the table and one of a frame.

Of equal payloads of at least `least` bytes that of the smallest page_id is a response; the others are revisits, which
keep the HTTP head (with the length) and the payload's digest but not the payload. Only digests are shuffled to find
them; a writing task looks its rows up, by file and row number, in a list of revisits in the shared folder. Tables that
are no Parquet files are written as such first.

Files get names of their own for each attempt of a task, and only the index, which is written as a table, names those
that count: a lost executor's files are never read. They lie in the shared folder and go when the application ends.

Nulls: a null html is empty, a null url is left out, a null page_id is written as "null" and is larger than others.
Repeated rows with the smallest page_id are all responses. Very long payloads have a frame of their own. An empty table
gives no archive and an empty result. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 1 << 20
BUNDLE = 256 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
#: The seekable format's skippable frame, and the end of its table.
SKIPPABLE, TABLE_END = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, archive string, frame int, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    x = name.strip("<>").rpartition(":")[2]
    return None if x == "null" else int(x)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    body = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    said = fields["WARC-Payload-Digest"].partition(":")[2]
    n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    if kind == "response" and (len(payload) != n or digest(payload) != said):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": _id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": _id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload_digest": said, "payload_bytes": n, "payload": payload if kind == "response" else None}


class Archive:
    """Writes one archive to a binary stream."""

    def __init__(self, out) -> None:
        import zstandard

        self.out, self.frames, self.held, self.size, self.plain = out, [], [], 0, 0
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame, and offset in it."""
        if self.size and self.size + len(raw) > FRAME:
            self.end_frame()
        at = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        self.plain += len(raw)
        return at

    def end_frame(self) -> None:
        if self.held:
            z = self.squeeze(b"".join(self.held))
            self.out.write(z)
            self.frames.append((len(z), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, TABLE_END)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Frames of one archive by number, through its seek table."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, size = file, file.size()
        file.seek(size - 9)
        n, _, end = struct.unpack("<IBI", file.read(9))
        if end != TABLE_END:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        table = file.read(8 * n)
        self.at, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.at.append((at, packed, plain))
            at += packed
        self.expand = zstandard.ZstdDecompressor().decompress

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.at[k]
        self.file.seek(at)
        return self.expand(self.file.read(packed), max_output_size=plain)


@dataclass(frozen=True)
class Plan:
    """rows: page_id, url, payload, and the place of each row. revisits: places of revisits, with the page that each revisits."""

    rows: DataFrame
    revisits: common.Marks


def planned(pages: DataFrame, least: int = 0) -> Plan:
    """Which rows are revisits, and of which page. Only digests and places of rows move; payloads stay where they are read."""
    p = common.located(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "warc-pages").withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    narrow = common.written(p.filter(F.octet_length("payload") >= least).select("file", "row", "page_id", F.unhex(F.sha1("payload")).alias("sha")), "warc-digests")
    firsts = common.written(narrow.groupBy("sha").agg(F.min("page_id").alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND value IS NOT NULL"), "warc-firsts")
    revisits = common.mark(common.written(common.hot_join(narrow, firsts, "sha").filter(~F.col("page_id").eqNullSafe(F.col("value"))).select("file", "row", "value"), "warc-again"), "warc-revisits")
    return Plan(p.select("page_id", "url", "payload", "file", "row", revisits.bucket()), revisits)


def write(plan: Plan, folder: str) -> DataFrame:
    """Writes archives to the folder (a URI that executors can write); returns their index."""
    revisits = plan.revisits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        archive, name, look = None, "", common.Lookup(revisits)
        for b in batches:
            rows = []
            for page_id, url, payload, file, at, bucket in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(fs.open_output_stream(f"{base}/{name}", compression=None))
                raw = record(page_id, url, payload, look.of(file, at, bucket))
                frame, offset = archive.add(raw)
                rows.append((page_id, name, frame, offset, len(raw)))
                if archive.plain >= BUNDLE:
                    archive.close()
                    archive = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "archive", "frame", "offset", "length"])
        if archive is not None:
            archive.close()

    return common.written(plan.rows.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index rows name. Rows of a frame that follow each other cost one read of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        opened, reader, shown, plain = None, None, None, b""
        for b in batches:
            out = []
            for name, frame, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != opened:
                    reader, opened, shown = Reader(fs.open_input_file(f"{base}/{name}")), name, None
                if frame != shown:
                    plain, shown = reader.frame(frame), frame
                out.append(parsed(plain[offset : offset + length]))
                if not payloads:
                    out[-1]["payload"] = None
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    return index.select("archive", "frame", "offset", "length").mapInArrow(run, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    index = write(planned(common.table(spark, sf_dir, "pages")), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
