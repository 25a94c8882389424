"""Media columns: a Spark data source over folders of archives.

`media_archive` writes rows (key, media) as members of ZIP archives, stored without further compression, and reads them
back: the driver lists archives and cuts them into byte ranges of RANGE; a task reads an archive's directory, takes the
members whose headers start in its range, fetches each by its offset and streams batches of payloads through Arrow. A
member that fails is fetched again by itself, on a new handle, up to TRIES times, and is checked against its CRC.

A text's bytes become 8-bit grey samples of a lossless PNG, SIDE wide; the number of bytes without padding stands in a
tEXt chunk. Archives get new names in each attempt; only the manifest, written on commit, makes them count.

Nulls: a null text is empty, like "" a picture of one row of zeros; a null key is kept. Repeated rows are members of their
own, of equal bytes and features. Very long texts are tall pictures. An empty table writes none. Only doc_id and text are
read, whatever other columns are called.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

SIDE = 64
LEVEL = 4
RANGE = 64 << 20
ARCHIVE = 256 << 20
TRIES = 3
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512
SCHEMA = "key long, media binary"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """payload: a positive multiple of SIDE bytes."""
    rows = len(payload) // SIDE
    scan = np.zeros((rows, SIDE + 1), np.uint8)
    scan[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, SIDE)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", SIDE, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """The samples and n_bytes of what to_png has made."""
    at, n_bytes, packed = len(SIGNATURE), 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk does not match its CRC")
        if kind == b"tEXt" and data.startswith(b"n_bytes\0"):
            n_bytes = int(data[8:])
        elif kind == b"IDAT":
            packed.append(data)
        at += size + 12
    scan = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, SIDE + 1)
    return scan[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy and mean step of the samples."""
    a = np.frombuffer(payload, np.uint8)
    n = np.bincount(a, minlength=256)
    p = n[n > 0] / len(a)
    step = np.abs(np.diff(a.astype(np.int16))).mean() if len(a) > 1 else 0.0
    return f"{a.mean():.4f},{a.std():.4f},{-(p * np.log2(p)).sum():.4f},{step:.4f}"


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = common.filesystem(self.folder)
        done, pack, name, out, size, n = [], None, "", None, 0, 0
        for b in iterator:
            for key, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if pack is None:
                    name, size, n = f"{uuid.uuid4().hex}.zip", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    pack = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = media.as_py() or b""
                pack.writestr(f"{n:08d}.{'null' if key is None else key}.png", data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE or n >= 60_000:
                    pack.close()
                    out.close()
                    done.append((name, fs.get_file_info(f"{base}/{name}").size))
                    pack = None
        if pack is not None:
            pack.close()
            out.close()
            done.append((name, fs.get_file_info(f"{base}/{name}").size))
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, base = common.filesystem(self.folder)
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        """What an attempt has left is in no manifest."""


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, size: int) -> None:
        self.folder, self.size = folder, size

    def partitions(self) -> list[Range]:
        from pyarrow.fs import FileSelector

        fs, base = common.filesystem(self.folder)
        found = []
        for f in fs.get_file_info(FileSelector(base)):
            if f.base_name.startswith("manifest-"):
                with fs.open_input_stream(f.path) as x:
                    found += [Range(name, at, min(at + self.size, n)) for name, n in json.loads(x.read()) for at in range(0, n, self.size)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = common.filesystem(self.folder)
        path = f"{base}/{partition.archive}"
        with zipfile.ZipFile(fs.open_input_file(path)) as z:
            members = sorted((m.header_offset, m.compress_size, m.CRC, m.filename) for m in z.infolist() if partition.start <= m.header_offset < partition.end)
        handle = fs.open_input_file(path)
        keys, media, held = [], [], 0
        for offset, size, crc, name in members:
            for left in reversed(range(TRIES)):
                try:
                    data = fetched(handle, offset, size, crc)
                    break
                except (OSError, ValueError):
                    if not left:
                        raise
                    time.sleep(0.1 * (TRIES - left))
                    handle = fs.open_input_file(path)
            key = name.split(".")[1]
            keys.append(None if key == "null" else int(key))
            media.append(data)
            held += size
            if held >= BATCH_BYTES or len(keys) >= BATCH_ROWS:
                yield _batch(keys, media)
                keys, media, held = [], [], 0
        if keys:
            yield _batch(keys, media)


def _batch(keys: list, media: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(media, pa.binary())], ["key", "media"])


def fetched(handle, offset: int, size: int, crc: int) -> bytes:
    """One member by the offset of its header."""
    handle.seek(offset)
    head = handle.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError(f"no member at {offset}")
    handle.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = handle.read(size)
    if zlib.crc32(data) != crc:
        raise ValueError(f"the member at {offset} does not match its CRC")
    return data


class MediaArchive(DataSource):
    """Options: path (a URI that executors reach), range (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def encoded(docs: DataFrame) -> DataFrame:
    """key, media (PNG) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                raw = t.as_py() or b""
                out.append(to_png(raw + bytes((-len(raw)) % SIDE if raw else SIDE), len(raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["key", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """From stored media only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = m.as_py()
                payload, n = from_png(m)
                rows.append((key, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), sha256(m).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    folder = common.new_folder(spark, "media")
    encoded(common.table(spark, sf_dir, "documents")).write.format("media_archive").mode("append").option("path", folder).save()
    return features(spark.read.format("media_archive").option("path", folder).load())
