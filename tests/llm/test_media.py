import zlib
from hashlib import sha256

import pytest
from pyarrow.fs import FileSystem

from curatrix.llm import common, media


def stored(spark, docs, size=None):
    spark.dataSource.register(media.MediaArchive)
    folder = common.new_folder(spark, "media")
    media.encoded(docs).write.format("media_archive").mode("append").option("path", folder).save()
    read = spark.read.format("media_archive").option("path", folder)
    return folder, (read.option("range", size) if size else read).load()


def test_rows_against_brute_force(spark, docs, rows, no_docs):
    for size in (None, 700):
        _, found = stored(spark, docs, size)
        got = media.features(found).collect()
        want = []
        for r in rows:
            raw = (r[1] or "").encode()
            p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
            m = media.to_png(p, len(raw))
            want.append((r[0], len(raw), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), sha256(m).hexdigest(), media.feature(p)))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert media.features(stored(spark, no_docs)[1]).count() == 0


def test_members_are_retried_alone(tmp_path, spark, docs, monkeypatch):
    folder, _ = stored(spark, docs)
    reader = media.ArchiveReader(folder, media.RANGE)
    fails = iter([True, True, False] + [False] * 1000)
    plain = media.fetched

    def flaky(*a):
        if next(fails):
            raise OSError("lost")
        return plain(*a)

    monkeypatch.setattr(media, "fetched", flaky)
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == docs.count()


def test_damage_is_seen(spark, docs):
    folder, _ = stored(spark, docs)
    fs, base = FileSystem.from_uri(folder)
    p = media.ArchiveReader(folder, media.RANGE).partitions()[0]
    raw = bytearray(fs.open_input_file(f"{base}/{p.archive}").read())
    raw[100] ^= 255
    with fs.open_output_stream(f"{base}/{p.archive}", compression=None) as out:
        out.write(bytes(raw))
    with pytest.raises((ValueError, OSError)):
        list(media.ArchiveReader(folder, media.RANGE).read(p))


def test_archives_of_failed_attempts_are_not_read(spark, docs):
    folder, found = stored(spark, docs)
    fs, base = FileSystem.from_uri(folder)
    with fs.open_output_stream(f"{base}/left-over.zip", compression=None) as out:
        out.write(b"half an archive")
    assert found.count() == docs.count()
