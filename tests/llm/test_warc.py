import hashlib
from base64 import b32encode

from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from curatrix.llm import common, warc

ROWS = [(5, "http://a/1", "same é"), (3, "http://a/2", "same é"), (9, None, "same é"), (3, "http://a/2", "same é"), (1, "u", None), (2, "u", ""), (7, "u", "x" * 3_000_000), (8, "u\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "alone"), (None, "u", "same é")]
SCHEMA = "page_id long, url string, html string"


def round_trip(spark, rows, least=0):
    folder = common.new_folder(spark, "warc")
    index = warc.write(warc.planned(spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit(1)).withColumn("first", F.lit(2)), least), folder)
    return folder, index


def want(rows, least=0):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in raw:
        first = min((j for j, q in raw if q == p and j is not None), default=None)
        to = first if len(p) >= least and first is not None and i != first else None
        out.append((i, len(p), b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


def test_round_trip_against_brute_force(spark):
    for least in (0, 3, 100):
        folder, index = round_trip(spark, ROWS, least)
        got = warc.read(index, folder).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want(ROWS, least)
        text = {i: (h or "").encode() for i, _, h in ROWS if i is not None}
        assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_repeated_payloads_of_a_table(spark, tmp_path, monkeypatch):
    """A third of all pages has one payload, a third are copies; payloads aren't shuffled, and each row finds its role by its place."""
    monkeypatch.setattr(common, "BUCKET", 50)
    monkeypatch.setattr(common, "HOT", 20)
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"copy {i // 9}" if i % 3 == 1 else f"own {i}") for i in range(600, 0, -1)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/pages")
    table = spark.read.parquet(f"{tmp_path}/pages")
    for pages, n in ((table, 600), (table.filter("page_id % 3 > 0"), 400)):
        folder = common.new_folder(spark, "warc")
        plan = warc.planned(pages)
        assert plan.revisits.folder and "Exchange" not in plan.rows._jdf.queryExecution().executedPlan().toString()
        got = warc.read(warc.write(plan, folder), folder).collect()
        assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want([r for r in rows if n == 600 or r[0] % 3])


def test_one_record_by_its_index_row_and_plain_zstd(spark, monkeypatch):
    import zstandard

    rows = [(i, f"http://h/{i}", f"page {i} " * 5000) for i in range(200)]
    folder, index = round_trip(spark, rows)
    one = warc.read(index.filter("page_id = 77"), folder).collect()
    assert [bytes(r.payload) for r in one] == [("page 77 " * 5000).encode()]
    at = index.first()
    fs, base = FileSystem.from_uri(folder)
    reader = warc.Reader(fs.open_input_file(f"{base}/{at.archive}"))
    assert len(reader.at) > 1
    with fs.open_input_file(f"{base}/{at.archive}") as f:  # a reader that knows no seek table skips it
        all_frames = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert all_frames == b"".join(reader.frame(k) for k in range(len(reader.at)))


def test_damage_is_seen(spark):
    raw = warc.record(1, "u", b"payload", None)
    assert warc.parsed(raw)["payload"] == b"payload"
    try:
        warc.parsed(raw.replace(b"payload\r\n", b"paYload\r\n"))
    except ValueError:
        return
    raise AssertionError


def test_empty_table(spark):
    folder, index = round_trip(spark, [])
    assert warc.read(index, folder).count() == 0
