import json

import pytest
from pyspark.sql import functions as F

from curatrix.plans import from_probe, stage
from curatrix.sources import samples as S
from curatrix.streaming import resume


def lines(path, rows):
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in rows), encoding="utf-8")
    return f"file://{path}"


SAMPLE = {"messages": [{"role": "user", "content": "<image>\nWhat?"}, {"role": "assistant", "content": "Ja é"}], "images": ["a.png"], "metadata": {"sample_id": "s1", "pool_id": "", "point": [1.5, 2.0], "bboxes": [[1, 2, 3, 4]]}}


def test_jsonl_round_trip(spark, tmp_path):
    p = lines(tmp_path / "x.jsonl", [SAMPLE, "", SAMPLE])
    d = S.target_text(S.read_jsonl(spark, p))
    assert [r.target for r in d.collect()] == ["Ja é", "Ja é"] and d.first().metadata.point == [1.5, 2.0]
    bad = lines(tmp_path / "bad.jsonl", [SAMPLE, "{broken"])
    assert S.read_jsonl(spark, bad, bad_lines="drop").select("messages").collect()
    with pytest.raises(Exception):  # noqa: B017
        S.read_jsonl(spark, bad).collect()
    assert S.read_optional(spark, f"file://{tmp_path}/none.jsonl", S.PROBE).count() == 0


def test_pools_and_prompts(spark, tmp_path):
    for pool in ("core", "frag"):
        (tmp_path / pool).mkdir()
        lines(tmp_path / pool / "point.jsonl", [SAMPLE])
    d = S.read_pools(spark, f"file://{tmp_path}")
    assert {r.pool_id for r in d.collect()} == {"core", "frag"}
    r = stage.rewritten_prompts(d, {"k": "Read it."}, "k").first()
    assert r.messages[0].content == "<image>\nRead it." and r.messages[1].content == "Ja é" and r.metadata.prompt_key == "k"
    parts = S.as_openai(d).first().messages[0].content
    assert [(x.type, x.text, x.image) for x in parts] == [("image", None, "a.png"), ("text", "What?", None)]
    with pytest.raises(KeyError):
        stage.rewritten_prompts(d, {}, "k")


def test_blocks_and_bitext(spark, tmp_path):
    (tmp_path / "p1.blocks.json").write_text(json.dumps([{"id": "a", "bbox": [0, 0, 9, 9], "rects": [[0, 0, 1, 9], [0, 0, 9, 9]]}, {"id": "b", "bbox": [1, 1, 2, 2]}]))
    d = {r.id: r for r in S.read_page_blocks(spark, f"file://{tmp_path}/*.blocks.json").collect()}
    assert d["a"].page_id == "p1" and len(d["a"].rects) == 1 and d["b"].rects == []
    a, b = lines(tmp_path / "en", ["one", "two"]), lines(tmp_path / "zh", ["一", "二"])
    assert [tuple(r) for r in S.read_bitext(spark, a, b).orderBy("line").collect()] == [(0, "one", "一"), (1, "two", "二")]


def test_split_sink_and_images(spark, tmp_path):
    d = spark.createDataFrame([("b", "train", ["x.png"]), ("a", "train", ["y.png"]), ("c", "val", ["x.png"])], "ord string, split string, images array<string>")
    S.write_split(d, f"file://{tmp_path}/out")
    got = [json.loads(x)["ord"] for p in (tmp_path / "out" / "split=train").glob("*.json") for x in p.read_text().splitlines()]
    assert got == ["a", "b"]
    files = spark.createDataFrame([("x.png",)], "path string")
    assert {r.path: r.present for r in S.missing_images(d, files).collect()} == {"x.png": True, "y.png": False}
    assert "| hit_rate | 50.0 % |" in S.report_markdown({"hit_rate": 0.5, "n": 3}, "T")


def test_from_probe(spark):
    rows = spark.createDataFrame([(f"s{i}", f"p{i % 3}") for i in range(9)], "sample_id string, page_id string")
    scored = spark.createDataFrame([(f"s{i}", False, 0.5, 0.2, 1.0, 0.1, "signal") for i in range(6)] + [("gone", False, 0.5, 0.2, 1.0, 0.1, "signal")], "sample_id string, is_negative boolean, frac_good double, reward_std double, reward_max double, value double, verdict string")
    got = from_probe.chosen(rows, scored, 3, 1).collect()
    assert len({r.page_id for r in got}) == 3 and from_probe.unmatched(rows, scored).first().n == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "1.json", [{"k": "a", "v": 1.0, "t": 1}, {"k": "b", "v": 3.0, "t": 2}])
    src = f"file://{tmp_path}/in"
    out = f"file://{tmp_path}/out"
    for _ in range(2):
        resume.pending_batch(resume.new_rows(spark, src, "k string, v double, t int"), out, "k", lambda d: d.withColumn("done", F.lit(True)), f"file://{tmp_path}/ck").awaitTermination()
        lines(tmp_path / "in" / "2.json", [{"k": "b", "v": 9.0, "t": 3}, {"k": "c", "v": 5.0, "t": 4}])
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1.0), ("b", 3.0), ("c", 5.0)]
    resume.rolling_summary(resume.new_rows(spark, src, "k string, v double, t int"), "k", "v", "t", f"{out}2", f"file://{tmp_path}/ck2").awaitTermination()
    assert {r.k: (r.n, r["mean"]) for r in spark.read.parquet(f"{out}2").collect()} == {"a": (1, 1.0), "b": (2, 6.0), "c": (1, 5.0)}
    assert resume.reached(spark.read.parquet(out), 3) and not resume.reached(spark.read.parquet(out), 4)
