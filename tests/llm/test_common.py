"""The shared folder, places of rows, joins of hot keys."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from curatrix.llm import common


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def test_no_private_folder_on_a_cluster():
    context = SimpleNamespace(master="spark://somewhere:7077", getConf=lambda: Conf())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=Conf(), sparkContext=context))


def test_folders_without_a_scheme_are_hadoops(spark, tmp_path):
    like = SimpleNamespace(conf=Conf({"spark.checkpoint.dir": f"{tmp_path}/shared"}), sparkContext=spark.sparkContext)
    assert common.shared_dir(like) == f"file:{tmp_path}/shared"
    folder = common.new_folder(like, "x")
    fs, base = common.filesystem(folder)
    with fs.open_output_stream(f"{base}/f") as out:
        out.write(b"1")
    assert os.listdir(base) == ["f"] and base.startswith(str(tmp_path))


def test_one_folder_within_one_process(spark):
    context = SimpleNamespace(master="local[2]", getConf=lambda: Conf(), _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
    like = SimpleNamespace(conf=Conf(), sparkContext=context)
    assert common.shared_dir(like) == common.shared_dir(like) and os.path.isdir(common.shared_dir(like).removeprefix("file:"))


def test_schemes():
    assert [common.arrow_uri(x) for x in ("file:/a/b", "file:///a/b", "s3a://k/v", "hdfs://n:8020/a", "gs://k/v")] == ["file:///a/b", "file:///a/b", "s3://k/v", "hdfs://n:8020/a", "gs://k/v"]


def test_hot_keys_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    of = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    of = common.written(of.filter("k != 5"), "of")
    got = common.hot_join(rows, of, "k")
    want = rows.join(of.drop("n"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("k", "id", "top").collect()))
    assert common.hot_join(rows.limit(0), of.limit(0), "k").count() == 0


def test_marks_are_found_by_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BUCKET", 7)
    spark.range(200).repartition(5).write.parquet(f"{tmp_path}/t")
    d = common.located(spark.read.parquet(f"{tmp_path}/t"), "t")
    marked = common.written(d.filter("id % 3 = 0").select("file", "row", F.col("id").alias("value")), "marks")
    marks = common.mark(marked, "marks")
    look = common.Lookup(marks)
    got = {r.id: look.of(r.file, r.row, r.bucket) for r in d.select("id", "file", "row", marks.bucket()).collect()}
    assert marks.buckets > 3 and got == {i: i if i % 3 == 0 else None for i in range(200)}
    none = common.mark(marked.limit(0), "none")
    assert none.folder == "" and common.Lookup(none).of("f", 0, 0) is None


def test_what_is_no_scan_is_written_first(spark, tmp_path):
    spark.range(9).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    for d in (t.unionByName(t), t.join(t, "id"), t.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), spark.range(5)):
        places = [(r.file, r.row) for r in common.located(d, "x").collect()]
        assert len(places) == len(set(places)) == d.count()
