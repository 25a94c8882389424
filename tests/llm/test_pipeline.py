import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from curatrix.llm import bpe, common, packing


def test_stages_decide_and_keep(spark, tmp_path_factory):
    base = " ".join(f"wort{i} gut" for i in range(60))
    rows = [(1, base), (2, base), (3, base + " ende"), (4, "12 34"), (5, None), (6, "ganz anderer text mit vielen eigenen worten hier und dort"), (None, "ohne nummer aber mit text genug")]
    rows += [(100 + i, f"freundlicher satz nummer {i} mit worten {i * 7} und noch mehr {i * 13} davon " * 3) for i in range(60)]
    rows += [(300 + i, f"du scheusal nummer {i} scheusal {i * 5} satz {i * 3} mit worten") for i in range(60)]
    docs = spark.createDataFrame([(k, t, "de", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int("scheusal" in (t or ""))) for k, t in rows if k and k >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    d = cp.toxicity_stage(spark, docs, sf)
    kept = {r.doc_id for r in d.collect()}
    assert d.columns == cp.COLUMNS and kept == {k for k, t in rows if "scheusal" not in (t or "")}
    d = cp.language_stage(spark, d, sf)
    assert d.columns == cp.COLUMNS and {r.doc_id for r in d.collect()} == kept - {4, 5}
    d = cp.near_dedup_stage(spark, d, sf)
    left = {r.doc_id for r in d.collect()}
    assert d.columns == cp.COLUMNS and 1 in left and not left & {2, 3} and {6, None} <= left
    out = cp.packing_stage(spark, d, sf)
    assert {r.doc_id for r in out.collect()} == left

    whole = cp.run(spark, sf)
    assert whole.agg(F.sum("length")).first()[0] == packing.pieces(d, bpe.default_path()).agg(F.sum("length")).first()[0]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Also where ids are missing or stand for different texts; rows of files and others alike."""
    text = lambda s: " ".join(f"{s}{i} wort" for i in range(80))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (5, text("b")), (5, text("c")), (5, text("c")), (7, text("d")), (7, text("d")), (2, text("c")), (9, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, None, "s", 1, "x") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, file string").repartition(3)
    got = cp.near_dedup_stage(spark, docs, "")
    assert got.columns == cp.COLUMNS
    assert sorted(str((r.doc_id, (r.text or "")[:2])) for r in got.collect()) == sorted(map(str, [(None, "a0"), (5, "b0"), (2, "c0"), (7, "d0"), (8, "")]))
    many = spark.createDataFrame([(i, text(f"h{i % 40}" if i % 3 else "hot"), None, None, None) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_dedup_stage(spark, common.written(many.repartition(4), "many"), "").collect()) == sorted({min(i for i in range(900) if (f"h{i % 40}" if i % 3 else "hot") == k) for k in {f"h{i % 40}" if i % 3 else "hot" for i in range(900)}})


def test_language_stage_keeps_short_clean_texts_and_rejects_other_languages(spark):
    rng = random.Random(3)
    words = {"de": "der die und nicht eine straße haus wieder gegangen schnell über berge zeit machen".split(), "en": "the and not house street again went quickly over mountains time make some other".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 40))), k, "s", 1) for i in range(400) for k in [rng.choice(["de", "en"])]]
    odd = [(1000, "sytuacja gospodarcza kraju poprawiła się dzięki nowym środkom przyjętym", None, "s", 1), (1001, "экономика страны", None, "s", 1), (1002, "12 !", None, "s", 1), (1003, None, None, "s", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.language_stage(spark, docs, "").collect()} == set(range(400))


def test_stages_take_repeated_rows_and_columns_of_results_names(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"guter satz nummer {i} mit worten {i * 3}" + (" scheusal" if i % 4 == 0 else ""), "de", "s", 1) for i in range(80)]
    rows += [rows[1], rows[1], (None, "satz ohne nummer mit worten", None, None, None), (5, "", None, None, None), (5, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "predicted", "lang_pred", "support", "fp", "file", "row", "bucket", "component_id", "number"):
        d = d.withColumn(c, F.lit("x"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    clean = [r for r in rows if "scheusal" not in (r[1] or "")]
    kept = cp.toxicity_stage(spark, d, sf)
    assert kept.columns == cp.COLUMNS and sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(clean, kept.schema).collect()))
    said = cp.language_stage(spark, d, sf)
    assert said.columns == cp.COLUMNS and said.count() == len(rows) - 2
    assert cp.near_dedup_stage(spark, d, sf).columns == cp.COLUMNS
    assert cp.packing_stage(spark, d, sf).count() == len(rows)


def test_empty_table(spark, no_docs, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d = no_docs
    for _, stage in cp.STAGES:
        d = stage(spark, d, sf)
        assert d.count() == 0
