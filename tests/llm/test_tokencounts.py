from array import array

import numpy as np
import pytest

from curatrix.llm import bpe, common
from curatrix.llm import tokencounts as tc


@pytest.mark.parametrize("block", [tc.BLOCK, 64, 2])
def test_counts_against_encoding(spark, docs, rows, block):
    if block == 2:
        docs, rows = docs.filter("doc_id < 20"), [r for r in rows if r[0] is not None and r[0] < 20]
    folder = common.new_folder(spark, "tokens")
    order = tc.write(docs, folder, bpe.default_path())
    own = bpe.load(bpe.default_path())
    got = sorted(str((r.doc_id, r.n_tokens)) for r in tc.count(spark, folder, order, block=block).collect())
    assert got == sorted(str((r[0], len(own.encode_ordinary(r[1])) // 4)) for r in rows)


def test_file_without_last_separator(spark):
    from pyarrow.fs import FileSystem

    folder = common.new_folder(spark, "tokens")
    fs, base = FileSystem.from_uri(folder)
    for name, ids in (("a", [5, 9, 9, 7, 7, 7]), ("b", [9]), ("c", [1, 2, 3])):
        with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(np.array(ids, "<u2").tobytes())
    files = tc.sizes(spark.createDataFrame([(x,) for x in "abc"], "file string"), folder)
    for size in (2, 4, 1 << 20):
        got = tc.stitched(tc.scanned(tc.blocks(spark, folder, files, size), folder, end=9)).collect()
        assert sorted(tuple(r) for r in got) == [("a", 0, 1), ("a", 1, 0), ("a", 2, 3), ("b", 0, 0), ("c", 0, 3)]


def test_small_files_are_rolled(spark, docs, rows, monkeypatch, no_docs):
    folder = common.new_folder(spark, "tokens")
    order = tc.write(docs, folder, bpe.default_path())
    assert order.count() == len(rows) == tc.count(spark, folder, order).count()
    folder = common.new_folder(spark, "tokens")
    assert tc.count(spark, folder, tc.write(no_docs, folder, bpe.default_path())).count() == 0
    assert array("I").itemsize == 4


def test_ids_that_do_not_fit(spark, docs, tmp_path):
    """A vocabulary beyond 16 bits, and a separator that is an ordinary token, are errors and not other numbers."""
    import json

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 70_000, "content": "<|far|>"})
    (tmp_path / "big.json").write_text(json.dumps(spec))
    for path, end in ((f"{tmp_path}/big.json", tc.END), (bpe.default_path(), 5)):
        with pytest.raises(Exception, match="16 bits"):
            tc.write(docs, common.new_folder(spark, "tokens"), path, end)
