import hashlib
import re

from pyspark.sql import functions as F

from curatrix.llm import fingerprints as fp


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    """Sections of paragraphs of leaves, said plainly."""
    sections = re.findall(r"(?s).+?(?:\n[ \t\r]*\n\s*|\Z)", text, re.ASCII) if text else [""]
    assert "".join(sections) == text
    out = []
    for s in sections:
        out.append([])
        for p in s.split("\n"):
            out[-1].append(leaves := [x for part, n in ((p[:60], 12), (p[60:], 48)) for x in re.findall(rf"[^.!?]{{1,{n}}}[.!?]*\s*|[.!?]+\s*", part, re.ASCII)])
            assert "".join(leaves) == p
    return out


def plain_fingerprint(text):
    root, said = "", []
    for s in plain_tree(text):
        digests = [sha("".join(map(sha, p))) for p in s]
        root += sha("".join(digests))
        said.append(",".join(f"{d[:16]}.{''.join(sha(x)[:8] for x in p)}" for d, p in zip(digests, s, strict=True)))
    return f"{sha(root)}/{';'.join(said)}"


def plain_likeness(f, g):
    a, b, m = {*f.split("/")[1].split(";")}, {*g.split("/")[1].split(";")}, 0
    m += sum((len(p) - 17) // 8 for s in a & b for p in s.split(","))
    a, b = ({p for s in x - y for p in s.split(",")} for x, y in ((a, b), (b, a)))
    m += sum((len(p) - 17) // 8 for p in a & b)
    a, b = ({p[17:][i : i + 8] for p in x - y for i in range(0, len(p) - 17, 8)} for x, y in ((a, b), (b, a)))
    m += len(a & b)
    n = 2 * m + len(a ^ b)
    return 2 * m / n if n else float(f == g)


def held(found, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        f, ef, nf = map(plain_fingerprint, (t, e, nxt))
        want.append((r[0], len(t), sha(e), f, ef, round(plain_likeness(f, ef), 9), round(plain_likeness(f, nf), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_all_columns_against_brute_force(docs, rows):
    held(fp.edits(docs).collect(), rows)


def test_null_and_repeated_ids_are_spread_and_in_order(spark):
    """Two thirds of the rows have no id or one id; no bucket holds much more than its share, and each row's next one is right."""
    rows = [(None, f"{i * 7919 % 997:03d} free.\n\nlines {i}") for i in range(300)] + [(7, f"{i * 31 % 211:03d} same {i}\n") for i in range(300)] + [(i, f"own {i} a. b.") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held(fp.edits(d).collect(), rows)
    k, q = fp._place(F.col("doc_id"), F.col("text"))
    sizes = [r["count"] for r in d.groupBy(fp._bucket(k, q, fp._edges(d, k, q, 32)[:-1]).alias("b")).count().collect()]
    assert len(sizes) > 24 and max(sizes) < 5 * 900 / 32
    held(fp.edits(d.filter("doc_id IS NULL")).collect(), rows[:300])


def test_ids_beyond_53_bits(spark):
    rows = [((1 << 62) + i, f"text {i * 37 % 101}") for i in range(200)] + [(-(1 << 63) + i, f"low {i}") for i in range(20)]
    held(fp.edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_edits_against_brute_force(docs, rows):
    found = sorted((r.asDict() for r in fp.edits(docs).collect()), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    # Descending ids, nulls last; equal ids in order of the text.
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    assert len(found) == len(rows)
    want = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((r[0], len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in found)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)


def test_equal_texts_have_equal_fingerprints(docs):
    d = fp.fingerprint(docs)
    n = d.select(F.coalesce("text", F.lit("")).alias("t"), "fingerprint").distinct()
    assert n.count() == n.select("t").distinct().count() == n.select("fingerprint").distinct().count()


def test_differing_paragraphs_are_located(spark):
    a, b = "one.\ntwo.\n\nthree.", "one.\ntwo!\n\nthree."
    d = spark.createDataFrame([(a, b)], "a string, b string")
    d = fp.fingerprint(fp.fingerprint(d, "a", "fa"), "b", "fb")
    assert d.select(fp.differing("fa", "fb")).first()[0] == [[0, 1]]
    assert d.select(fp.differing("fa", "fa")).first()[0] == []


def test_one_row_and_none(spark, no_docs):
    assert fp.edits(no_docs).count() == 0
    one = spark.createDataFrame([(5, "ab", 1)], "doc_id long, text string, x int")
    assert fp.edits(one).first().edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_likeness_falls_with_the_edit(spark):
    text = " ".join(f"word{i} is here." for i in range(400))
    d = spark.createDataFrame([(2, text), (1, " ".join(f"other{i} was there." for i in range(400)))], "doc_id long, text string")
    r = {x.doc_id: x for x in fp.edits(d).collect()}
    assert 0.4 < r[2].near_edited < 0.6 and r[2].near_next < 0.05


def test_texts_that_differ_in_blank_lines_or_indents_have_unequal_roots(spark):
    texts = ["", "\n", "\n\n", "\n\n\n", "a", "a\n", "a\n\n", "\n\na", "\n \na", "a\n\nb", "a\n\n\nb", "a\n\n\n\nb", "a\n \nb", "a\n\r\nb", "a\nb", "ab", "def f():\n\n x", "def f():\n\nx", "def f():\n\n\tx", "a\n\nb\n\nc", "a\n\nb\nc", "a\n\n\u2003b", "\n" * 50_000, "x\n\n" * 50_000]
    d = fp.fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    d = d.withColumn("root", F.substring_index("fingerprint", "/", 1)).cache()
    assert len({r.root for r in d.collect()}) == len(texts) == len({r.fingerprint for r in d.collect()})
    small = d.filter("i < 22").select("i", "fingerprint")
    pairs = small.selectExpr("i a", "fingerprint fa").join(small.selectExpr("i b", "fingerprint fb"), F.col("a") < F.col("b"))
    assert pairs.filter(F.size(fp.differing("fa", "fb")) == 0).count() == 0


def test_tree_holds_the_whole_text_in_order(spark):
    text = "\n\n one.\n\n\n  two!\r\n\r\n\tthree\n"
    root = spark.createDataFrame([(text,)], "text string").select(fp._root(fp._tree(F.col("text")))).first()[0]
    sections = ["\n\n one.\n\n\n  ", "two!\r\n\r\n\t", "three\n"]
    assert "".join(sections) == text
    assert root == plain_fingerprint(text).split("/")[0] and ["\n".join("".join(p) for p in s) for s in plain_tree(text)] == sections
