"""Registry, and the test tables in the roles that the operators know."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hkey, huniform
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with SQL for the same rows where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as samples: language is the pool, source the template, pages and chrome come from the id."""
    d = t(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("pool_id"),
        F.col("source").alias("template_stem"),
        F.concat("source", F.lit("__"), (F.col("doc_id") % 37).cast("string")).alias("page_id"),
        F.col("text").alias("target"),
        F.when(F.substring(hkey("c", "doc_id"), 1, 1) < "8", "chrome").otherwise("none").alias("chrome"),
        "n_chars",
    )


SAMPLES = """samples AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS sample_id, lang AS pool_id, source AS template_stem,
  source || '__' || CAST(doc_id % 37 AS VARCHAR) AS page_id, text AS target,
  CASE WHEN substr(md5('c|' || CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'chrome' ELSE 'none' END AS chrome, n_chars FROM documents)"""


def key_sql(seed: int | str, *cols: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"


def uniform_sql(seed: int | str, *cols: str) -> str:
    return f"(CAST('0x' || substr({key_sql(seed, *cols)}, 1, 8) AS UBIGINT) / 4294967296.0)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as boxes on pages of forty: page_id, id, b and the box's sides in columns."""
    d = t(spark, sf_dir, "part")
    u = lambda s: huniform(s, "p_partkey")
    side = lambda s, a, b: F.floor(u(s) * b) + a
    d = d.select(F.floor(F.col("p_partkey") / 40).cast("bigint").alias("page_id"), F.col("p_partkey").alias("id"), side("x", 0, 900).alias("x0"), side("y", 0, 600).alias("y0"), side("w", 10, 300).alias("w"), side("h", 10, 120).alias("h"), "p_size", "p_name", "p_type")
    return d.select("page_id", "id", F.struct(F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"), (F.col("x0") + F.col("w")).cast("double").alias("x1"), (F.col("y0") + F.col("h")).cast("double").alias("y1")).alias("b"), "p_size", "p_name", "p_type")


BOXES = f"""boxes AS (SELECT CAST(floor(p_partkey / 40.0) AS BIGINT) AS page_id, p_partkey AS id, x AS x0, y AS y0, x + w AS x1, y + h AS y1, p_size, p_name, p_type
  FROM (SELECT *, floor({uniform_sql("x", "p_partkey")} * 900) AS x, floor({uniform_sql("y", "p_partkey")} * 600) AS y,
    floor({uniform_sql("w", "p_partkey")} * 300) + 10 AS w, floor({uniform_sql("h", "p_partkey")} * 120) + 10 AS h FROM part))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as predictions: each turn answers the turn before it, some in two tags, some leaking, some empty, by a hash. Texts are whole, here and in TURNS."""
    d = spread(t(spark, sf_dir, "conversations"))
    a = d.select("conv_id", "turn", "role", F.col("text").alias("target"))
    k = F.substring(hkey("t", "conv_id", "turn"), 1, 1)
    part = F.left("target", F.floor(F.length("target") * 0.7).cast("int"))
    two = lambda s, x: F.concat(F.lit("<source>"), s, F.lit("</source><translation>"), x, F.lit("</translation>"))
    raw = (
        F.when(k == "0", "").when(k == "1", "<source></source><translation></translation>").when(k == "2", "<source>")
        .when(k == "3", F.concat(F.col("target"), F.lit("<|im_end|>\nassistant\nmore"))).when(k == "4", F.concat(F.lit("Here: "), two(F.col("target"), F.col("target"))))
        .when(k < "8", two(F.col("target"), part)).when(k < "b", part).otherwise(F.col("target"))
    )
    out = a.withColumn("prediction_raw", raw).withColumn("is_negative", F.substring(hkey("n", "conv_id", "turn"), 1, 1) < "4")
    return out.withColumn("sample_id", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))


TURNS = f"""turns AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS sample_id, substr({key_sql("n", "conv_id", "turn")}, 1, 1) < '4' AS is_negative,
  CASE WHEN k = '0' THEN '' WHEN k = '1' THEN '<source></source><translation></translation>' WHEN k = '2' THEN '<source>'
   WHEN k = '3' THEN target || '<|im_end|>' || chr(10) || 'assistant' || chr(10) || 'more'
   WHEN k = '4' THEN 'Here: <source>' || target || '</source><translation>' || target || '</translation>'
   WHEN k < '8' THEN '<source>' || target || '</source><translation>' || part || '</translation>' WHEN k < 'b' THEN part ELSE target END AS prediction_raw
  FROM (SELECT *, left(target, CAST(floor(length(target) * 0.7::DOUBLE) AS INT)) AS part, substr({key_sql("t", "conv_id", "turn")}, 1, 1) AS k
   FROM (SELECT conv_id, turn, role, text AS target FROM conversations)))"""

#: White space of any script, as (?U)\s of Java's patterns has it.
WS = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


CJK_SQL = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    return f"regexp_replace(lower({strip_sql(c)}), '{WS}+', ' ', 'g')"


#: Characters of one byte that a lower-case text without control characters does not have.
FREE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(1, 9), *range(14, 32), 127]))


def similarity_sql(a: str, b: str) -> str:
    """DuckDB's levenshtein counts bytes, so the pair's characters of several bytes are first replaced by free ones of one byte; an error if they don't suffice."""
    free = " || ".join(f"chr({ord(c)})" for c in FREE)
    one = lambda v: f"translate(v.{v}, v.c, {free})"
    pair = f"{{'x': {norm_sql(a)}, 'y': {norm_sql(b)}, 'c': array_to_string(list_distinct(regexp_extract_all({norm_sql(a)} || {norm_sql(b)}, '[^\x00-\x7F]')), '')}}"
    return f"""list_transform([{pair}], lambda v: CASE WHEN v.x = '' AND v.y = '' THEN 1.0::DOUBLE WHEN v.x = '' OR v.y = '' THEN 0.0::DOUBLE WHEN length(v.c) > {len(FREE)} THEN error('too many characters')::DOUBLE
 ELSE 1.0::DOUBLE - levenshtein({one('x')}, {one('y')})::DOUBLE / greatest(length(v.x), length(v.y)) END)[1]"""


def cleaned_sql(c: str) -> str:
    """A prediction without its leak, for the marks that TURNS plants."""
    return f"{strip_sql(f'split_part({c}, chr(60) || chr(124) || chr(105) || chr(109) || chr(95) || chr(101), 1)')}"
