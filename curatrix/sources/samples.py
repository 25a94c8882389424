"""Chat samples as JSON lines, and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGES = "messages ARRAY<STRUCT<role STRING, content STRING>>, images ARRAY<STRING>"
METADATA = (
    "sample_id STRING, task STRING, pool_id STRING, page_id STRING, block_id STRING, template_stem STRING, prompt_key STRING, stage STRING, is_negative BOOLEAN, region STRING, "
    "point ARRAY<DOUBLE>, point_norm ARRAY<INT>, image_w INT, image_h INT, bbox ARRAY<DOUBLE>, bboxes ARRAY<ARRAY<DOUBLE>>, bbox_union ARRAY<DOUBLE>, n_fragments INT, fragment_index INT, "
    "marker STRING, marker_area_frac DOUBLE, marker_area_scale DOUBLE, chrome_family STRING, device_scale_factor DOUBLE, text_occupancy DOUBLE, a2_kind STRING, special_block_id STRING, "
    "group_id STRING, group_kind STRING, group_role STRING, translation STRING, mt_domain STRING, grpo_scene STRING, target STRING, upsampled BOOLEAN"
)
SAMPLE = f"{MESSAGES}, metadata STRUCT<{METADATA.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN').replace(' ARRAY<', ': ARRAY<').replace(' INT', ': INT').replace(' DOUBLE', ': DOUBLE')}>"
PREDICTION = "sample_id STRING, doc_type STRING, content_bucket STRING, grpo_scene STRING, is_negative BOOLEAN, target STRING, prediction STRING, prediction_raw STRING, format_leak BOOLEAN, image STRING"
PROBE = "sample_id STRING, scene STRING, pool_id STRING, is_negative BOOLEAN, vis_tokens INT, target STRING, completions ARRAY<STRING>, rewards ARRAY<DOUBLE>, reward_mean DOUBLE, reward_std DOUBLE, reward_min DOUBLE, reward_max DOUBLE, n_unique INT, verdict STRING, gen_batch INT"
BLOCK = "id STRING, bbox ARRAY<DOUBLE>, rects ARRAY<ARRAY<DOUBLE>>, tag STRING, markdown STRING, translation STRING, mt_domain STRING, html STRING, role STRING, a2_kind STRING, visible_frac DOUBLE, in_viewport_frac DOUBLE"


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE, bad_lines: str = "fail") -> DataFrame:
    """bad_lines: fail, or drop. A blank line is no row."""
    return spark.read.schema(schema).option("mode", {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[bad_lines]).json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, dropping bad lines; empty if there is no such file."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.globStatus(fs_path):
        return spark.createDataFrame([], schema)
    return read_jsonl(spark, path, schema, "drop")


def read_pools(spark: SparkSession, root: str, schema: str = SAMPLE) -> DataFrame:
    """All pools under a root, one folder each; pool_id is the folder's name where a row has none."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/*.jsonl")
    own = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return d.withColumn("pool_id", F.coalesce(F.nullif("metadata.pool_id", F.lit("")), own))


def read_page_blocks(spark: SparkSession, pattern: str) -> DataFrame:
    """Block arrays, one file a page, named by it or in a folder that is; rectangles under two pixels are dropped."""
    d = spark.read.schema(BLOCK).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    name = F.col("_metadata.file_name")
    kept = F.filter(F.coalesce("rects", F.array().cast("array<array<double>>")), lambda r: (r[2] - r[0] >= 2) & (r[3] - r[1] >= 2))
    return d.withColumn("page_id", F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/page_id=([^/]+)/", 1), F.lit("")), F.regexp_replace(name, r"\.blocks\.json$", ""))).withColumn("rects", kept).filter("id IS NOT NULL")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file, or of several one after another in order of their names. A block's lines are counted, and the counts before it are its offset, so no task reads all."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")).withColumn("m", F.monotonically_increasing_id())
    blocks = d.groupBy("f", "b").agg(F.min("m").alias("lo"), F.count(F.lit(1)).alias("n"))  # a row a block of a file
    blocks = blocks.withColumn("before", F.sum("n").over(Window.orderBy("f", "b")) - F.col("n")).drop("n")
    return d.join(blocks, ["f", "b"]).select((F.col("before") + F.col("m") - F.col("lo")).alias("line"), "value")


def read_bitext(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two files of parallel lines: line, en, zh."""
    return numbered_lines(spark, left).withColumnRenamed("value", "en").join(numbered_lines(spark, right).withColumnRenamed("value", "zh"), "line")


def target_text(df: DataFrame) -> DataFrame:
    """Adds target: the first assistant message."""
    said = F.filter("messages", lambda m: m["role"] == "assistant")
    return df.withColumn("target", F.get(F.transform(said, lambda m: m["content"]), F.lit(0)))


def write_split(df: DataFrame, path: str) -> None:
    """JSON lines by split, in order of `ord` within a file and from file to file; a split takes as many tasks as it needs."""
    df.repartitionByRange("split", "ord").sortWithinPartitions("split", "ord").write.mode("overwrite").partitionBy("split").json(path)


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and time of images; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(root)
    return d.select("path", "length", "modificationTime")


def missing_images(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct images that samples refer to, and whether they are there."""
    refs = samples.select(F.explode("images").alias("path")).distinct()
    return refs.join(files.select("path", F.lit(True).alias("present")), "path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"))


def as_openai(df: DataFrame) -> DataFrame:
    """Messages whose contents are arrays of parts."""
    image = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda p: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), p.alias("image")))
    text = lambda m: F.array(F.struct(F.lit("text").alias("type"), F.regexp_replace(m["content"], "^<image>\\s*", "").alias("text"), F.lit(None).cast("string").alias("image")))
    return df.withColumn("messages", F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when((i == 0) & (m["role"] == "user"), F.concat(image, text(m))).otherwise(text(m)).alias("content"))))


def report_markdown(row: dict, title: str) -> str:
    """One row of a report as a Markdown table: shares with one decimal of a percent, other numbers with three."""
    cell = lambda k, v: f"{100 * v:.1f} %" if k.endswith("_rate") else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join([f"## {title}", "", "| metric | value |", "|---|---|", *(f"| {k} | {cell(k, v)} |" for k, v in row.items())])


def write_manifest(df: DataFrame, path: str) -> None:
    """All rows as one JSON array, for tables that are small by their nature, such as reports."""
    text = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"pretty": "true"}).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_counted(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes JSON lines in folders by the given columns; returns the counts of what was written, read back."""
    df.write.mode("overwrite").partitionBy(*by).json(path)
    kinds = dict(df.dtypes)
    back = df.sparkSession.read.schema(df.schema).json(path)
    return back.groupBy(*[F.col(c).cast(kinds[c]).alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n"))


def write_blocks(df: DataFrame, path: str) -> None:
    """One row a block (page_id and fields of BLOCK) as an array a page, a file a page's folder."""
    fields = [c for c in df.columns if c != "page_id"]
    d = df.groupBy("page_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("value"))
    d.write.mode("overwrite").partitionBy("page_id").text(path)


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length and SHA-256 of files."""
    d = spark.read.format("binaryFile").load(pattern)
    return d.select("path", "length", F.sha2("content", 256).alias("sha256"))


def screens(df: DataFrame, n: int, order: str) -> DataFrame:
    """df: width, height, texts. The first n screens of 400 pixels at least with a text among their first eight."""
    said = F.exists(F.slice("texts", 1, 8), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return df.filter((F.least("width", "height") >= 400) & said).orderBy(order).limit(n)


def web_pages(df: DataFrame, n: int, order: str, scan: int | None = None) -> DataFrame:
    """df: width, height, viewport. The first n pages of 300 pixels at least among the first rows of the table (20 n, 500 at least); other viewports than desktop only after half of n is there.

    Whether a row counts depends on how many were kept before it: before that half only desktop pages are, so the half is
    the place of the desktop pages' row of that number, and all that is large enough counts after it.
    """
    d = df.orderBy(order).limit(scan or max(20 * n, 500))
    d = d.withColumns({"__desk": F.coalesce("viewport", F.lit("")).isin("", "desktop", "1280x720"), "__ok": F.least("width", "height") >= 300})
    half = n // 2
    w = Window.orderBy(order)  # of a bounded scan
    d = d.withColumn("__before", F.coalesce(F.sum((F.col("__desk") & F.col("__ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.filter(F.col("__ok") & (F.col("__desk") | (F.col("__before") >= half))).drop("__desk", "__ok", "__before").orderBy(order).limit(n)


def laid_out(df: DataFrame, n: int, order: str) -> DataFrame:
    """df: cells, an array of arrays. The first n rows that have a cell."""
    return df.filter(F.aggregate("cells", F.lit(0), lambda a, c: a + F.size(c)) > 0).orderBy(order).limit(n)


def staged(df: DataFrame, present: DataFrame) -> DataFrame:
    """Chat rows as parts, images that are not there (path, present) left out; every row stays."""
    d = df.withColumn("__id", F.monotonically_increasing_id())
    kept = d.select("__id", F.posexplode("images").alias("__k", "path")).join(present.filter("present").select("path"), "path").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("__k", "path"))).alias("__kept"))
    d = d.join(kept, "__id", "left").withColumn("images", F.coalesce(F.transform("__kept", lambda x: x["path"]), F.array().cast("array<string>")))
    return as_openai(d.drop("__id", "__kept"))


def trainable(df: DataFrame, present: DataFrame) -> DataFrame:
    """Chat rows as parts, without those of under two messages or with an image that is listed but not there (path, present); rows of text only stay."""
    d = df.filter(F.size("messages") >= 2).withColumn("__id", F.coalesce("metadata.sample_id", F.xxhash64("messages").cast("string")))
    gone = d.select("__id", F.explode("images").alias("path")).join(present.filter("present").select("path"), "path", "left_anti").select("__id").distinct()
    return as_openai(d.join(gone, "__id", "left_anti").drop("__id"))
