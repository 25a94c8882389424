"""A session for local runs; on a cluster the settings come from its submission."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Lets executors import this package, once a context, unless PYTHONPATH already does."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if getattr(sc, "_curatrix_shipped", False) or str(here.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="curatrix-")), "curatrix_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(path)
    sc._curatrix_shipped = True


def spread(df):
    """df over as many tasks as there are cores, if its input is too small to be cut so; else as it is. For costly rows only."""
    spark = df.sparkSession
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a temporary one where that is unset and all runs in this process. It goes when the application ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc = spark.sparkContext  # the setting itself can't be changed in a running session
        base = sc._curatrix_folder = getattr(sc, "_curatrix_folder", None) or "file://" + tempfile.mkdtemp(prefix="curatrix-")
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def as_written(df, kind: str):
    """df as a table in the shared folder: computed once, its lineage cut."""
    path = f"{shared_folder(df.sparkSession, kind)}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
