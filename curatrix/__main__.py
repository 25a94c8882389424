"""Jobs from the command line: `python -m curatrix eval ...`, `python -m curatrix build ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def evaluate(spark: SparkSession, path: str, out: str, by: list[str], two_tags: bool) -> None:
    """A report of prediction lines as JSON lines; by buckets if asked."""
    from .functions import text as X
    from .operators import metrics
    from .sources import samples as S

    d = S.read_jsonl(spark, path, S.PREDICTION, "drop").withColumn("prediction", X.strip_format_leak(F.coalesce("prediction_raw", "prediction")))
    (metrics.two_tag_report if two_tags else metrics.report)(d, *by).coalesce(1).write.mode("overwrite").json(out)


def build(spark: SparkSession, pools: str, recipe: str, out: str) -> None:
    """A recipe applied to folders of pools: splits as JSON lines, in order."""
    from .plans import recipe as R
    from .plans import stage
    from .sources import samples as S

    d = S.read_pools(spark, pools).withColumns({k: F.col(f"metadata.{k}") for k in ("sample_id", "template_stem", "chrome_family", "text_occupancy")})
    S.write_split(stage.composed(d, R.load(recipe)), out)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="curatrix")
    kinds = p.add_subparsers(dest="job", required=True)
    e = kinds.add_parser("eval", help=evaluate.__doc__)
    e.add_argument("predictions")
    e.add_argument("out")
    e.add_argument("--by", nargs="*", default=[])
    e.add_argument("--two-tags", action="store_true")
    b = kinds.add_parser("build", help=build.__doc__)
    b.add_argument("pools")
    b.add_argument("recipe")
    b.add_argument("out")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "eval":
        evaluate(spark, a.predictions, a.out, a.by, a.two_tags)
    else:
        build(spark, a.pools, a.recipe, a.out)


if __name__ == "__main__":
    main()
