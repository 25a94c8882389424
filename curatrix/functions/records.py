"""Maps, arrays and fields of records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import text as X


def merged(*maps: Column) -> Column:
    """One map of all keys; of a key that several have, the last one's value. Null maps are empty."""
    out = None
    for m in maps:
        m = F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        out = m if out is None else F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position; an error where the arrays differ in length."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast(T.NullType()))


def stamped(df: DataFrame, defaults: dict[str, Column], never: tuple[str, ...] = ("marker_area_frac", "marker_area_scale")) -> DataFrame:
    """Fills fields that a row lacks with those of its page; never the marker's size, which is drawn row by row."""
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in df.columns else v for k, v in defaults.items() if k not in never})


def reading_key(box: Column) -> Column:
    """Sorts boxes (arrays x0, y0, x1, y1) from top to bottom, then left to right."""
    return F.struct(box[1].alias("y"), box[0].alias("x"))


def directory(raw: Column) -> Column:
    """A folder as POSIX has it: quotes off, a drive letter as a mount; null for a blank."""
    s = F.regexp_replace(F.regexp_replace(X.strip(raw), '^"+|"+$', ""), "^'+|'+$", "")
    mount = F.concat(F.lit("/mnt/"), F.lower(F.left(s, F.lit(1))), F.lit("/"), F.regexp_replace(F.replace(F.substring(s, F.lit(3), F.length(s)), F.lit("\\"), F.lit("/")), "^/+", ""))
    return F.when(s.rlike(r"^[A-Za-z]:"), mount).when(s != "", F.replace(s, F.lit("\\"), F.lit("/")))


def first_of_candidates(*paths: Column, known: Column) -> Column:
    """The first of the paths that is in the array of known ones; an error if none is."""
    found = F.coalesce(*[F.when(F.array_contains(known, p), p) for p in paths])
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no such file: "), paths[0])).cast("string"))


def prompt_for(prompts: dict[str, str], aliases: dict[str, str], task: str, key: str | None = None) -> str:
    """The text of a prompt: that of the key, or what it is an alias of, else that of the task; an error for an unknown one."""
    name = aliases.get(key.strip(), key.strip()) if key and key.strip() else task
    if name not in prompts:
        raise KeyError(f"unknown prompt {name!r}")
    return prompts[name]


def text_of(completion) -> str:
    """The text of a completion: itself, the content or text of an object, or those of a list's items, however deep."""
    parts, todo = [], [completion]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            if x.get("type") != "text" and "content" in x:
                todo.append(x["content"])
            else:
                parts.append(str(x.get("text") or ""))
        elif x is not None:
            parts.append(x if isinstance(x, str) else str(x))
    return "".join(parts)


@pandas_udf(T.StringType())
def completion_text(raw: pd.Series) -> pd.Series:
    """Of completions as JSON; what is no JSON is itself."""

    def one(x):
        try:
            return text_of(json.loads(x)) if x is not None else ""
        except ValueError:
            return x

    return raw.map(one, na_action=None).astype(object)
