"""Rewards of a prediction against its target: terms as Columns, and weighted sets of them."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Names of verdicts.
VERDICTS = ("signal", "saturated", "collapsed", "flat")
# When a prediction is a mere part of its target.
UNDER_SIMILARITY, UNDER_LENGTH = 0.55, 0.65


@dataclass(frozen=True)
class OneTagWeights:
    edit: float = 1.0
    empty: float = 1.5
    over: float = 1.0
    under: float = 1.0
    leak: float = 0.5


@dataclass(frozen=True)
class TwoTagWeights:
    source: float = 0.5
    translation: float = 1.0
    xml: float = 0.5
    empty: float = 1.5
    hallucination: float = 1.5
    over: float = 0.5
    leak: float = 0.5

    def ceiling(self) -> float:
        """The most that a positive row can earn."""
        return self.source + self.translation + self.xml


def weights_from(raw: str | None) -> TwoTagWeights:
    """Seven numbers separated by commas or spaces; the defaults for none."""
    if not raw or not raw.strip():
        return TwoTagWeights()
    values = [float(x) for x in raw.replace(",", " ").split()]
    if len(values) != len(astuple(TwoTagWeights())):
        raise ValueError(f"seven weights are needed, not {len(values)}")
    return TwoTagWeights(*values)


def as_bool(c: Column) -> Column:
    """Of a string flag."""
    return F.coalesce(F.lower(X.strip(c)).isin("1", "true", "yes"), F.lit(False))


def edit(pred: Column, gt: Column) -> Column:
    return X.edit_similarity(pred, gt)


def empty(pred: Column, negative: Column) -> Column:
    blank = X.is_blank(pred)
    return F.when(negative, blank.cast("double")).otherwise(F.when(blank, -1.0).otherwise(0.0))


def over(pred: Column, gt: Column, negative: Column) -> Column:
    return F.when(~negative & X.over_extraction(pred, gt), -1.0).otherwise(0.0)


def under(pred: Column, gt: Column, negative: Column, similarity: Column | None = None) -> Column:
    short = F.length(pred) < UNDER_LENGTH * F.length(gt)
    sim = X.edit_similarity(pred, gt) if similarity is None else similarity
    return F.when(~negative & ~X.is_blank(pred) & ~X.is_blank(gt) & short & (sim < UNDER_SIMILARITY), -1.0).otherwise(0.0)


def leak(raw: Column, penalty: float = 1.0) -> Column:
    return F.when(X.has_format_leak(raw), -penalty).otherwise(0.0)


def xml(pred: Column) -> Column:
    p = X.parse_target(pred)
    return F.when(X.is_blank(pred), 0.0).when(p["well_formed"], 1.0).when(p["has_source"] & p["has_translation"], 0.4).when(p["has_source"] | p["has_translation"], 0.0).otherwise(-0.5)


def empty_two_tags(pred: Column, negative: Column) -> Column:
    p, blank = X.parse_target(pred), X.is_blank(pred)
    return F.when(negative, F.when(blank, 1.0).when(p["empty_shell"] | p["truncated"], 0.5).otherwise(0.0)).otherwise(F.when(blank, -1.0).otherwise(0.0))


def source(pred: Column, gt: Column, negative: Column) -> Column:
    return F.when(negative, 0.0).otherwise(X.edit_similarity(X.parse_target(pred)["source"], X.parse_target(gt)["source"]))


def translation(pred: Column, gt: Column, negative: Column, score: Column) -> Column:
    """score: the n-gram score of the two translations; it counts only where a source was given."""
    return F.when(negative | X.is_blank(X.parse_target(pred)["source"]), 0.0).otherwise(score)


def hallucination(pred: Column, negative: Column) -> Column:
    return F.when(negative & ~X.is_blank(X.parse_target(pred)["source"]), -1.0).otherwise(0.0)


def over_two_tags(pred: Column, gt: Column, negative: Column) -> Column:
    return F.when(~negative & X.over_extraction(X.parse_target(pred)["source"], X.parse_target(gt)["source"]), -1.0).otherwise(0.0)


def legacy(raw: Column, gt: Column, negative: Column) -> Column:
    """The first set: edit + empty + half of a leak term of 0.5."""
    pred = X.strip_format_leak(raw)
    return edit(pred, gt) + empty(pred, negative) + 0.5 * leak(raw, 0.5)


def one_tag(raw: Column, gt: Column, negative: Column, w: OneTagWeights = OneTagWeights()) -> Column:
    """struct of terms and their weighted total."""

    def terms(v: Column) -> Column:
        pred, sim = v["p"], v["s"]
        return F.struct(*[c.alias(k) for k, c in {"edit": sim, "empty": empty(pred, negative), "over": over(pred, gt, negative), "under": under(pred, gt, negative, sim), "leak": leak(raw)}.items()])

    pair = X.bind(X.strip_format_leak(raw), lambda p: F.struct(p.alias("p"), edit(p, gt).alias("s")))
    return X.bind(X.bind(pair, terms), lambda t: _with_total(t, w))


def _with_total(t: Column, w) -> Column:
    names = list(vars(w))
    return F.struct(*[t[k].alias(k) for k in names], sum((getattr(w, k) * t[k] for k in names), F.lit(0.0)).alias("total"))


def two_tags(raw: Column, gt: Column, negative: Column, score: Column, w: TwoTagWeights = TwoTagWeights()) -> Column:

    def terms(pred: Column) -> Column:
        return F.struct(
            source(pred, gt, negative).alias("source"),
            translation(pred, gt, negative, score).alias("translation"),
            xml(pred).alias("xml"),
            empty_two_tags(pred, negative).alias("empty"),
            hallucination(pred, negative).alias("hallucination"),
            over_two_tags(pred, gt, negative).alias("over"),
            leak(raw).alias("leak"),
        )

    return X.bind(X.bind(X.strip_format_leak(raw), terms), lambda t: _with_total(t, w))


def paired(completions: Column, targets: Column, flags: Column | None = None) -> Column:
    """array<struct<prediction, target, negative>> of arrays of texts, as long as the shorter of completions and targets; predictions are cleaned.

    flags: an array of texts, of which missing ones are false and those too many are left out; without it, or where it is
    null, a blank target makes a negative. A scalar target or flag is given as F.array_repeat of it.
    """
    n = F.least(F.size(completions), F.size(targets))
    given = F.lit(None).cast("array<string>") if flags is None else flags
    one = lambda i: F.struct(
        X.strip_format_leak(F.get(completions, i)).alias("prediction"),
        F.coalesce(F.get(targets, i), F.lit("")).alias("target"),
        F.when(given.isNull(), X.is_blank(F.get(targets, i))).otherwise(as_bool(F.get(given, i))).alias("negative"),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<struct<prediction: string, target: string, negative: boolean>>"))


def reward_set(name: str):
    """A set of rewards by its name, of any case: the first set for one that is not known."""
    return {"q1v2": one_tag, "q2": two_tags}.get(name.lower(), legacy)


def verdict(mean: Column, std: Column, n_unique: Column, least_std: float = 0.04, saturated: float = 0.92, floor: float = 0.20) -> Column:
    """Whether a group of rollouts still teaches something."""
    return F.when((std >= least_std) & (n_unique >= 2), "signal").when(mean >= saturated, "saturated").when(mean <= floor, "collapsed").otherwise("flat")
