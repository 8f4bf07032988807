"""Scores of predictions: accuracy, F1 on sets and multisets, confidence bands, failures, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (0.0, 0.3, 0.45, 0.6, 0.75, 0.85, 0.95)


def _share(c: Column) -> Column:
    return F.count_if(c).cast("double") / F.count("*")


def accuracy(rows: DataFrame, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """One column per target (gold, predicted), and `everything`."""
    right = [F.col(g).eqNullSafe(F.col(p)) for g, p in targets]
    every = right[0]
    for r in right[1:]:
        every = every & r
    return rows.agg(F.count("*").alias("n"), *[_share(r).alias(g) for r, (g, _) in zip(right, targets, strict=True)], _share(every).alias("everything"))


def target_shares(rows: DataFrame, single: Sequence[tuple[str, str]], sets: Sequence[tuple[str, str]] = (), spans: Sequence[tuple[str, str]] = (), only: dict[str, Column] | None = None) -> DataFrame:
    """target, n, share: how often each target is right, and all of them at once (`everything`).

    Sets are right with the same members, spans with the same spellings as often, in any order and case. A target in `only` counts
    (also in everything) where its condition holds.
    """
    def told(c: str) -> Column:
        return F.array_sort(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))

    right = {g: F.col(g).eqNullSafe(F.col(p)) for g, p in single}
    right |= {g: F.array_sort(F.array_distinct(F.coalesce(F.col(g), F.array().cast("array<string>")))) == F.array_sort(F.array_distinct(F.coalesce(F.col(p), F.array().cast("array<string>")))) for g, p in sets}
    right |= {g: told(g) == told(p) for g, p in spans}
    asked = {g: F.coalesce((only or {}).get(g, F.lit(True)), F.lit(False)) for g in right}
    every = F.lit(True)
    for g, ok in right.items():
        every = every & (ok | ~asked[g])
    cells = [F.struct(F.lit(g).alias("target"), F.count_if(asked[g]).alias("n"), F.count_if(asked[g] & ok).alias("hits")) for g, ok in right.items()]
    cells.append(F.struct(F.lit("everything").alias("target"), F.count("*").alias("n"), F.count_if(every).alias("hits")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c")).select("target", "n", F.try_divide(F.col("hits").cast("double"), F.col("n")).alias("share"))


def set_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn, f1 over label sets, summed over all rows."""
    sums = rows.agg(
        F.sum(F.size(F.array_intersect(gold, predicted))).alias("tp"), F.sum(F.size(F.array_except(predicted, gold))).alias("fp"), F.sum(F.size(F.array_except(gold, predicted))).alias("fn")
    )
    return sums.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def span_f1(rows: DataFrame, gold: str, predicted: str, key: str) -> DataFrame:
    """precision, recall, f1 on multisets of spans, case ignored."""

    def counted(c: str, name: str) -> DataFrame:
        return rows.select(key, F.explode(c).alias("s")).groupBy(key, F.lower("s").alias("s")).agg(F.count("*").alias(name))

    both = counted(gold, "g").join(counted(predicted, "p"), [key, "s"], "full").fillna(0, ["g", "p"])
    sums = both.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("np")), F.try_divide(F.col("tp").cast("double"), F.col("ng"))
    return sums.select("tp", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def bands(rows: DataFrame, right: Column, cuts: Sequence[float] = BANDS) -> DataFrame:
    """low, n, accuracy, share, above: bands of confidence; above is the accuracy from this band upwards."""
    low = F.lit(cuts[0])
    for c in cuts[1:]:
        low = F.when(F.col("score") >= c, F.lit(c)).otherwise(low)
    each = rows.groupBy(low.alias("low")).agg(F.count("*").alias("n"), F.count_if(right).alias("k"))
    up = Window.orderBy(F.desc("low"))  # one row per band
    return each.select(
        "low", "n", (F.col("k").cast("double") / F.col("n")).alias("accuracy"), (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())).alias("share"),
        (F.sum("k").over(up).cast("double") / F.sum("n").over(up)).alias("above"),
    )


def cut_points(banded: DataFrame) -> DataFrame:
    """accept: the lowest band with at least 95% right from there on; clarify: the lowest cut under which less than 60% is right (0.45 if none)."""
    down = Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    rows = banded.withColumn("below", F.try_divide(F.sum(F.col("accuracy") * F.col("n")).over(down), F.sum("n").over(down)))
    return rows.agg(F.coalesce(F.min(F.when(F.col("above") >= 0.95, F.col("low"))), F.max("low")).alias("accept"), F.coalesce(F.min(F.when(F.col("below") < 0.6, F.col("low"))), F.lit(0.45)).alias("clarify"))


def threshold_sweep(rows: DataFrame, positive: Column, cuts: Sequence[float]) -> DataFrame:
    """cut, tp, fp, fn, f1 for each threshold, in one pass; the best is max_by(cut, f1)."""
    each = F.array(*[
        F.struct(F.lit(c).alias("cut"), F.count_if(positive & (F.col("score") >= c)).alias("tp"), F.count_if(~positive & (F.col("score") >= c)).alias("fp"), F.count_if(positive & (F.col("score") < c)).alias("fn"))
        for c in cuts
    ])
    out = rows.agg(each.alias("e")).select(F.inline("e"))
    return out.withColumn("f1", F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def per_class(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1."""
    pairs = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("t")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    s = pairs.groupBy(F.col("x.c").alias("class")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("n"), F.sum("x.t").alias("tp"))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("n")), F.try_divide(F.col("tp").cast("double"), F.col("support"))
    return s.select("class", "support", p.alias("precision"), r.alias("recall"), F.try_divide(2.0 * F.col("tp"), F.col("n") + F.col("support")).alias("f1"))


def failures(rows: DataFrame, key: str, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """key, wrong: rows that are wrong on any target, and which."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(g).eqNullSafe(F.col(p)), F.lit(g)) for g, p in targets]))
    return rows.select(key, wrong.alias("wrong")).where(F.size("wrong") > 0)


def kfold(rows: DataFrame, label: str, key: str, k: int = 5) -> DataFrame:
    """key, fold: stratified by label."""
    w = Window.partitionBy(label).orderBy(key)
    return rows.select(key, label, ((F.row_number().over(w) - 1) % k).cast("int").alias("fold"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """gold, predicted, n without the diagonal."""
    return rows.where(F.col(gold) != F.col(predicted)).groupBy(gold, predicted).agg(F.count("*").alias("n"))


def macro_f1(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """macro_f1 over the classes of the gold, and baseline, the share of the commonest."""
    scores = per_class(rows, gold, predicted).where("support > 0")
    return scores.agg(F.avg("f1").alias("macro_f1"), (F.max("support").cast("double") / F.sum("support")).alias("baseline"))


def misrouted(rows: DataFrame, gold: str, predicted: str, data: Sequence[str]) -> DataFrame:
    """turns that ask for no data, and how many of them were taken to."""
    none = ~F.col(gold).isin(*data)
    return rows.agg(F.count_if(none).alias("turns"), F.count_if(none & F.col(predicted).isin(*data)).alias("misrouted"))


def learning_subsets(rows: DataFrame, label: str, key: str, shares: Sequence[float]) -> DataFrame:
    """share, key: nested subsets of each class for a learning curve, the first of a fixed shuffle."""
    w = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    at = (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(label))
    some = rows.select(key, at.alias("at")).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return some.where(F.col("at") < F.col("share")).select("share", key)
