"""The statistics of a window: one row per group and field, in every case where the question means something.

Input is the long form (keys, ts, field, value), cleaned. Sums are taken as DECIMAL(18,4), so they do
not depend on the order of rows. Ties go to the earliest ts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.functions.dims import CIRCULAR, POINTS, THRESHOLDS

EXACT = "decimal(18,4)"


def threshold() -> Column:
    """The limit from which a reading of the field counts; null for fields that are not counted."""
    return F.coalesce(*[F.when(F.col("field") == f, F.lit(t)) for f, t in THRESHOLDS.items()])


def _sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT)).cast("double")


def plain(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """All order-free statistics in one pass; a query that selects one pays for one."""
    v, t = F.col("value"), threshold()
    hit = v >= t
    n = F.count("value")
    first, last = F.min_by("value", "ts"), F.max_by("value", "ts")
    rows = long.where(v.isNotNull())
    return rows.groupBy(*by, "field").agg(
        n.alias("n"),
        _sum(v).alias("sum"),
        (_sum(v) / n).alias("avg"),
        F.median("value").alias("median"),
        F.max("value").alias("max"),
        F.min_by("ts", F.struct(-v, F.col("ts"))).alias("max_at"),
        F.min("value").alias("min"),
        F.min_by("ts", F.struct(v, F.col("ts"))).alias("min_at"),
        (F.max("value") - F.min("value")).alias("range"),
        F.when(n >= 2, F.stddev_pop("value")).alias("stddev"),
        F.when(n >= 2, last - first).alias("change"),
        F.count_if(hit).alias("count"),
        (F.count_if(hit).cast("double") / n * 100).alias("frequency"),
        (_sum(F.when(hit, v)) / F.nullif(F.count_if(hit), F.lit(0))).alias("intensity"),
        first.alias("first"),
        last.alias("last"),
    )


def bearing(c: Column) -> Column:
    """The compass point of a bearing in degrees."""
    return F.element_at(F.array(*map(F.lit, POINTS)), (F.pmod(F.floor(F.pmod(c, F.lit(360.0)) / 22.5 + 0.5), F.lit(16)) + 1).cast("int"))


def distribution(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, point, n, share: all 16 points, the empty ones too."""
    rows = long.where((F.col("field") == CIRCULAR) & F.col("value").isNotNull()).withColumn("point", bearing(F.col("value")))
    wide = rows.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("point") == p).alias(p) for p in POINTS])
    return wide.unpivot([*by, "total"], list(POINTS), "point", "n").select(*by, "point", "n", (F.col("n").cast("double") / F.col("total") * 100).alias("share"))


def mode(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, point, n, share: the commonest point, the first seen on ties."""
    rows = long.where((F.col("field") == CIRCULAR) & F.col("value").isNotNull()).withColumn("point", bearing(F.col("value")))
    each = rows.groupBy(*by, "point").agg(F.count("*").alias("n"), F.min("ts").alias("seen"))
    return each.groupBy(*by).agg(F.min_by("point", F.struct(-F.col("n"), F.col("seen"))).alias("point"), F.max("n").alias("n"), (F.max("n").cast("double") / F.sum("n") * 100).alias("share"))


def periods(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, field, heaviest and lightest calendar day with their totals."""
    days = long.where(F.col("value").isNotNull()).groupBy(*by, "field", F.to_date("ts").alias("day")).agg(_sum(F.col("value")).alias("total"))
    return days.groupBy(*by, "field").agg(
        F.min_by("day", F.struct(-F.col("total"), F.col("day"))).alias("peak_day"), F.max("total").alias("peak_total"),
        F.min_by("day", F.struct("total", "day")).alias("low_day"), F.min("total").alias("low_total"),
    )


def cumulative(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, field, ts, value, running: the running total in time order."""
    w = Window.partitionBy(*by, "field").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return long.where(F.col("value").isNotNull()).withColumn("running", F.sum(F.col("value").cast(EXACT)).over(w).cast("double"))


def spells(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, field, n, start, until: stretches of readings at the threshold. Missing readings are dropped first and break nothing."""
    keys = [*by, "field"]
    w = Window.partitionBy(*keys).orderBy("ts")
    rows = long.where(F.col("value").isNotNull()).withColumn("hit", F.col("value") >= threshold())
    rows = rows.withColumn("new", (F.col("hit") & ~F.coalesce(F.lag("hit").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.where("hit").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("until"))


def spell_summary(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, field, runs, longest, start, until: how many stretches, and the longest (the earliest on ties)."""
    return spells(long, by).groupBy(*by, "field").agg(
        F.count("*").alias("runs"), F.max("n").alias("longest"), F.min_by("start", F.struct(-F.col("n"), F.col("start"))).alias("start"),
        F.min_by("until", F.struct(-F.col("n"), F.col("start"))).alias("until"),
    )


def trend(long: DataFrame, by: Sequence[str], least: float = 1.5) -> DataFrame:
    """by, field, change, direction, peak_at, low_at: for at least three readings and a change that matters."""
    p = plain(long, by).where((F.col("n") >= 3) & (F.abs(F.col("last") - F.col("first")) >= least))
    return p.select(*by, "field", "change", F.when(F.col("change") > 0, "rising").otherwise("falling").alias("direction"), F.col("max_at").alias("peak_at"), F.col("min_at").alias("low_at"))


def gated(long: DataFrame, by: Sequence[str], asked: DataFrame, gates: DataFrame) -> DataFrame:
    """by, variable, field, statistic, value: what was asked and may be answered; a refusal is no row."""
    p = plain(long, by)
    named = {"SUM": "sum", "AVG": "avg", "MEDIAN": "median", "MAX": "max", "MIN": "min", "RANGE": "range", "STDDEV": "stddev", "CHANGE": "change", "COUNT": "count", "FREQUENCY": "frequency", "INTENSITY": "intensity"}
    rows = p.select(*by, "field", *[F.col(c).cast("double").alias(s) for s, c in named.items()]).unpivot([*by, "field"], list(named), "statistic", "value")
    return rows.join(F.broadcast(gates.join(asked, ["variable", "statistic"])), ["field", "statistic"]).select(*by, "variable", "field", "statistic", "value").where(F.col("value").isNotNull())
