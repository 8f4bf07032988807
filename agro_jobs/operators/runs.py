"""When a condition holds: islands of consecutive readings, and whether a job fits into them.

A missing reading is never suitable and breaks a run (unlike `stats.spells`, which drops it first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0
BIN = 24.0  # hours of a bin in which jobs and shelters meet


def _hours(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / (HOUR * 1e6)


def spacing(rows: DataFrame, by: Sequence[str], alone: float = 1.0) -> DataFrame:
    """by, spacing: the median positive gap in hours; `alone` where there is a single reading."""
    gap = _hours("ts") - F.lag(_hours("ts")).over(Window.partitionBy(*by).orderBy("ts"))
    return rows.withColumn("gap", gap).groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(alone)).alias("spacing"))


def islands(rows: DataFrame, condition: str, by: Sequence[str], order: str = "ts") -> DataFrame:
    """by, run, readings, start, last: stretches of readings where the condition is true."""
    w = Window.partitionBy(*by).orderBy(order)
    ok = rows.withColumn("ok", F.coalesce(F.expr(condition), F.lit(False)))
    ok = ok.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(w))
    return ok.where("ok").groupBy(*by, "run").agg(F.count("*").alias("readings"), F.min("ts").alias("start"), F.max("ts").alias("last"))


def runs(rows: DataFrame, condition: str, by: Sequence[str], gaps: DataFrame | None = None) -> DataFrame:
    """by, start, last, readings, hours, spacing: an island lasts until its last reading's own spacing is over.

    gaps is the spacing where it is known already, by some of the columns of `by`.
    """
    gaps = spacing(rows, by) if gaps is None else gaps
    out = islands(rows, condition, by).join(gaps, [c for c in by if c in gaps.columns])
    return out.withColumn("hours", _hours("last") - _hours("start") + F.col("spacing")).drop("run")


def measured(size: DataFrame, spells: DataFrame, by: Sequence[str], needed: F.Column) -> DataFrame:
    """size (by, n, spacing) with n_runs, best, share, fragmented of its spells."""
    got = spells.groupBy(*by).agg(F.count("*").alias("n_runs"), F.max("hours").alias("best"), F.sum("hours").alias("total"), F.max("readings").alias("longest"))
    out = size.join(got, list(by), "left").withColumn("share", F.coalesce(F.try_divide("total", F.col("spacing") * F.col("n")), F.lit(0.0)))
    broken = (F.col("best") < needed) & (F.col("share") >= 0.25) & (F.col("longest") < F.col("n"))
    return out.select(*by, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("best", F.lit(0.0)).alias("best"), "share", F.coalesce(broken, F.lit(False)).alias("fragmented"))


def held(rows: DataFrame, condition: str, by: Sequence[str], needed: float) -> DataFrame:
    """by, n_runs, best, share, fragmented: how much of the period the condition holds, and whether it keeps breaking up."""
    gaps = spacing(rows, by)
    size = rows.groupBy(*by).agg(F.count("*").alias("n")).join(gaps, list(by))
    return measured(size, runs(rows, condition, by, gaps), by, F.lit(needed))


def binned(rows: DataFrame, begin: str, end: str, width: float = BIN) -> DataFrame:
    """rows with bin: one row for each bin that [begin, end] touches."""
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(end) / width))))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float = BIN) -> DataFrame:
    """Pairs of left (keys, a, b) and right (keys, ra, rb) that share more than a moment.

    Both are cut into bins of time and joined on (keys, bin), so a place's history is compared bin by bin
    instead of all with all; a pair that shares several bins is kept in the first of them only.
    """
    both = binned(left, "a", "b", width).join(binned(right, "ra", "rb", width), [*keys, "bin"])
    begins = F.greatest("a", "ra")
    return both.where((F.col("a") < F.col("rb")) & (F.col("b") > F.col("ra")) & (F.col("bin") == F.floor(begins / width))).drop("bin")


def sheltered(jobs: DataFrame, roofs: DataFrame, horizon: DataFrame, by: Sequence[str], width: float = BIN) -> DataFrame:
    """jobs with settled, unconfirmed: whether a shelter lasts long enough after the job.

    jobs: by, activity, start, hours, doing, settle; roofs: by, start, hours; horizon: by, horizon.
    The first shelter in which the job fits decides; one that reaches the horizon passes, unconfirmed.
    """
    keys = list(by)
    work = jobs.withColumns({"a": _hours("start"), "b": _hours("start") + F.col("hours")})
    roof = roofs.select(*by, _hours("start").alias("ra"), (_hours("start") + F.col("hours")).alias("rb")).join(horizon, keys)
    begin, end, enough = F.greatest("a", "ra"), F.least("b", "rb"), F.col("doing") + F.col("settle")
    fits = overlapping(work, roof, keys, width).where(end - begin >= F.col("doing")).withColumn("open", F.col("rb") >= F.col("horizon")).where((F.col("rb") - begin >= enough) | F.col("open"))
    first = fits.groupBy(*by, "activity", "start").agg(F.min_by((F.col("rb") - begin < enough) & F.col("open"), "ra").alias("unconfirmed"))
    return jobs.join(first, [*keys, "activity", "start"], "left").withColumns({"settled": F.col("unconfirmed").isNotNull(), "unconfirmed": F.coalesce("unconfirmed", F.lit(False))})


def last_moment(rows: DataFrame, gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, horizon: when the last reading's own spacing is over."""
    return rows.groupBy(*by).agg(F.max(_hours("ts")).alias("h")).join(gaps, list(by)).select(*by, (F.col("h") + F.col("spacing")).alias("horizon"))


def settled(rows: DataFrame, during: str, shelter: str, by: Sequence[str], doing: float, settle: float) -> DataFrame:
    """by, start, hours, settled, unconfirmed: runs of at least `doing` hours, and whether the shelter lasts long enough after the job."""
    gaps = spacing(rows, by)
    jobs = runs(rows, during, by, gaps).where(F.col("hours") >= doing).select(*by, F.lit("").alias("activity"), "start", "hours", F.lit(doing).alias("doing"), F.lit(settle).alias("settle"))
    return sheltered(jobs, runs(rows, shelter, by, gaps), last_moment(rows, gaps, by), by).select(*by, "start", "hours", "settled", "unconfirmed")
