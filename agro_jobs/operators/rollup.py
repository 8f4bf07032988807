"""Coarser grains, larger areas, and comparison with another period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = "decimal(18,4)"


def _sum(c: str) -> F.Column:
    return F.sum(F.col(c).cast(EXACT)).cast("double")


def grain(rows: DataFrame, unit: str, by: Sequence[str]) -> DataFrame:
    """by, grain, period, n and the fields: what adds up is summed, extremes stay extremes, the rest is averaged."""
    return rows.groupBy(*by, F.lit(unit).alias("grain"), F.to_date(F.date_trunc(unit, "ts")).alias("period")).agg(
        _sum("Rainfall").alias("Rainfall"), F.max("Tmax").alias("Tmax"), F.min("Tmin").alias("Tmin"), (_sum("RH") / F.nullif(F.count("RH"), F.lit(0))).alias("RH"), F.count("*").alias("n")
    )


def areas(rows: DataFrame, chain: DataFrame, field: str, levels: Sequence[str]) -> DataFrame:
    """levels, rain, mean, level: sub-totals of every level of the chain and the grand total, in one pass."""
    return rows.join(chain, "place_id").rollup(*levels).agg(_sum(field).alias("rain"), (_sum(field) / F.count("*")).alias("mean"), F.grouping_id().cast("int").alias("level"))


def against(daily: DataFrame, field: str, months: int) -> DataFrame:
    """place_id, month, rain, before, difference, ratio: each month and the one so many months before."""
    monthly = daily.groupBy("place_id", F.to_date(F.date_trunc("month", "day")).alias("month")).agg(_sum(field).alias("rain"))
    before = monthly.select("place_id", F.add_months("month", months).alias("month"), F.col("rain").alias("before"))
    out = monthly.join(before, ["place_id", "month"], "left")
    return out.withColumns({"difference": F.col("rain") - F.col("before"), "ratio": F.try_divide("rain", "before")})


def against_normal(daily: DataFrame, field: str) -> DataFrame:
    """place_id, month, mean, normal, difference."""
    mean, normal = _sum(field) / F.count("*"), _sum(f"Normal_{field}") / F.count("*")
    return daily.groupBy("place_id", F.to_date(F.date_trunc("month", "day")).alias("month")).agg(mean.alias("mean"), normal.alias("normal"), (mean - normal).alias("difference"))


def stitch(rows: DataFrame, field: str, by: Sequence[str], hours: int = 24) -> DataFrame:
    """by, ts, grain, field: the first hours as they are, the rest as daily totals."""
    edge = rows.groupBy(*by).agg((F.min("ts") + F.expr(f"INTERVAL {hours} HOUR")).alias("edge"))
    both = rows.join(edge, list(by))
    near = both.where("ts < edge").select(*by, "ts", F.lit("hourly").alias("grain"), field)
    kind = dict(rows.dtypes)["ts"]
    far = both.where("ts >= edge").groupBy(*by, F.to_date("ts").cast(kind).alias("ts")).agg(F.lit("daily").alias("grain"), _sum(field).alias(field))
    return near.unionByName(far)


def weekly_report(rows: DataFrame, field: str) -> DataFrame:
    """place_id, week, n_rows, share, total, average, peak, status: one question, answered for every place and week."""
    share = F.count(field).cast("double") / F.count("*")
    day = F.to_date("ts")
    gaps = F.datediff(F.max(day), F.min(day)) + 1 - F.countDistinct(day)
    return rows.groupBy("place_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(
        F.count("*").alias("n_rows"), share.alias("share"), _sum(field).alias("total"), (_sum(field) / F.nullif(F.count(field), F.lit(0))).alias("average"), F.max(field).alias("peak"),
        F.when(share < 0.6, "SPARSE").when((share >= 0.9) & (gaps <= 0), "OK").otherwise("PARTIAL").alias("status"),
    )
