"""How complete readings are: coverage per field, day gaps, a status and its caveat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.functions.dims import GOOD, USABLE


def coverage(rows: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, field, n_rows, n_clean, share: the share of rows with a clean value (rows are clean already)."""
    wide = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count(f).alias(f) for f in fields])
    return wide.unpivot([*by, "n_rows"], list(fields), "field", "n_clean").withColumn("share", F.col("n_clean").cast("double") / F.col("n_rows"))


def day_gaps(rows: DataFrame, by: Sequence[str], expected: int | None = None) -> DataFrame:
    """by, days, gaps: days without any reading; expected days default to the span of the rows."""
    day = F.to_date("ts")
    want = F.lit(expected) if expected else F.datediff(F.max(day), F.min(day)) + 1
    days = F.countDistinct(day)
    return rows.groupBy(*by).agg(days.alias("days"), F.greatest(want - days, F.lit(0)).cast("long").alias("gaps"))


def status(rows: DataFrame, fields: Sequence[str], by: Sequence[str], required: Sequence[str] = (), expected: int | None = None) -> DataFrame:
    """by, n_rows, usable, unusable, gaps, status, can_answer, can_decide, caveat.

    Empty groups have no row here: a left join to the wanted groups reads as NO_DATA.
    """
    day = F.to_date("ts")
    want = F.lit(expected) if expected else F.datediff(F.max(day), F.min(day)) + 1
    shares = F.array(*[F.struct(F.lit(f).alias("field"), (F.count(f).cast("double") / F.count("*")).alias("share")) for f in fields])
    out = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), shares.alias("s"), F.greatest(want - F.countDistinct(day), F.lit(0)).cast("long").alias("gaps"))
    usable = F.transform(F.filter("s", lambda x: x.share >= USABLE), lambda x: x.field)
    unusable = F.transform(F.filter("s", lambda x: x.share < USABLE), lambda x: x.field)
    out = out.withColumns({"usable": usable, "unusable": unusable})
    lacking = F.size(F.array_intersect("unusable", F.array(*map(F.lit, required)).cast("array<string>"))) > 0 if required else F.lit(False)
    good = F.forall("s", lambda x: x.share >= GOOD) & (F.size("unusable") == 0) & (F.col("gaps") == 0)
    state = F.when((F.size("usable") == 0) | lacking, "SPARSE").when(good, "OK").otherwise("PARTIAL")
    out = out.withColumn("status", state)
    said = F.when(F.col("status") == "PARTIAL", F.concat_ws("; ", F.when(F.size("unusable") > 0, F.concat(F.lit("no usable "), F.concat_ws(", ", "unusable"))), F.when(F.col("gaps") > 0, F.concat(F.col("gaps").cast("string"), F.lit(" days missing")))))
    return out.drop("s").withColumns({"can_answer": F.col("status").isin("OK", "PARTIAL"), "can_decide": F.col("status").isin("OK", "PARTIAL"), "caveat": F.coalesce(said, F.lit(""))})


def served(rows: DataFrame, fields: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, fields: those with a clean value anywhere in the group, or all where none has one; order kept."""
    got = F.array_compact(F.array(*[F.when(F.max(F.col(f).isNotNull()), F.lit(f)) for f in fields]))
    everything = F.array(*map(F.lit, fields))
    return rows.groupBy(*by).agg(got.alias("f")).select(*by, F.when(F.size("f") > 0, F.col("f")).otherwise(everything).alias("fields"))
