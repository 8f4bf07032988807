"""Comparing places, remarks worth making unasked, and series shaped for a picture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.functions.dims import NOTABLE

EXACT = "decimal(18,4)"


def ranked(rows: DataFrame, field: str, place: str, by: Sequence[str], total: bool) -> DataFrame:
    """by, place, figure, rank, gap: the headline figure of each place, and the distance from first to last."""
    s = F.sum(F.col(field).cast(EXACT)).cast("double")
    figures = rows.groupBy(place, *by).agg((s if total else s / F.nullif(F.count(field), F.lit(0))).alias("figure")).where("figure IS NOT NULL")
    w = Window.partitionBy(*by)
    return figures.withColumns({"rank": F.rank().over(w.orderBy(F.desc("figure"), place)), "gap": F.max("figure").over(w) - F.min("figure").over(w)})


def table(rows: DataFrame, field: str, place: str, places: Sequence[int], label: str) -> DataFrame:
    """label and one column per place: the last reading under each label."""
    wanted = rows.where(F.col(place).isin(*places) )
    last = [F.max_by(F.when((F.col(place) == p), F.col(field)), F.when((F.col(place) == p) & F.col(field).isNotNull(), F.struct("ts", "event_id"))).alias(f"p{p}") for p in places]
    return wanted.groupBy(label).agg(*last)


def crossings(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, field, crossings, extreme, phrase: notable limits that were crossed, all in one pass."""
    known = [x for x in NOTABLE if x[0] in rows.columns]
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.count_if(F.col(f) <= t if low else F.col(f) >= t).alias("crossings"), (F.min if low else F.max)(f).alias("extreme"), F.lit(said).alias("phrase"))
        for f, t, said, low in known
    ])
    return rows.groupBy(*by).agg(cells.alias("c")).select(*by, F.inline("c")).where("crossings > 0")


def notes(rows: DataFrame, by: Sequence[str], ranges: Sequence[str], most: int = 4) -> DataFrame:
    """by, kind, field, priority: at most `most` remarks, ranges first, then limits, then dry spells."""
    spans = F.array(*[F.struct(F.lit("RANGE").alias("kind"), F.lit(f).alias("field"), F.lit(1).alias("priority"), (F.count(f) > 1).alias("said")) for f in ranges])
    dry = F.array(F.struct(F.lit("DRY_SPELL").alias("kind"), F.lit("Rainfall").alias("field"), F.lit(3).alias("priority"), ((F.count_if(F.col("Rainfall") < 1) > 0) & (F.count("Rainfall") > 2)).alias("said")))
    limits = F.array(*[
        F.struct(F.lit("THRESHOLD").alias("kind"), F.lit(f).alias("field"), F.lit(2).alias("priority"), (F.count_if(F.col(f) <= t if low else F.col(f) >= t) > 0).alias("said"))
        for f, t, _, low in NOTABLE if f in rows.columns
    ])
    every = rows.groupBy(*by).agg(F.concat(spans, limits, dry).alias("c")).select(*by, F.inline("c")).where("said")
    w = Window.partitionBy(*by).orderBy("priority", "field")
    return every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)


def remarks(rows: DataFrame, question: Sequence[str], place: str, field: str, total: bool = False, most: int = 4) -> DataFrame:
    """question, pos, kind, place, text: at most `most` remarks on a question's field, what compares its places first.

    Then, place by place: mean and range, limits crossed, dry readings (of rain). One aggregate over the readings.
    """
    v, one = F.col(field), lambda c: F.format_string("%.1f", F.bround(c, 1))
    limit = next(((t, said, low) for f, t, said, low in NOTABLE if f == field), None)
    crossed = (v <= limit[0] if limit[2] else v >= limit[0]) if limit else F.lit(False)
    mean = F.sum(v.cast(EXACT)).cast("double") / F.count(v)
    per = rows.groupBy(*question, place).agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), mean.alias("mean"), F.sum(v.cast(EXACT)).cast("double").alias("total"), F.count_if(crossed).alias("over"), F.count_if(v < 1.0).alias("dry")
    ).where("n > 0")
    figure, first = F.col("total" if total else "mean"), Window.partitionBy(*question)
    lead = per.groupBy(*question).agg(F.count("*").alias("k"), F.min_by(place, F.struct(-figure, place)).alias("a"), F.max_by(place, F.struct(-figure, place)).alias("b"), (F.max(figure) - F.min(figure)).alias("gap")).where("k > 1")
    word = "total" if total else "mean"
    lead = lead.select(*question, F.lit(0).alias("at"), F.lit(0).alias("o"), F.lit("COMPARISON").alias("kind"), F.lit(None).cast("string").alias("place"), F.concat(F.col("a").cast("string"), F.lit(" leads "), F.col("b").cast("string"), F.lit(" by "), one("gap"), F.lit(f" on {word} {field}")).alias("text"))
    said = [
        F.when(F.lit(not total) & (F.col("n") > 1), F.struct(F.lit(1).alias("o"), F.lit("RANGE").alias("kind"), F.concat(F.lit("mean "), one("mean"), F.lit(", range "), one("low"), F.lit("-"), one("high")).alias("text"))),
        F.when(F.col("over") > 0, F.struct(F.lit(2).alias("o"), F.lit("THRESHOLD").alias("kind"), F.concat(F.lit(f"{limit[1] if limit else ''} on "), F.col("over").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("text"))),
        F.when(F.lit(field == "Rainfall") & (F.col("n") > 2) & (F.col("dry") > 0), F.struct(F.lit(3).alias("o"), F.lit("DRY_SPELL").alias("kind"), F.concat(F.col("dry").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" dry")).alias("text"))),
    ]
    each = per.withColumn("at", F.dense_rank().over(first.orderBy(place))).select(*question, "at", F.col(place).cast("string").alias("place"), F.explode(F.array_compact(F.array(*said))).alias("s"))
    each = each.select(*question, "at", "s.o", "s.kind", "place", "s.text")
    pos = F.row_number().over(first.orderBy("at", "o"))
    return lead.unionByName(each).withColumn("pos", pos).where(F.col("pos") <= most).select(*question, "pos", "kind", "place", "text")


def watching(rows: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """by, said: what an alert on a field says first: its peak in the rows there are."""
    peak = rows.groupBy(*by).agg(F.max(field).alias("peak"))
    said = F.when(F.col("peak").isNull(), F.lit(f"no {field} values")).otherwise(F.concat(F.lit(f"watching {field}, peak in range "), F.format_string("%.1f", F.bround("peak", 1))))
    return peak.select(*by, said.alias("said"))


def band(rows: DataFrame, low: str, high: str, by: Sequence[str]) -> DataFrame:
    """by, day, low, high, mid."""
    return rows.groupBy(*by, F.to_date("ts").alias("day")).agg(F.min(low).alias("low"), F.max(high).alias("high"), ((F.min(low) + F.max(high)) / 2).alias("mid"))


def grid(rows: DataFrame, field: str, by: Sequence[str]) -> DataFrame:
    """by, day, hour, mean, n: cells of a day x hour picture."""
    cells = rows.groupBy(*by, F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    return cells.agg((F.sum(F.col(field).cast(EXACT)).cast("double") / F.nullif(F.count(field), F.lit(0))).alias("mean"), F.count(field).alias("n")).where("n > 0")
