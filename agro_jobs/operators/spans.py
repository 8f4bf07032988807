"""Small rules over spans and labels: splitting, finding, capping, coercing, describing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.functions.text import ENTITIES

#: Words that are never a place by themselves.
STOP = ("the", "is", "in", "at", "on", "and", "or", "to", "of", "for", "will", "what", "how", "today", "tomorrow", "rain", "weather", "wind", "should", "can", "my", "me", "it", "be", "this", "next", "week")


def split_span(span: Column) -> Column:
    """The places of a comma span: one address (two or three parts, the last a qualifier) stays whole, a longer list is cut."""
    parts = F.transform(F.split(span, ","), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: p != "")
    return F.when(F.size(kept) <= 3, F.array(F.array_join(kept, ", "))).otherwise(kept)


def find_in(texts: DataFrame, gazetteer: DataFrame, most: int = 2) -> DataFrame:
    """id, place_id, pos: words of untagged texts that are names, stop words out, the first `most`."""
    words = texts.select("id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("pos", "word")).where(~F.col("word").isin(*STOP))
    hits = words.join(gazetteer.groupBy(F.lower("name").alias("word")).agg(F.min("id").alias("place_id")), "word")
    first = hits.groupBy("id", "place_id").agg(F.min("pos").alias("pos"))
    r = F.row_number().over(Window.partitionBy("id").orderBy("pos", "place_id"))
    return first.withColumn("r", r).where(F.col("r") <= most).drop("r")


def capped_places(resolved: DataFrame, most: int = 3) -> DataFrame:
    """resolved (question, span, place_id) with fate: kept, dropped (over the cap) or unresolved."""
    hit = F.col("place_id").isNotNull()
    n = F.sum(hit.cast("int")).over(Window.partitionBy("question").orderBy("span"))
    return resolved.withColumn("fate", F.when(~hit, "unresolved").when(n <= most, "kept").otherwise("dropped"))


def vocabulary_report(spark) -> DataFrame:
    """type, terms, shared: terms per type, and how many of them another type has too."""
    t = spark.createDataFrame([(k, x) for k, xs in ENTITIES.items() for x in xs], "type string, term string")
    both = t.groupBy("term").agg(F.count("*").alias("k"))
    return t.join(both, "term").groupBy("type").agg(F.count("*").alias("terms"), F.count_if(F.col("k") > 1).alias("shared"))


def activity_of(text: Column, cues: dict[str, str], annotated: Column) -> Column:
    """The annotated activity, else that of the longest cue in the text."""
    out = F.lit(None).cast("string")
    for cue, activity in sorted(cues.items(), key=lambda c: (len(c[0]), c[0])):
        out = F.when(F.lower(text).contains(cue), activity).otherwise(out)
    return F.coalesce(annotated, out)


def coerced(payload: Column, text: Column, intents: tuple[str, ...], variables: tuple[str, ...]) -> Column:
    """STRUCT<intent, variables, places> of a model's JSON: unknown labels go, places must occur in the text."""
    p = F.from_json(payload, "intent STRING, variables ARRAY<STRING>, places ARRAY<STRING>")
    intent = F.when(p["intent"].isin(*intents), p["intent"]).otherwise(intents[0])
    known = F.array_intersect(F.coalesce(p["variables"], F.array().cast("array<string>")), F.array(*map(F.lit, variables)))
    said = F.filter(F.coalesce(p["places"], F.array().cast("array<string>")), lambda s: F.lower(text).contains(F.lower(s)))
    return F.struct(intent.alias("intent"), known.alias("variables"), said.alias("places"))


def run_label(start: Column, hours: Column) -> Column:
    """A stretch in words: whole days as dates, shorter ones by the clock."""
    end = F.timestamp_add("HOUR", hours.cast("int"), start.cast("timestamp"))
    clock = F.concat(F.date_format(start, "dd MMM HH:mm"), F.lit(" to "), F.date_format(end, "HH:mm"))
    return F.when(hours >= 24, F.concat(F.date_format(start, "dd MMM"), F.lit(" to "), F.date_format(end, "dd MMM"))).otherwise(clock)


def from_duration(amount: Column, unit: str, text: Column, now: Column) -> Column:
    """STRUCT<start, end> of a duration without an anchor: backwards if the text looks back."""
    back = F.lower(text).rlike(r"\b(last|past|previous|ago|history|so far)\b")
    there, here = F.timestamp_add(unit, amount, now), F.timestamp_add(unit, -amount, now)
    return F.struct(F.when(back, here).otherwise(now).alias("start"), F.when(back, now).otherwise(there).alias("end"))


def length_quartiles(rows: DataFrame, by: str) -> DataFrame:
    """by, q1, q2, q3 of words per text."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    return rows.groupBy(by).agg(F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select(by, *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])


def slot_presence(rows: DataFrame, slots: tuple[str, ...]) -> DataFrame:
    """slot, share: how often each column has something in it."""
    return rows.agg(*[(F.count(s).cast("double") / F.count("*")).alias(s) for s in slots]).unpivot([], list(slots), "slot", "share")
