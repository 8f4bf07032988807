"""Generating labelled rows: frames filled with places, times and entities, picked by hashes of stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(n: Column, *keys: Column, seed: int = 0) -> Column:
    """A number below n that depends on the keys alone."""
    said = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.pmod(F.conv(F.left(F.md5(said.cast("binary")), F.lit(8)), 16, 10).cast("bigint"), n).cast("bigint")


def numbered(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """A small dimension with positions from 0 (one window over the dimension, not over data)."""
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"))


def filled(keys: DataFrame, frames: DataFrame, places: DataFrame, times: DataFrame, seed: int = 0) -> DataFrame:
    """row_id, frame, text, spans, activity: every key takes a frame, a place and a time by its hash.

    frames: frame, template ({place} and {time}), activity. The three dimensions are joined on
    the picked position, so no row meets more than one of each.
    """
    dims = {"frame": numbered(frames, "frame"), "place": numbered(places, "place"), "time": numbered(times, "time")}
    out = keys
    for i, (name, dim) in enumerate(dims.items()):
        n = dim.count()
        out = out.withColumn("pos", pick(F.lit(n), F.col("row_id"), seed=seed + i)).join(dim, "pos").drop("pos")
    text = F.replace(F.replace(F.col("template"), F.lit("{place}"), F.col("place")), F.lit("{time}"), F.col("time"))
    return out.select("row_id", "frame", text.alias("text"), F.array("place", "time").alias("spans"), "activity")


SLOT = r"\{([a-z0-9_]+)\}"
#: Percent of places that are written as a code, misspelt, qualified; and of all others in lower case.
CODE, MISSPELT, QUALIFIED, LOWER = 8, 24, 20, 25


def surface(place: Column, qualified: Column, codes: Column, misspellings: Column, key: Column, seed: int = 0) -> Column:
    """STRUCT<span, form>: how a place is written: by one of its codes, misspelt, with what it lies in, or as it is; all but codes in lower case at a rate.

    A place without codes or misspellings is written as if the draw had fallen on the next form.
    """
    def one(options: Column, seed: int) -> Column:
        return F.get(options, pick(F.greatest(F.size(options), F.lit(1)), key, seed=seed).cast("int"))

    u = pick(F.lit(100), key, seed=seed)
    form = (
        F.when((F.size(codes) > 0) & (u < CODE), "code").when((F.size(misspellings) > 0) & (u < CODE + MISSPELT), "misspelt")
        .when(u < CODE + MISSPELT + QUALIFIED, "qualified").otherwise("plain")
    )
    written = F.when(form == "code", one(codes, seed + 1)).when(form == "misspelt", one(misspellings, seed + 2)).when(form == "qualified", qualified).otherwise(place)
    lowered = (pick(F.lit(100), key, seed=seed + 3) < LOWER) & (form != "code")
    return F.struct(F.when(lowered, F.lower(written)).otherwise(written).alias("span"), form.alias("form"))


def phrased(keys: DataFrame, frames: DataFrame, places: DataFrame, words: dict[str, tuple[str, ...]], seed: int = 0) -> DataFrame:
    """row_id, the columns of its frame, text, marks: every key takes a frame by its hash, and each slot of the frame a value of its own.

    frames: frame, template and labels. A slot {place}, {place2}, ... takes a place; any other one a word of
    words[slot]. marks is ARRAY<STRUCT<slot, span, start, end>> in code points, end exclusive: offsets come from the
    lengths of what stands before, so a span that occurs twice is still told apart. Places are joined on the picked
    position; words are closed vocabularies and travel in the plan.
    """
    dim, n = numbered(frames, "frame"), frames.count()
    out = keys.withColumn("pos", pick(F.lit(n), F.col("row_id"), seed=seed)).join(F.broadcast(dim), "pos").drop("pos")
    wanted = sorted(r["s"] for r in frames.select(F.explode(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1))).alias("s")).distinct().collect())
    spots, many = numbered(places.select("place"), "place"), places.count()
    named = [s for s in wanted if s.startswith("place")]
    for i, slot in enumerate(named):
        out = out.withColumn("pos", pick(F.lit(many), F.col("row_id"), seed=seed + 1 + i)).join(spots.withColumnRenamed("place", f"_{slot}"), "pos", "left").drop("pos")
    slots, literals = F.regexp_extract_all("template", F.lit(SLOT), F.lit(1)), F.split("template", SLOT)

    def value(slot: Column, i: Column) -> Column:
        said = F.lit(None).cast("string")
        for w in wanted:
            if w in named:
                said = F.when(slot == w, F.col(f"_{w}")).otherwise(said)
            else:
                said = F.when(slot == w, F.get(F.array(*map(F.lit, words[w])), pick(F.lit(len(words[w])), F.col("row_id"), i, slot, seed=seed).cast("int"))).otherwise(said)
        return F.struct(slot.alias("slot"), said.alias("span"), F.get("_literals", i + 1).alias("after"))

    out = out.withColumn("_literals", literals).withColumn("_values", F.transform(slots, value))
    empty = F.array().cast("array<struct<slot:string,span:string,start:int,end:int>>")

    def add(acc: Column, v: Column) -> Column:
        start = F.char_length(acc["text"])
        mark = F.struct(v["slot"].alias("slot"), v["span"].alias("span"), start.alias("start"), (start + F.char_length(v["span"])).alias("end"))
        return F.struct(F.concat(acc["text"], v["span"], v["after"]).alias("text"), F.concat(acc["marks"], F.array(mark)).alias("marks"))

    made = F.aggregate("_values", F.struct(F.get("_literals", F.lit(0)).alias("text"), empty.alias("marks")), add)
    labels = [c for c in frames.columns if c != "template"]
    return out.withColumn("_made", made).select("row_id", *labels, F.col("_made.text").alias("text"), F.col("_made.marks").alias("marks"))


def spans_of(marks: str, slots: str) -> Column:
    """The spans of the slots whose name begins so, in order."""
    return F.transform(F.filter(marks, lambda m: m["slot"].startswith(slots)), lambda m: m["span"])


def conversations(openings: DataFrame, follow: DataFrame, places: DataFrame, times: tuple[str, ...], most: int = 3, seed: int = 0) -> DataFrame:
    """chat_id, turn, text, operation, place, time, ctx_place, ctx_time: each opening (row_id, text, marks) is turn 0 of a chat that goes on for 1 to `most` turns.

    follow: frame, template, operation (REPLACE with {place}, MODIFY with {time}, INHERIT with neither). The context is
    the last place and the last time that were said.
    """
    chat = F.col("row_id")
    first = openings.select(chat.alias("chat_id"), F.lit(0).alias("turn"), "text", F.lit("SET").alias("operation"), F.get(spans_of("marks", "place"), F.lit(0)).alias("place"), F.get(spans_of("marks", "time"), F.lit(0)).alias("time"))
    turns = openings.select(chat.alias("chat_id"), F.explode(F.sequence(F.lit(1), (pick(F.lit(most), chat, seed=seed + 50) + 1).cast("int"))).alias("turn"))
    keys = turns.withColumn("row_id", F.concat_ws("/", "chat_id", "turn"))
    later = phrased(keys.select("row_id"), follow, places, {"time": times}, seed + 60).join(keys, "row_id")
    later = later.select("chat_id", "turn", "text", "operation", F.get(spans_of("marks", "place"), F.lit(0)).alias("place"), F.get(spans_of("marks", "time"), F.lit(0)).alias("time"))
    upto = Window.partitionBy("chat_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return first.unionByName(later).withColumns({f"ctx_{c}": F.last(c, ignorenulls=True).over(upto) for c in ("place", "time")})


def chats(rows: DataFrame, turns: int = 3) -> DataFrame:
    """chat_id, turn, text, place: each row opens a chat; later turns lean on it and carry its place."""
    t = rows.select(F.col("row_id").alias("chat_id"), "text", F.get("spans", F.lit(0)).alias("place"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    follow = F.element_at(F.array(F.lit("what about tomorrow?"), F.lit("and there next week?"), F.lit("and the wind?")), (pick(F.lit(3), F.col("chat_id"), F.col("turn")) + 1).cast("int"))
    return t.select("chat_id", "turn", F.when(F.col("turn") == 0, F.col("text")).otherwise(follow).alias("text"), "place")


def paraphrased(rows: DataFrame, frames: DataFrame, rate: int = 30) -> DataFrame:
    """Rows of a share of the keys once more, through the next frame of the same activity, with a shared group id."""
    n = Window.partitionBy("activity").orderBy("frame")
    ring = frames.withColumn("k", F.row_number().over(n) - 1).withColumn("of", F.count("*").over(Window.partitionBy("activity")))
    again = ring.select("activity", F.col("frame").alias("frame2"), F.col("template").alias("template2"), F.pmod(F.col("k") - 1, F.col("of")).alias("k"))
    nxt = ring.join(again, ["activity", "k"]).select("frame", "frame2", "template2").where("frame != frame2")
    chosen = rows.where(pick(F.lit(100), F.col("row_id"), seed=77) < rate).join(F.broadcast(nxt), "frame")
    text = F.replace(F.replace(F.col("template2"), F.lit("{place}"), F.get("spans", F.lit(0))), F.lit("{time}"), F.get("spans", F.lit(1)))
    more = chosen.select("row_id", F.col("frame2").alias("frame"), text.alias("text"), "spans", "activity").withColumn("paraphrase", F.col("row_id"))
    return rows.withColumn("paraphrase", F.when(pick(F.lit(100), F.col("row_id"), seed=77) < rate, F.col("row_id"))).unionByName(more)
