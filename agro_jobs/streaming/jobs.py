"""Streaming forms: feedback upserts, the conversation fold, threshold alerts and roll-ups.

Event time is cast to TIMESTAMP at the source (watermarks need it), with the session in UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agro_jobs.functions.dims import NOTABLE
from agro_jobs.operators import convo, turns

FOLD_OUT = T.StructType([T.StructField(n, t) for n, t in (("chat_id", T.LongType()), ("turn", T.LongType()), ("operation", T.StringType()), ("intent", T.StringType()), ("places", T.StringType()), ("time", T.StringType()))])


def daily_rain(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """place_id, day, n, rain, peak, wet per tumbling day; rows later than the watermark are dropped."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", "1 day")
    out = rows.groupBy("place_id", w).agg(F.count("*").alias("n"), F.sum(F.col("Rainfall").cast("decimal(18,4)")).cast("double").alias("rain"), F.max("Rainfall").alias("peak"), F.count_if(F.col("Rainfall") >= 0.2).alias("wet"))
    return out.select("place_id", F.to_date("window.start").alias("day"), "n", "rain", "peak", "wet")


def alerts(readings: DataFrame) -> DataFrame:
    """place_id, ts, field, value, phrase: one row per notable limit crossed, stateless."""
    cells = F.array(*[
        F.when(F.col(f) <= t if low else F.col(f) >= t, F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(said).alias("phrase")))
        for f, t, said, low in NOTABLE if f in readings.columns
    ])
    return readings.select("place_id", "ts", F.inline(F.array_compact(cells)))


def _parts(events: DataFrame) -> DataFrame:
    """What is known of each turn's feedback, in a form that later events are merged into."""
    at = [F.col("ts"), F.col("id")]
    return events.where(F.col("kind").isNotNull()).groupBy("turn_id").agg(
        F.min(F.struct(*at)).alias("first"), F.max(F.struct(*at, "kind")).alias("last"), F.count("*").alias("n"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(*at, c))).alias(c) for c in ("intent", "note")],
    )


EVERY = 16  # versions after which one holds the whole table again


def feedback_sink(path: str, every: int = EVERY):
    """A foreachBatch function that folds feedback events into the table at path, kept as numbered versions.

    A version holds the turns that its batch touches, merged with what was known of them; every `every`-th one holds all
    turns. So a batch reads the versions since the last whole one only, however many there were before, and
    replaying a batch gives the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = _parts(batch)
        if number > 0:
            before = batch.sparkSession.read.parquet(path).where(F.col("batch").between((number - 1) // every * every, number - 1))
            if number % every:
                before = before.join(batch.select("turn_id").distinct(), "turn_id", "left_semi")
            before = turns.newest_per(before, "turn_id", "batch").drop("batch")
            new = before.unionByName(new).groupBy("turn_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.max("intent").alias("intent"), F.max("note").alias("note"))
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def feedback_state(spark, path: str, every: int = EVERY) -> DataFrame:
    """turn_id, id, first_ts, updated_at, revisions, kind, intent, note: the newest version of every turn."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("batch")).first()[0] or 0
    rows = turns.newest_per(versions.where(F.col("batch") >= newest // every * every), "turn_id", "batch")
    return rows.select(
        "turn_id", F.col("first.id").alias("id"), F.col("first.ts").alias("first_ts"), F.col("last.ts").alias("updated_at"), (F.col("n") - 1).alias("revisions"),
        F.col("last.kind").alias("kind"), F.col("intent.intent").alias("intent"), F.col("note.note").alias("note"),
    )


SEEN = ("turn", "intent", "places", "time", "silent", "op_first", "op_later", "ts")


class ChatFold(StatefulProcessor):
    """Keeps one state per chat. With `idle` (milliseconds of event time), a chat starts anew after a longer gap.

    The gap itself decides, so reruns agree however turns fall into batches; a timer only frees the
    state once the watermark says that no turn of the old chat can come any more.
    """

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("last", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("intent", "places", "time")]]
        self.state = handle.getValueState("chat", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, held = None, {}
        if self.state.exists():
            last, *values = self.state.get()
            held = dict(zip(("intent", "places", "time"), values, strict=True))
        seen = sorted((row for part in rows for row in part[list(SEEN)].itertuples(index=False, name=None)), key=lambda r: r[0])  # of one chat, in one batch
        out = []
        for turn, intent, places, time, silent, op_first, op_later, ts in seen:
            at = int(pd.Timestamp(ts).value // 1_000_000) if self.idle else 0
            if last is not None and self.idle and at - last > self.idle:
                last = None
            if last is None:
                held = {}
            op = op_first if last is None else op_later
            if not (op in convo.FRAGMENT and silent and held.get("intent")):
                held["intent"] = intent
            if op in ("SET", "COMPARE", "REPLACE") and places:
                held["places"] = places
            if op == "SET" or (op in ("COMPARE", "MODIFY", "INHERIT") and time):
                held["time"] = time or None
            last = at
            out.append((key[0], turn, op, held.get("intent"), held.get("places"), held.get("time")))
        self.state.update((last, held.get("intent"), held.get("places"), held.get("time")))
        if self.idle:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle + 1)
        yield pd.DataFrame(out, columns=[f.name for f in FOLD_OUT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def conversation(turns_stream: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """The fold of `operators.convo` as a stream; with `idle` (an interval such as "1 day") over turns that carry ts."""
    first = convo.operation(F.lit(True))
    rows = turns_stream.withColumns({"op_first": first, "op_later": convo.operation(F.lit(False))})
    if idle is None:
        return rows.withColumn("ts", F.lit(None).cast("timestamp")).groupBy("chat_id").transformWithStateInPandas(ChatFold(), FOLD_OUT, "append", "None")
    gap = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("chat_id").transformWithStateInPandas(ChatFold(gap), FOLD_OUT, "append", "EventTime")
