"""The question log and its feedback: one opinion per turn, review queues, labelled rows, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATA_INTENTS, TALK, DECLINED = ("ADVICE", "FORECAST", "HISTORY"), ("GREETING",), ("OUT_OF_SCOPE",)
ACCEPT, THIN = 0.95, 0.45


def untagged(text: Column) -> Column:
    """The text without its leading [model] tag."""
    return F.trim(F.regexp_replace(F.trim(text), r"^\[[^\]]*\]", ""))


def model_of(text: Column) -> Column:
    """The model named by the tag, else legacy."""
    m = F.regexp_extract(F.trim(text), r"^\[([^\]]*)\]", 1)
    return F.when(m != "", m).otherwise("legacy")


def folded(events: DataFrame) -> DataFrame:
    """turn_id, id, first_ts, updated_at, revisions, kind, intent, note: events of a turn in time order; NULL keeps what was said before."""
    at = F.struct("ts", "id")

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), at))

    return events.where(F.col("kind").isNotNull()).groupBy("turn_id").agg(
        F.min_by("id", at).alias("id"), F.min("ts").alias("first_ts"), F.max("ts").alias("updated_at"), (F.count("*") - 1).alias("revisions"),
        F.max_by("kind", at).alias("kind"), last("intent").alias("intent"), last("note").alias("note"),
    )


def newest_per(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def chats(turns: DataFrame, limit: int = 40) -> DataFrame:
    """chat_id, turns, first, last, answered, title: newest first."""
    rows = turns.groupBy("chat_id").agg(
        F.count("*").alias("turns"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("outcome") == "answered").alias("answered"),
        F.substring(untagged(F.min_by("text", "id")), 1, 80).alias("title"),
    )
    return rows.orderBy(F.desc("last")).limit(limit)


def last_state(turns: DataFrame) -> DataFrame:
    """chat_id, state: the newest that is not null."""
    return turns.where(F.col("state").isNotNull()).groupBy("chat_id").agg(F.max_by("state", "id").alias("state"))


def conversations(turns: DataFrame, decoded: dict[str, str]) -> DataFrame:
    """Every chat's turns with pos, their place in it; JSON columns are decoded by their types."""
    pos = F.row_number().over(Window.partitionBy("chat_id").orderBy("id")).cast("long")
    return turns.withColumns({"pos": pos} | {c: F.from_json(c, kind) for c, kind in decoded.items()})


def recent(turns: DataFrame, n: int = 3, answer: str = "answer") -> DataFrame:
    """chat_id, exchanges: question and answer of the last n answered turns, the oldest first."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    rows = turns.where("outcome = 'answered'").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return rows.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("text").alias("question"), F.col(answer).alias("answer")))).alias("x")).select("chat_id", F.transform("x", lambda e: F.struct(e.question, e.answer)).alias("exchanges"))


def usage(turns: DataFrame) -> DataFrame:
    """outcome (null: all), turns, sessions, chats, confidence, latency: grouping sets, one pass."""
    return turns.rollup("outcome").agg(
        F.count("*").alias("turns"), F.countDistinct("session").alias("sessions"), F.countDistinct("chat_id").alias("chats"),
        (F.sum(F.col("confidence").cast("decimal(18,4)")).cast("double") / F.count("confidence")).alias("confidence"), (F.sum("latency_ms").cast("double") / F.count("*")).alias("latency"),
    )


def confusion(turns: DataFrame, feedback: DataFrame) -> DataFrame:
    """actual, predicted, n over turns that a person labelled."""
    f = feedback.where(F.col("kind").isin("choice", "correction") & F.col("intent").isNotNull()).select("turn_id", F.col("intent").alias("actual"))
    return turns.select(F.col("id").alias("turn_id"), F.col("intent").alias("predicted")).join(f, "turn_id").groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def worst(pairs: DataFrame, top: int = 5) -> DataFrame:
    """The commonest pairs, and of those the ones that are wrong."""
    return pairs.orderBy(F.desc("n"), "actual", "predicted").limit(top).where("actual != predicted")


def close_calls(scored: DataFrame, gap: float = 0.25, limit: int = 10) -> DataFrame:
    """id, margin: scores is a map; turns whose two best scores are less than the gap apart, the nearest first."""
    best = F.reverse(F.array_sort(F.map_values("scores")))
    rows = scored.withColumn("margin", F.get(best, F.lit(0)) - F.get(best, F.lit(1)))
    return rows.where(F.col("margin") < gap).select("id", F.round("margin", 6).alias("margin")).orderBy("margin", "id").limit(limit)


def labelled(turns: DataFrame, feedback: DataFrame, approved: bool = False, least: float = 0.9) -> DataFrame:
    """text, intent, source_kind: a person's label where there is one, else the prediction; the first by feedback id per text."""
    kinds = ["choice", "correction"] + (["up"] if approved else [])
    f = feedback.where(F.col("kind").isin(*kinds)).select("turn_id", F.col("id").alias("fid"), "kind", F.col("intent").alias("said"))
    rows = turns.select(F.col("id").alias("turn_id"), "text", "intent", "confidence").join(f, "turn_id")
    rows = rows.where((F.col("kind") != "up") | (F.coalesce("confidence", F.lit(0.0)) >= least)).withColumn("text", untagged(F.col("text"))).where("text != ''")
    w = Window.partitionBy(F.lower("text")).orderBy("fid")
    rows = rows.withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("text", F.coalesce(F.nullif("said", F.lit("")), "intent").alias("intent"), F.col("kind").alias("source_kind")).where("intent IS NOT NULL")


def review_queue(turns: DataFrame, feedback: DataFrame, limit: int = 50) -> DataFrame:
    """id, text, confidence, flagged: turns to look at, the flagged first, then the least certain."""
    f = feedback.select(F.col("turn_id").alias("id"), "kind")
    rows = turns.join(f, "id", "left").groupBy("id", "text", "confidence", "outcome").agg(
        F.max(F.coalesce((F.col("kind") == "down").cast("int"), F.lit(0))).alias("flagged"), F.max(F.coalesce(F.col("kind").isin("choice", "correction", "up").cast("int"), F.lit(0))).alias("settled"))
    wanted = rows.where((F.col("flagged") == 1) | (F.col("outcome").isin("uncertain", "clarified") & (F.col("settled") == 0)))
    return wanted.orderBy(F.desc("flagged"), F.asc_nulls_first("confidence"), "id").limit(limit).select("id", "text", "confidence", "flagged")


def failed(turns: DataFrame, feedback: DataFrame, limit: int = 500) -> DataFrame:
    """id, text, outcome, cause, corrected: what did not answer, the newest first."""
    f = feedback.select(F.col("turn_id").alias("id"), "kind", F.col("intent").alias("corrected"), "note")
    rows = turns.join(f, "id", "left").where(F.col("outcome").isin("failed", "clarified") | F.col("kind").isin("down", "correction"))
    cause = F.coalesce("note", F.when(F.col("outcome") == "clarified", "no_place_named").otherwise(F.col("outcome")))
    return rows.orderBy(F.desc("id")).limit(limit).select("id", untagged(F.col("text")).alias("text"), "outcome", cause.alias("cause"), "corrected")


def active_days(turns: DataFrame, feedback: DataFrame, days: int = 7) -> DataFrame:
    """Turns of the last `days` days on which there were any, with their feedback as fb_ columns."""
    last = turns.select("day").distinct().orderBy(F.desc("day")).limit(days)
    f = feedback.select(F.col("turn_id").alias("id"), F.col("kind").alias("fb_kind"), F.col("intent").alias("fb_intent"))
    return turns.join(F.broadcast(last), "day", "left_semi").join(f, "id", "left").select("id", "day", untagged(F.col("text")).alias("text"), model_of(F.col("text")).alias("model"), "fb_kind", "fb_intent")


def without_retries(turns: DataFrame) -> DataFrame:
    """id, retry_of: the newest of rows that ask the same in one turn of a chat, and the ids of the others."""
    rows = turns.select("id", "chat_id", "turn", F.lower(untagged(F.col("text"))).alias("said"))
    groups = rows.groupBy("chat_id", "turn", "said").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.select(F.element_at("ids", -1).alias("id"), F.array_join(F.slice("ids", 1, F.size("ids") - 1).cast("array<string>"), ",").alias("retry_of"))


def unique_questions(turns: DataFrame) -> DataFrame:
    """said, id, times, first, ids: every distinct question, its newest turn, how often it was asked, and all its turns."""
    rows = turns.withColumn("said", F.lower(untagged(F.col("text"))))
    return rows.groupBy("said").agg(F.max("id").alias("id"), F.count("*").alias("times"), F.min("id").alias("first"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


def feedback_kinds(feedback: DataFrame) -> DataFrame:
    """kind, n."""
    return feedback.groupBy("kind").agg(F.count("*").alias("n"))


def outcomes(turns: DataFrame) -> DataFrame:
    """id, family, certainty."""
    family = F.when(F.col("intent").isin(*DATA_INTENTS), "data").when(F.col("intent").isin(*TALK), "conversational").when(F.col("intent").isin(*DECLINED), "declined").otherwise("control")
    certainty = F.when(F.col("confidence") < THIN, "too thin").when(F.col("confidence") < ACCEPT, "uncertain").otherwise("certain")
    return turns.select("id", family.alias("family"), certainty.alias("certainty"))
