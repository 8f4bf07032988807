"""Folding a conversation's turns into its state, as window functions over each chat.

What a turn does depends on the turn itself and on whether it is the first one; what the chat then holds is,
for each slot, the last turn that set it. So no state is carried by hand, and a chat of any length streams
through its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAGMENT = ("MODIFY", "REPLACE", "INHERIT")


def operation(first: Column) -> Column:
    """What a turn (places, time, reference, compares, follow_up) does to the state: the first rule of the table that holds."""
    place, time = _said("places").isNotNull(), _said("time").isNotNull()
    back, leans = F.col("reference") == "LOCATION", F.col("follow_up")
    table = (
        (F.col("compares"), "COMPARE"), (first, "SET"), (back & ~place & time, "MODIFY"), (back & ~place, "INHERIT"), (leans & place & ~time, "REPLACE"), (leans & time & ~place, "MODIFY"),
        (place & time, "SET"), (place, "REPLACE"), (time, "MODIFY"),
    )
    out = F.lit("INHERIT")
    for condition, name in reversed(table):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def _said(slot: str) -> Column:
    """The slot's value; an empty one is none."""
    return F.nullif(F.col(slot), F.lit(""))


def sets(op: Column, slot: str) -> Column:
    """Whether a turn sets the slot: to what it says, or, for a time that a SET leaves out, to nothing."""
    if slot == "places":
        return op.isin("SET", "COMPARE", "REPLACE") & _said("places").isNotNull()
    return (op == "SET") | (op.isin("COMPARE", "MODIFY", "INHERIT") & _said("time").isNotNull())


def sessions(turns: DataFrame, idle: float) -> DataFrame:
    """turns (with ts) with session: a chat starts anew after more than `idle` seconds without a turn."""
    order = Window.partitionBy("chat_id").orderBy("turn")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    return turns.withColumn("_gap", gap > int(idle * 1e6)).withColumn("session", F.sum(F.coalesce("_gap", F.lit(False)).cast("int")).over(order)).drop("_gap")


def fold(turns: DataFrame, idle: float | None = None) -> DataFrame:
    """chat_id, turn, operation, intent, places, time after every turn.

    turns: chat_id, turn, intent, places, time, reference, follow_up, compares, silent, and ts if a chat is to
    start anew after `idle` seconds. Turns that name no measurement keep the intent of the one before.
    """
    rows = turns.withColumn("session", F.lit(0)) if idle is None else sessions(turns, idle)
    chat = ["chat_id", "session"]
    order = Window.partitionBy(*chat).orderBy("turn")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("operation", operation(F.row_number().over(order) == 1))
    op, silent = F.col("operation"), F.coalesce(F.col("silent"), F.lit(False))
    keeps = op.isin(*FRAGMENT) & silent
    rows = rows.withColumn("_since", F.sum((~keeps).cast("int")).over(upto))
    since = Window.partitionBy(*chat, "_since").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    held = {slot: F.last(F.when(sets(op, slot), F.struct(_said(slot).alias("v"))), ignorenulls=True).over(upto)["v"] for slot in ("places", "time")}
    intent = F.coalesce(F.first(_said("intent"), ignorenulls=True).over(since), F.col("intent"))
    return rows.select("chat_id", "turn", "operation", intent.alias("intent"), held["places"].alias("places"), held["time"].alias("time"))


def missing_slots(folded: DataFrame) -> DataFrame:
    """Turns whose intent needs a place that is still unknown."""
    return folded.where("intent IN ('ADVICE', 'FORECAST', 'HISTORY') AND places IS NULL")


def replay_scores(folded: DataFrame, gold: DataFrame) -> DataFrame:
    """operation, places, time: shares of turns as in the gold (chat_id, turn, operation, places, time)."""
    g = gold.select("chat_id", "turn", *[gold[c].alias(f"g_{c}") for c in ("operation", "places", "time")])
    both = folded.join(g, ["chat_id", "turn"])
    return both.selectExpr(*[f"avg(CAST({c} <=> g_{c} AS INT)) AS {c}" for c in ("operation", "places", "time")])


