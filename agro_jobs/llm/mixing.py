"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every source is a queue of its documents in a seeded shuffle. A document's virtual finish time
is the words its source has served up to its end, divided by the source's target; a second
pass over the source continues the count. Long documents are served in packets of `PACKET` words,
each with a finish time of its own, so that no source waits for a long document of another. All
packets of all sources are put in the order of their finish times, and the order is cut
where the words up to there reach the total budget (of the packet at the cut, a part is taken). So
each source ends within a packet of its target.

Neither the queues nor the global order are sorted in one place. Running sums are taken in two
steps: sums of chunks (of a queue's shuffle, or of a range of finish times), then inside a chunk, of
which only the one with the cut is ordered. A source with a third of all rows is spread over many tasks.

Nulls: a null text has size 0; a null source is a source of its own, ranked last. Documents without
words take none; in the mix itself they stand where their place in the queue is served. Empty
tables give no rows; repeated rows are separate documents; other columns are ignored, whatever
their names. Texts are only counted, whatever their length; ties in finish time go by the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.llm.common import materialize, packed

WORD = r"[^\x20\x09-\x0D]+"
PILE = 1 << 16  # rows of a pile that are dealt out at a time
PACKET = 16  # words that are served at a time


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """source, source_size, n_rows, target: weights shared out under a cap of `cap` times the size.

    Filling in order of cap / weight: once a source is at its cap, the rest share what is left.
    One row per source, so the single-partition windows hold the list of sources only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.get(w, (F.row_number().over(by_name) - 1) % len(weights)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("cap", cap * F.col("source_size"))
        .withColumn("left", budget * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.greatest(F.col("left"), F.lit(0.0)) / F.col("weight_left")).over(everything))
    )
    return per.select("source", "source_size", "n_rows", F.least(F.col("cap"), F.col("level") * F.col("weight")).cast("double").alias("target"))


def fair_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, finish (virtual, of the first pass), one row per row of docs."""
    served = _served(docs.select("doc_id", "source", _words(docs["text"]).alias("size"), _key(seed)), weights, budget, cap)
    return served.select("doc_id", "size", "source", "source_size", "target", "taken", "finish")


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: int, *others: Column) -> Column:
    """A row's place in the shuffle, and what tells it from others: a hash of seed, id, source, text and what else is given.

    Every part says how long it is, and null is no length, so no two rows are spelled alike.
    """
    parts = [F.col("doc_id").cast("string"), F.col("source"), F.col("text"), *others]
    told = [F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.md5(F.concat(F.lit(f"{seed}:"), *told).cast("binary")).alias("key")


def _served(rows: DataFrame, weights: Sequence[float], budget: float, cap: int) -> DataFrame:
    """The rows (doc_id, key, source, size) with what the mix takes of each.

    Rows that nothing tells apart are one pile: it has one place in the queue and is dealt
    out again afterwards, so no pile is ever sorted, and reruns agree.
    """
    piles = materialize(rows.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("n")), "mix-piles")
    targets = materialize(source_targets(piles.select("source", (F.col("size") * F.col("n")).alias("size")), weights, budget, cap), "mix-targets")
    # As many chunks of a queue as rows in a chunk: neither a chunk nor the list of chunks grows with the queue itself.
    chunks = max(1, math.isqrt(piles.count()))
    queue = piles.withColumn("words", F.col("size") * F.col("n")).withColumn("chunk", F.expr(f"cast(conv(left(key, 8), 16, 10) as long) * {chunks} div 4294967296"))
    per_chunk = queue.groupBy("source", "chunk").agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base")).join(
        targets.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))
    )
    inside = Window.partitionBy("source", "chunk").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        queue.withColumn("ahead", F.coalesce(F.sum("words").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .withColumn("first", F.col("base") + F.col("ahead"))
    )
    parts = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PILE))))
    each = parts.withColumn("i", F.explode(F.sequence(F.col("part") * PILE, F.least(F.col("n"), (F.col("part") + 1) * PILE) - 1)))
    each = each.withColumn("served", F.col("first") + (F.col("i") + 1) * F.col("size"))  # words of the source up to the document's end
    each = materialize(each.select("doc_id", "key", "i", "size", "source", "source_size", "target", "served"), "mix-queue")
    return _cut(each, math.floor((targets.agg(F.sum("target")).first()[0] or 0.0) + 1e-6), cap)  # a float's last digits must not cost a word


def _packet(idx: Column) -> tuple[Column, Column]:
    """Words and virtual finish time of a document's packet number idx, counted on through all passes."""
    each = F.greatest(F.ceil(F.col("size") / PACKET), F.lit(1))
    turn, j = F.floor(idx / each), idx % each
    upto = F.least((j + 1) * PACKET, F.col("size"))
    return upto - j * PACKET, F.try_divide(turn * F.col("source_size") + F.col("served") - F.col("size") + upto, F.col("target"))


def _cut(each: DataFrame, budget: int, cap: int) -> DataFrame:
    """each (one row a document) with taken and finish: the words of its packets before the cut in the global order of finish times."""
    packets = F.ceil(F.col("size") / PACKET) * cap
    words, finish = _packet(F.col("idx"))
    served = each.where("size > 0 AND target > 0")
    none = each.withColumns({"taken": F.lit(0).cast("long"), "finish": F.try_divide("served", "target")})
    if not served.limit(1).count():
        return none
    order = served.select("key", "i", "size", "source_size", "target", "served", F.explode(F.sequence(F.lit(0), packets.cast("int") - 1)).alias("idx")).select("key", "i", "idx", words.alias("words"), finish.alias("finish"))
    # The order is cut into ranges of finish times, about as many as packets in each; only the range with the cut is put in order.
    ranges = max(1, math.isqrt(served.agg(F.sum(packets)).first()[0]))
    within = F.floor(F.least(F.col("finish"), F.lit(4.0)) * ranges).cast("long")
    totals = order.groupBy(within.alias("range")).agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    at = totals.select("range", (upto - F.col("words")).alias("before"), upto.alias("upto")).where(F.col("upto") >= budget).orderBy("range").limit(1).collect()
    if at and budget:
        inside = F.sum("words").over(Window.orderBy("finish", "key", "i", "idx").rowsBetween(Window.unboundedPreceding, 0)) + at[0]["before"]
        last = order.where(within == at[0]["range"]).withColumn("upto", inside).where(F.col("upto") >= budget).orderBy("upto").limit(1).first()
        cut = F.struct(F.lit(last["finish"]).alias("f"), F.lit(last["key"]).alias("k"), F.lit(last["i"]).alias("i"), F.lit(last["idx"]).cast("long").alias("x"))
        left = F.lit(last["upto"] - budget)  # of the packet at the cut
    elif budget:
        cut, left = None, F.lit(0)  # all that there is fits
    else:
        return none

    def taken_of(idx: Column) -> Column:
        some, when = _packet(idx)
        mine = F.struct(when.alias("f"), F.col("key").alias("k"), F.col("i").alias("i"), idx.cast("long").alias("x"))
        return some if cut is None else F.when(mine < cut, some).when(mine == cut, some - left).otherwise(F.lit(0))

    # Whole passes before the cut, and passes after it, need no look at their packets.
    total, count = F.lit(0).cast("long"), F.ceil(F.col("size") / PACKET)
    for turn in range(cap):
        last_at, first_at = _packet(count * (turn + 1) - 1)[1], _packet(count * turn)[1]
        one_by_one = F.aggregate(F.sequence(count * turn, count * (turn + 1) - 1), F.lit(0).cast("long"), lambda a, x: a + taken_of(x))
        words_of = one_by_one if cut is None else F.when(last_at < last["finish"], F.col("size")).when(first_at > last["finish"], F.lit(0)).otherwise(one_by_one)
        total = total + words_of
    return each.withColumns({"taken": F.when((F.col("size") > 0) & (F.col("target") > 0), total).otherwise(F.lit(0)).cast("long"), "finish": F.try_divide("served", "target")})


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: int = 2, seed: int = 17) -> DataFrame:
    """The mix itself: docs' own columns, whole documents repeated as served, in order of virtual finish time.

    A document is emitted once for each pass of which at least half its words are served.
    A document without words is emitted for each pass in which its place is served (once, where its source has no words).
    Rows are range-partitioned by finish time, so the files, read in order, are the mix. Every row
    has its own share, whatever ids repeat: a row is known by 128 bits over all its columns.
    Rows alike in all columns are the same row served several times.
    """
    key = _key(seed, *[F.to_json(F.struct(F.struct(docs[f"`{c}`"]).alias("c"))) for c in docs.columns if c not in ("doc_id", "source", "text")])
    sizes = materialize(docs.select("doc_id", "source", _words(docs["text"]).alias("size"), key), "mix-sizes")
    served = _served(sizes, weights, budget, cap).withColumn("pass", F.coalesce(F.try_divide("source_size", "target"), F.lit(0.0))).withColumn("finish", F.coalesce("finish", F.lit(0.0)))
    reached = sum([(F.col("served") + k * F.col("source_size") <= F.col("target") + 1e-6).cast("int") for k in range(cap)], F.lit(0))
    copies = F.when(F.col("size") > 0, F.floor(F.try_divide("taken", "size") + 0.5)).when(F.col("source_size") > 0, reached).otherwise(1).cast("int")
    rows = docs.select(packed(docs), key.alias("row_key"))
    if sizes.groupBy("key").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["row_key"])
    out = (
        rows.join(served.where(copies > 0).select("key", copies.alias("copies"), "finish", "pass"), F.col("row_key") == F.col("key"))
        .select("row", "key", "finish", "pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("k"))
        .withColumn("at", F.col("finish") + F.col("k") * F.col("pass"))
    )
    return out.repartitionByRange("at", "key").sortWithinPartitions("at", "key").select("row.*")
