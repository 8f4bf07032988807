"""Ranked search of items in documents by an Aho-Corasick scan of the texts, without an index.

The terms of all items are one automaton, each between two blanks. A text has every separator turned into
a blank and one put at either end, so the automaton reports whole terms and nothing else; what it
reports are numbers that lead to the items. The scan counts terms in each document and writes the counts
(term, occurrences); document frequencies, totals and weights come from those, and a second pass over the
counts alone scores documents and keeps the best of each item in every task, before Spark ranks what is left.

The automaton is broadcast. Items are dealt into blocks whose terms have at most `BLOCK_BYTES` bytes
(an item above that is a block of its own) and at most `BLOCK_ITEMS` items; each block is one scan.

Nulls: a null text has no terms, so no score; a null doc_id comes last among equal scores and a null
item_id is an id like others. Items of one id are one item with the terms of all its rows. Documents that
repeat are ranked each; equal scores go by doc_id. Empty tables give no rows. Texts may be of any length
(a task holds one text at a time). Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.llm.common import lower_ascii, materialize, text_chunks

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TABLE = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 1 << 14
CELLS = 1 << 21  # scores (documents by items) that a task holds at a time
LAST = (1 << 63) - 1


def terms_of(benchmark: DataFrame) -> DataFrame:
    """no, item_id, terms: every item's distinct terms, written once."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), SEPARATORS), "")
    each = benchmark.select("item_id", F.explode(F.array_distinct(words)).alias("term"))
    items = each.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # at most the words of the item
    return materialize(items.withColumn("no", F.monotonically_increasing_id()), "search-items")


def blocks(items: DataFrame, most_bytes: int, most_items: int) -> Iterator[list]:
    """The items (no, terms) in blocks within the bounds; a block is on the driver while it is searched for."""
    sized = items.withColumn("bytes", F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 2))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    count = max(-(-total[0] // most_bytes), -(-total[1] // most_items))
    while count:
        block = F.pmod(F.xxhash64("no"), F.lit(count))
        full = (F.sum("bytes") > most_bytes) & (F.count("*") > 1) | (F.count("*") > most_items)
        if not sized.groupBy(block.alias("block")).agg(full.alias("full")).where("full").limit(1).count():
            break
        count = 2 * count
    for k in range(count):
        if rows := items.where(F.pmod(F.xxhash64("no"), F.lit(count)) == k).select("no", "terms").collect():
            yield rows


@lru_cache(2)
def _automaton(terms: Broadcast) -> ahocorasick.Automaton:
    """Of " term " for each term; one character stands for each byte."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms.value):
        found.add_word(f" {term.encode().decode('latin-1')} ", i)
    found.make_automaton()
    return found


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, terms, counts, one row per row of docs: all terms of the text, and which of the given ones it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared)
        for batch in batches:
            for first, rows, data, offsets in text_chunks(batch, "text"):
                plain, sizes, which, counts = data.tobytes().translate(TABLE), [], [], []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    text = b" " + plain[a:b] + b" "
                    blank = np.frombuffer(text, np.uint8) == 32
                    sizes.append(int(np.count_nonzero(blank[:-1] & ~blank[1:])))
                    held = Counter([i for _, i in automaton.iter(text.decode("latin-1"))])
                    which.append(list(held))
                    counts.append(list(held.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows), pa.array(sizes, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "counts"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, unknown: np.ndarray, top: int) -> np.ndarray:
    """Places of the `top` first of each item, by falling score, then rising id, unknown ones last."""
    order = np.lexsort((doc, unknown, -score, item))
    of = item[order]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return order[rank < top]


def best_documents(counted: DataFrame, total: tuple[int, int], weights: list[int], items: list[list[int]], top: int) -> DataFrame:
    """item (its place in `items`), doc_id, score: the `top` best of each task, for items given as lists of term numbers."""
    holders: list[list[int]] = [[] for _ in weights]
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    first = np.cumsum([0, *map(len, holders)])
    shared = counted.sparkSession.sparkContext.broadcast((np.array(weights, np.int64), first, np.array([i for x in holders for i in x], np.int64), len(items)))
    documents, words = total

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, first, holder, width = shared.value
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, doc, unknown
        least = np.ones(width, np.int64)  # the score that an item's list still takes
        step = max(1, CELLS // width)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column("terms")
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(False))
                term, tf = lists.flatten().to_numpy(False), batch.column("counts").flatten().to_numpy(False).astype(np.int64)
                m = 10 + (90 * batch.column("n").to_numpy(False) * documents) // words
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                scores = np.zeros((batch.num_rows, width), np.int64)
                for k in range(0, len(term), 1 << 16):
                    t = term[k : k + (1 << 16)]
                    fan = first[t + 1] - first[t]
                    place = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(first[t], fan)
                    np.add.at(scores.reshape(-1), np.repeat(row[k : k + (1 << 16)], fan) * width + holder[place], np.repeat(part[k : k + (1 << 16)], fan))
                r, item = np.nonzero(scores >= least)
                ids = batch.column("doc_id")
                new = [item, scores[r, item], pc.fill_null(ids, LAST).to_numpy(False)[r], pc.is_null(ids).to_numpy(False)[r]]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                best = _best(*kept, top)
                kept = [x[best] for x in kept]
                full = np.bincount(kept[0], minlength=width) >= top
                lowest = np.full(width, LAST)
                np.minimum.at(lowest, kept[0], kept[1])
                least = np.where(full, lowest, 1)
        item, score, doc, unknown = kept
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, pa.int64(), mask=unknown), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, top: int = 10, most_bytes: int = BLOCK_BYTES, most_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item with a score above 0."""
    spark, items, found = docs.sparkSession, terms_of(benchmark), None
    for block in blocks(items, most_bytes, most_items):
        terms = sorted({t for r in block for t in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        counted = materialize(count_terms(docs, terms), "search-counts")
        total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total[1]:
            break
        holding = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # the block's terms at most
        best = best_documents(counted.where(F.size("terms") > 0), tuple(total), [weight(total[0], holding.get(i, 0)) for i in range(len(terms))], [[number[t] for t in r["terms"]] for r in block], top)
        numbers = spark.createDataFrame([(i, r["no"]) for i, r in enumerate(block)], "item int, no long")
        best = best.join(F.broadcast(numbers), "item").select("no", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).where("false")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("no", "item_id"), "no").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
