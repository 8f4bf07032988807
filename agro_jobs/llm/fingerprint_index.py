"""Substring deduplication over a log-structured fingerprint index.

A window is `window` consecutive words of one document. Its fingerprint is the smallest hash
of its word GRAM-grams, so consecutive windows mostly share one: they form a stretch, stored as
(h, g): h the fingerprint, g an independent hash of all the stretch's words. Equal windows have
equal h, so two windows can only be equal inside stretches of equal h.

The index keeps (h, g, n) in immutable runs, bucketed and sorted by h and g. A new batch becomes a
run; runs are merge-joined bucket by bucket without a shuffle and compacted into one when
there are FANOUT of them. Verification: a stretch with n >= 2 repeats whole; where one h has
several g, the stretches' windows are compared one by one (by a 64-bit hash of all their words
next to the 64-bit h).

Texts are read again to verify and to place what repeats. Where the wanted fingerprints are few enough, a broadcast bitmap
with BITS_EACH bits for each of them keeps all others out before the exact join; it has MOST_BITS at most. Where they are
more, texts are first joined by the fingerprints of their stretches, and only those that hold a wanted one are read again.

Nulls: a null text has no words. Copies and repeated rows count as occurrences each. Empty
tables give no rows; other columns are ignored. A task holds one text at a time, whatever its length. Ties don't arise:
every window is judged by itself.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agro_jobs.llm import common as C

WINDOW, GRAM, FANOUT = 35, 14, 2
BITS_EACH, MOST_BITS = 16, 1 << 28  # the largest bitmap has 32 MB
PART_WORDS = 1 << 13  # a bitmap reaches the driver in parts of 64 KB
POSTING = "h long, g long, k1 long, k2 int, first int, count int"


def _stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """h, g, document, first window (word index in the document), count of windows; and what locates the windows."""
    s, e, doc = C.word_bounds(data, offsets, C.SPACE)
    n = len(s) - window + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return (z.astype(np.uint64),) * 2 + (z,) * 4 + (z.astype(np.uint64),)
    word, check = C.spans_hash(data, s, e), C.spans_hash(data, s, e, C._B2)
    gram = min(GRAM, window)
    at = np.arange(len(s) - gram + 1)
    grams = C.spans_hash(word, at, at + gram)
    anchor = C.sliding_argmin(grams, window - gram + 1)[:n]
    ok = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(ok):
        return (z.astype(np.uint64),) * 2 + (z,) * 4 + (z.astype(np.uint64),)
    new = np.ones(len(ok), bool)
    new[1:] = (anchor[ok[1:]] != anchor[ok[:-1]]) | (ok[1:] != ok[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(ok)))
    first = ok[head]
    g = C.spans_hash(check, first, first + count - 1 + window, C._B2)
    begins = np.searchsorted(doc, np.arange(len(offsets) - 1))
    return grams[anchor[first]], g, doc[first], first - begins[doc[first]], count, first, check


def _first_of_each(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct tuple of keys, and how often it occurs."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(order)))


def _map_counts(window: int):
    """(h, g, n), each pair once for a batch of rows, so that copies are counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_stretches(data, off, window)[:2] for _, _, data, off in C.text_chunks(b, "text")]
            if parts:
                h, g = (np.concatenate(x) for x in zip(*parts, strict=True))
                first, n = _first_of_each(g, h)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(g[first].view(np.int64)), pa.array(n)], names=["h", "g", "n"])

    return run


def _map_windows(window: int, bitmap):
    """(h, g, i, w) for every window i of a stretch whose h is in the bitmap; equal stretches of a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            for _, _, data, off in C.text_chunks(b, "text"):
                h, g, _, _, count, first, check = _stretches(data, off, window)
                pick = np.flatnonzero(_in(bits, h))
                pick = pick[_first_of_each(g[pick], h[pick])[0]]
                c = count[pick]
                row = np.repeat(pick, c)
                i = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                start = first[row] + i
                w = C.spans_hash(check, start, start + window, C._B2) if len(row) else h[:0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[row].view(np.int64), g[row].view(np.int64), i.astype(np.int32), w.view(np.int64))], names=["h", "g", "i", "w"])

    return run


def _map_postings(window: int, bitmap):
    """(h, g, k1, k2, first, count): where the stretches are whose h is in the bitmap; equal texts of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            b = b.take(pa.array(np.sort(_first_of_each(b.column("k2").to_numpy(), b.column("k1").to_numpy())[0])))
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for at, _, data, off in C.text_chunks(b, "text"):
                h, g, doc, first, count, _, _ = _stretches(data, off, window)
                p = np.flatnonzero(_in(bits, h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[p].view(np.int64), g[p].view(np.int64), k1[at + doc[p]], k2[at + doc[p]], first[p].astype(np.int32), count[p].astype(np.int32))],
                    names=["h", "g", "k1", "k2", "first", "count"],
                )

    return run


def _map_heads(window: int):
    """(h, k1, k2) of every stretch, each once for a text of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            for at, _, data, off in C.text_chunks(b, "text"):
                h, _, doc, *_ = _stretches(data, off, window)
                p = _first_of_each(doc, h)[0]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[p].view(np.int64), k1[at + doc[p]], k2[at + doc[p]])], names=["h", "k1", "k2"])

    return run


def _in(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(h), bool)
    at = h.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _part(words: pa.Table) -> pa.Table:
    """One part of a bitmap (part, bits) from its words (a, b), PART_WORDS at most."""
    a = words.column("a").to_numpy()
    bits = np.zeros(PART_WORDS, np.int64)
    bits[a % PART_WORDS] = words.column("b").to_numpy()
    return pa.table({"part": pa.array([int(a[0]) // PART_WORDS], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def bitmap(df: DataFrame, column: str):
    """A broadcast bitmap: which low bits occur in the column, with BITS_EACH bits for each row of df or more; null where that is over MOST_BITS."""
    rows = df.count()
    if rows * BITS_EACH > MOST_BITS:
        return df.sparkSession.sparkContext.broadcast(None)
    size = 1 << max(16, (rows * BITS_EACH - 1).bit_length())
    at = df.select(F.col(column).bitwiseAND(size - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("a")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b"))
    parts = words.groupBy((F.col("a") / PART_WORDS).cast("long").alias("part")).applyInArrow(_part, "part long, bits binary")
    bits = np.zeros(size // 64, np.uint64)
    for row in parts.toLocalIterator():  # parts as they are in the bitmap, one partition after the other
        begin = row["part"] * PART_WORDS
        end = min(begin + PART_WORDS, len(bits))
        bits[begin:end] = np.frombuffer(row["bits"], np.uint64)[: end - begin]
    return df.sparkSession.sparkContext.broadcast(bits)


def holding(texts: DataFrame, wanted: DataFrame, bits, window: int) -> DataFrame:
    """The texts to read for stretches whose h is wanted: all where a bitmap tells, else those that a join of h leaves."""
    if bits.value is not None:
        return texts
    keys = texts.mapInArrow(_map_heads(window), "h long, k1 long, k2 int").join(wanted.select("h"), "h", "left_semi").select("k1", "k2").distinct()
    return texts.join(keys, ["k1", "k2"], "left_semi").select(texts.columns)


class FingerprintIndex:
    """Runs of (h, g, n): tables bucketed and sorted by h and g."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.runs = spark, fanout, []
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def _write(self, df: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").format("parquet").saveAsTable(name)  # in the shared warehouse
        return name

    def append(self, counts: DataFrame) -> None:
        """Add a batch (h, g, n) as a run of its own; compact when there are `fanout` runs."""
        counts = counts.repartition(self.buckets, "h", "g").groupBy("h", "g").agg(F.sum("n").alias("n"))
        self.runs.append(self._write(counts))
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one: sorted buckets meet their like without a shuffle; the result is dealt to its buckets once."""
        if len(self.runs) < 2:
            return
        merged = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            other = self.spark.table(run).withColumnRenamed("n", "m")
            merged = merged.join(other.hint("merge"), ["h", "g"], "full").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        merged = self._write(merged.repartition(self.buckets, "h", "g"))
        self.drop()
        self.runs = [merged]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = []

    def table(self) -> DataFrame:
        self.compact()
        return self.spark.table(self.runs[0])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, batches: int = 2) -> DataFrame:
    """k1, k2, ranges (word from, to): what is covered by windows that occur more than once, by text."""
    spark, texts = docs.sparkSession, keyed(docs).drop("doc_id")
    index = FingerprintIndex(spark, fanout=batches)
    for k in range(batches):  # as they would arrive one after the other
        batch = texts.where(F.pmod("k2", F.lit(batches)) == k) if batches > 1 else texts
        index.append(batch.mapInArrow(_map_counts(window), "h long, g long, n long"))
    known = index.table()
    split = C.materialize(known.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "substring-split")
    bits = bitmap(split, "h")
    windows = holding(texts, split, bits, window).mapInArrow(_map_windows(window, bits), "h long, g long, i int, w long")
    windows = C.materialize(windows.join(split, "h", "left_semi").distinct(), "substring-windows")
    again = windows.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "w")
    partial = windows.join(again, ["h", "w"], "left_semi").groupBy("h", "g").agg(F.collect_set("i").alias("part"))  # a stretch has at most `window` windows
    whole = known.where("n > 1").select("h", "g", F.lit(True).alias("whole"))
    flags = C.materialize(whole.join(partial, ["h", "g"], "full"), "substring-flags")
    bits = bitmap(flags, "h")
    postings = holding(texts, flags, bits, window).mapInArrow(_map_postings(window, bits), POSTING)
    found = postings.join(flags, ["h", "g"])
    ranges = F.when(F.col("whole"), F.array(F.struct(F.col("first").alias("from"), (F.col("first") + F.col("count") - 1 + window).alias("to")))).otherwise(
        F.transform("part", lambda i: F.struct((F.col("first") + i).alias("from"), (F.col("first") + i + window).alias("to")))
    )
    # The ranges of one text are at most as many as its words.
    out = C.materialize(
        found.select("k1", "k2", "first", ranges.alias("r")).dropDuplicates(["k1", "k2", "first"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("ranges")), "substring-ranges"
    )
    index.drop()
    return out


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digests(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in cols[2]], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
    )


def _map_untouched(bitmap):
    def run(batches):
        for b in batches:
            keep = pa.array(~_in(bitmap.value, b.column("k1").to_numpy()))
            b = b.filter(keep)
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                rows = [(len(w := t.as_buffer().to_pybytes().split()), 0, b" ".join(w)) for t in part.column("text")]
                yield _digests(part.column("doc_id"), rows)

    return run


def _map_flagged(bitmap):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_in(bitmap.value, b.column("k1").to_numpy())))

    return run


def _kept(text: bytes, ranges: list[dict] | None) -> tuple[int, int, bytes]:
    words = text.split()
    if not ranges:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [r["from"] for r in ranges], 1)
    np.add.at(edge, [r["to"] for r in ranges], -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(words), int((~keep).sum()), b" ".join(compress(words, keep))


def _map_removed(batches):
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            rows = [_kept(t.as_buffer().to_pybytes(), r.as_py()) for t, r in zip(part.column("text"), part.column("ranges"), strict=True)]
            yield _digests(part.column("doc_id"), rows)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of docs."""
    ranges, texts = repeated_ranges(docs, window, batches), keyed(docs)
    bits = bitmap(ranges, "k1")
    if bits.value is None:  # too many texts to tell by a bitmap: the join finds those without ranges too
        return texts.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges").mapInArrow(_map_removed, DIGEST)
    untouched = texts.mapInArrow(_map_untouched(bits), DIGEST)
    flagged = texts.mapInArrow(_map_flagged(bits), "doc_id long, text string, k1 long, k2 int")
    removed = flagged.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges").mapInArrow(_map_removed, DIGEST)
    return untouched.unionByName(removed)
