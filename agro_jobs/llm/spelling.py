"""Spelling variants: words one edit apart, by pairs of trie nodes.

Every prefix of a word is a node of the forward trie of all words, every suffix one of the reversed trie;
nodes are numbered. A word gives the pair (prefix node, suffix node) of each of its positions, once
with the letter there skipped and once with nothing skipped (as if a letter were to be inserted).
Two words that share a skipping pair differ in that one letter; a skipping pair of one and an inserting
pair of the other say that the first has one letter more. A letter within a run of equal letters can be
skipped in several ways with one result; the last of the run stands for it, so no two words meet twice.

Of a pair's words at most one inserts (prefix and suffix spell it) and each letter of the alphabet
skips at most once: a group has at most 91 rows, whatever the vocabulary. Words are numbered by
falling count, then by code points, so a word's form is the smallest number among its near words.

Nodes get their names from (parent's name, letter) by 128-bit digests, in time linear in the
word's length, and then numbers, so words may be of any length.

Nulls: a null text has no words; a null id counts as the empty text. Empty tables give no rows; rows
that repeat count again; of further columns none is read. Words of equal count are ranked by code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm.common import lower_ascii, materialize

RUN = "[A-Za-zÀ-ÿ]+"
SHALLOW = 2  # nodes of so many letters at most: 90 + 90 * 90 of them, broadcast; they are the ones that many words share
ROWS_AT_ONCE = 1 << 16
PAIRS = "no long, kind int, head int, tail int, before binary, after binary"
INSERT, SKIP, LAST_SKIP = 0, 1, 2  # kinds of pairs; LAST_SKIP: the last letter of a run of equal ones


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """word, n: words of at least `shortest` letters and `least` occurrences, after one letter in every `slip`-th run (by its hash) is lost."""
    run = F.col("run")
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.where(F.char_length(run) >= shortest).withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary")))
    at = F.pmod(F.col("h"), F.char_length(run)).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)
    return hashed.select(word.alias("word")).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The named pairs of every word; `head` and `tail` are the lengths of prefix and suffix."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["no", "kind", "head", "tail", "before", "after"])
        rows.clear()
        return out

    def names(letters: Iterable[str]) -> list[bytes]:
        out = [b""]
        for c in letters:
            out.append(blake2b(out[-1] + c.encode(), digest_size=16).digest())
        return out

    for batch in batches:
        for no, word in zip(batch.column("no").to_pylist(), batch.column("word").to_pylist(), strict=True):
            before, after, size = names(word), names(reversed(word)), len(word)
            for i in range(size + 1):
                rows.append((no, INSERT, i, size - i, before[i], after[size - i]))
                if i < size:
                    rows.append((no, LAST_SKIP if i + 1 == size or word[i] != word[i + 1] else SKIP, i, size - i - 1, before[i], after[size - i - 1]))
                if len(rows) >= ROWS_AT_ONCE:
                    yield flush()
    if rows:
        yield flush()


def _numbered(pairs: DataFrame, name: str, depth: str, number: str) -> DataFrame:
    """pairs with a node's name replaced by its number; the root is 0."""
    nodes = materialize(pairs.where(F.col(depth) > 0).select(name, depth).distinct().withColumn(number, F.monotonically_increasing_id() + 1), f"spelling-{number}")
    others = [c for c in pairs.columns if c not in (name, depth)]
    root = pairs.where(F.col(depth) == 0).withColumn(number, F.lit(0).cast("long"))
    near = pairs.where(F.col(depth).between(1, SHALLOW)).join(F.broadcast(nodes.where(F.col(depth) <= SHALLOW).drop(depth)), name)
    far = pairs.where(F.col(depth) > SHALLOW).join(nodes.where(F.col(depth) > SHALLOW).drop(depth), name)
    return root.select(*others, number).unionByName(near.select(*others, number)).unionByName(far.select(*others, number))


def near_words(words: DataFrame) -> DataFrame:
    """no, n_near, best: how many words are one edit from word `no`, and the smallest number among them; words without any are left out."""
    pairs = materialize(words.select("no", "word").mapInArrow(_pairs, PAIRS), "spelling-pairs")
    pairs = materialize(_numbered(_numbered(pairs, "before", "head", "p"), "after", "tail", "s"), "spelling-numbered")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("no", "kind")).alias("all")).where(F.size("all") > 1)  # at most 91
    # An inserting word is near those that skip the last letter of a run, and those are near it.
    near = f"filter(all, x -> x.no != m.no and if(m.kind = {INSERT}, x.kind = {LAST_SKIP}, x.kind != {INSERT} or m.kind = {LAST_SKIP}))"
    met = groups.select("all", F.explode("all").alias("m")).select("m.no", F.expr(f"transform({near}, x -> x.no)").alias("near")).where(F.size("near") > 0)
    return met.groupBy("no").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.min(F.array_min("near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """no, root: where following `form` (a number or null) from `no` ends. Each round halves the paths that are left."""
    at = materialize(forms.select("no", F.coalesce("form", "no").alias("root")), "spelling-roots")
    while True:
        then = at.select(F.col("no").alias("root"), F.col("root").alias("then"))
        moved = materialize(at.withColumnRenamed("root", "at").join(then.withColumnRenamed("root", "at"), "at").select("no", "at", F.col("then").alias("root")), "spelling-roots")
        at = moved.select("no", "root")
        if not moved.where("at != root").limit(1).count():
            return at


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n, one row per word of the vocabulary."""
    counted = materialize(vocabulary(docs, shortest, least, slip), "spelling-counts")
    # Sorted, so that the numbers rise with the rank; written, so that they stay.
    words = materialize(counted.orderBy(F.desc("n"), "word").withColumn("no", F.monotonically_increasing_id()), "spelling-words")
    best = words.select(F.col("no").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    found = words.join(near_words(words), "no", "left").join(best, "best", "left").withColumn("larger", F.col("best_n") >= 2 * F.col("n"))
    found = materialize(found.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("larger"), F.col(c)).alias(a) for c, a in (("best", "form_no"), ("best_word", "form"), ("best_n", "form_n"))]), "spelling-forms")
    ends = roots(found.select("no", F.col("form_no").alias("form"))).join(words.select(F.col("no").alias("root"), F.col("word").alias("root_word")), "root")
    return found.join(ends.select("no", "root_word"), "no").select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
