"""Words that are nearly alike, by an index of deletions: no block, prefix or length that both must share.

Two words at most k edits apart have a common string that either becomes by losing at most k
letters. So words are joined on what they are without some letters, and the pairs are verified.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agro_jobs.sources.shared import dealt


def deletions(word: Column, edits: Column | int) -> Column:
    """The word and what is left of it without up to `edits` letters, each once."""
    start = F.struct(F.array(word).alias("all"), F.array(word).alias("last"))

    def shorter(acc: Column, _: Column) -> Column:
        less = F.array_distinct(F.flatten(F.transform(acc["last"], lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.char_length(w)))))))
        return F.struct(F.array_union(acc["all"], less).alias("all"), less.alias("last"))

    rounds = F.lit(edits) if isinstance(edits, int) else edits
    return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")), start, shorter)["all"]


def near(a: DataFrame, b: DataFrame, left: str, right: str, edits: Column | int, other_edits: Column | int | None = None) -> DataFrame:
    """left, right: candidate pairs of distinct words of a and b that share a deletion; every pair within `edits` is among them.

    A word has many deletions: words are dealt over all cores before those are made, which are joined by their hashes
    and never broadcast. Where two deletions share a hash there is one more candidate.
    """

    def index(words: DataFrame, word: str, most: Column | int) -> DataFrame:
        lost = F.transform(deletions(F.col(word), most), lambda d: F.xxhash64(d))
        return dealt(words.select(word)).select(word, F.explode(lost).alias("_d"))

    x, y = index(a, left, edits), index(b, right, edits if other_edits is None else other_edits)
    return x.join(y.hint("merge"), "_d").select(left, right).distinct()


def _blocks(a: str, b: str) -> int:
    """Letters in matching blocks: the longest common block (the first in a, then in b), then the same on both sides of it."""
    todo, found = [(0, len(a), 0, len(b))], 0
    while todo:
        i0, i1, j0, j1 = todo.pop()
        runs: dict[int, int] = {}
        best = (0, i0, j0)
        for i in range(i0, i1):
            now = {j: runs.get(j - 1, 0) + 1 for j in range(j0, j1) if a[i] == b[j]}
            for j, n in now.items():
                if n > best[0]:
                    best = (n, i - n + 1, j - n + 1)
            runs = now
        n, i, j = best
        if n:
            found += n
            todo += [(i0, i, j0, j), (i + n, i1, j + n, j1)]
    return found


@F.pandas_udf(T.DoubleType())
def likeness(said: pd.Series, known: pd.Series) -> pd.Series:
    """2 m / t, with t the letters of both words and m those in matching blocks."""
    return pd.Series([2.0 * _blocks(k, s) / (len(s) + len(k)) if s or k else 1.0 for s, k in zip(said, known, strict=True)], dtype="float64")


def misspelt_words(words: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """word, known, ratio: for each word that is none of the known ones, those it is at least `least` like.

    At that likeness the letters outside the blocks are at most (1 - least) of both words together, so a word of
    n letters loses at most n - least / 2 * (n + m) of them to a word of m, and no m is below n * least / (2 - least).
    """
    def losses(word: str) -> Column:
        n = F.char_length(word)
        return F.floor(n - least / 2 * (n + F.ceil(n * (least / (2 - least)) - 1e-9)) + 1e-9).cast("int")

    # Words too long for the longest known one are like none, so the index is bounded by the known words.
    longest = known.agg(F.coalesce(F.max(F.char_length("known")), F.lit(0))).first()[0]
    strange = words.where(F.char_length("word") <= longest * (2 - least) / least + 1e-9).select("word").distinct().join(known.select(F.col("known").alias("word")), "word", "left_anti")
    pairs = near(strange, known.select("known").distinct(), "word", "known", losses("word"), losses("known"))
    n, m = F.char_length("word"), F.char_length("known")
    return pairs.where(2 * F.least(n, m) >= least * (n + m)).withColumn("ratio", likeness("word", "known")).where(F.col("ratio") >= least)
