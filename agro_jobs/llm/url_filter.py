"""URL filtering: rules, then host word segmentation and naive Bayes.

Pieces of a host or path (runs of letters) are cut into words by a unigram Viterbi search. The
unigram counts come from the pieces of all urls, with a few pseudo-counts for the seed words: a
piece counts once for every site name it is used under, whatever the number of hosts, suffixes
and pages of that site, and a site's name is no evidence that this name is a word of its own.
Candidate words reach a piece by a join, so the vocabulary has no bound. Urls whose words hold
a block seed teach the block class, all others the allow class; a multinomial naive Bayes over
the words of all urls then scores each url. Rules decide first, the longest that fits.

Work is done once per distinct (host, path). Nulls and urls without :// have an empty host and
path, and no words; such urls are allowed. Empty tables give no rows; repeated rows keep their
number; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agro_jobs.llm.common import lower_ascii, materialize

#: action, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK_SEEDS = ("adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "cialis", "clickbait", "crack", "escort", "gambling", "hack", "jackpot", "lottery", "loan", "loans",
               "malware", "nude", "payday", "phish", "phishing", "pill", "pills", "poker", "porn", "scam", "sex", "slots", "spam", "spyware", "torrent", "track", "tracker", "viagra", "warez", "win", "winner", "xxx")
ALLOW_SEEDS = ("about", "blog", "book", "books", "docs", "farm", "forum", "health", "help", "home", "info", "library", "mail", "market", "museum", "music", "news", "online", "page", "paper", "school", "science", "shop",
               "store", "university", "weather", "web", "wiki", "world")
SEED_COUNT, LONGEST, SMOOTHING = 5, 20, 1.0
SITE = r"([^.@:]+)(?:\.(?:ac|co|com|edu|gov|net|org))?\.[^.:]+(?::[0-9]*)?$"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return urls.withColumns({"host": lower_ascii(F.regexp_extract(url, PARTS, 1)), "path": F.regexp_extract(url, PARTS, 2)})


def site_name(host: Column) -> Column:
    """The letters of the label before the public suffix; those of the whole host where there is none."""
    label = F.regexp_extract(host, SITE, 1)
    return F.regexp_replace(F.when(label == "", host).otherwise(label), "[^a-z]", "")


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as a string, and its action; null where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones are tested first, being outermost
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _segment(n_total: float):
    @F.pandas_udf("array<string>")
    def run(pieces: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(p, [] if k is None else k, n_total) for p, k in zip(pieces, known, strict=True)])

    return run


def viterbi(piece: str, known: Sequence[dict], total: float) -> list[str]:
    """The likeliest words of a piece. known: start (from 0), length and count of its substrings that are words."""
    count = {(int(k["start"]), int(k["length"])): float(k["n"]) for k in known}
    best, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    for end in range(1, len(piece) + 1):
        for start in range(max(0, end - LONGEST), end):
            n = count.get((start, end - start))
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    words, end = [], len(piece)
    while end:
        words.append(piece[back[end] : end])
        end = back[end]
    return words[::-1]


def segmented(pieces: DataFrame) -> DataFrame:
    """piece, words: pieces has piece and n, under how many other site names it occurs."""
    seeds = pieces.sparkSession.createDataFrame([(w,) for w in sorted({*BLOCK_SEEDS, *ALLOW_SEEDS})], "word string").withColumn("n", F.lit(SEED_COUNT).cast("long"))
    counts = materialize(pieces.select(F.col("piece").alias("word"), "n").where("n > 1").unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "url-unigrams")
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    spots = pieces.select("piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("start")).select(
        "piece", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("start")))).alias("length")
    )
    known = (
        spots.withColumn("word", F.expr("substring(piece, start + 1, length)")).join(counts, "word")
        .groupBy("piece").agg(F.collect_list(F.struct("start", "length", "n")).alias("known"))
    )
    return pieces.join(known, "piece", "left").select("piece", _segment(total)("piece", "known").alias("words"))


def judged(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score (log-odds of block), one row per row of urls."""
    rows = host_and_path(urls.select("page_id", "url"))
    sites = materialize(rows.select("host", "path").distinct(), "url-sites")
    letters = F.expr(r"regexp_extract_all(lower(concat(host, ' ', path)), '[a-z]+', 0)")
    pieces = sites.withColumn("piece", F.explode(letters))
    named = pieces.select("piece", site_name(F.col("host")).alias("name")).distinct()
    uses = materialize(named.groupBy("piece").agg(F.sum((F.col("piece") != F.col("name")).cast("long")).alias("n")), "url-uses")
    split = materialize(segmented(uses), "url-pieces")
    tokens = materialize(pieces.join(split, "piece").select("host", "path", F.explode("words").alias("word")), "url-tokens")
    seeded = tokens.groupBy("host", "path").agg(F.max(F.col("word").isin(*BLOCK_SEEDS).cast("int")).alias("block"))
    taught = tokens.join(seeded, ["host", "path"]).groupBy("word").agg(F.sum("block").alias("b"), F.sum(1 - F.col("block")).alias("a"))
    taught = materialize(taught, "url-counts")
    sums = taught.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    sides = seeded.agg(F.sum("block").alias("b"), F.count("*").alias("n")).first()
    b, a, v = (float(sums[k] or 0) + (0 if k == "v" else SMOOTHING) for k in ("b", "a", "v"))
    odds = taught.select(
        "word", (F.log((F.col("b") + SMOOTHING) / (b + SMOOTHING * v)) - F.log((F.col("a") + SMOOTHING) / (a + SMOOTHING * v))).alias("odds")
    )
    blocked, n = float(sides["b"] or 0), float(sides["n"] or 0)
    prior = math.log((blocked + SMOOTHING) / (n - blocked + SMOOTHING))
    scores = tokens.join(odds, "word").groupBy("host", "path").agg((F.sum(F.col("odds").cast("decimal(18,9)")).cast("double") + prior).alias("score"))
    rule, action = rule_columns(rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return rows.join(scores, ["host", "path"], "left").withColumns({"rule": rule, "verdict": F.coalesce(action, method)})
