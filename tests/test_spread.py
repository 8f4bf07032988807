"""Files of one piece, values that repeat, and texts of many words."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from agro_jobs.operators import marks, ml
from agro_jobs.sources.shared import once_each, spread


def test_one_piece_is_dealt_over_all_cores(spark):
    rows = spark.range(1000).coalesce(1)
    assert spread(rows).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in spread(rows).collect()) == list(range(1000))
    assert ml.tfidf(rows.selectExpr("id", "'some words ' || id % 7 AS text").coalesce(1), 64)[1].rdd.getNumPartitions() > 1


def test_values_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(a, b):
        calls.add(1)
        return f"{a}/{b}"

    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 5 > 0 THEN 'x' || id % 5 END AS a", "id % 2 AS b")
    got = {(r["id"], r["said"]) for r in once_each(rows, ["a", "b"], said=slow("a", "b")).collect()}
    assert got == {(i, f"{f'x{i % 5}' if i % 5 else None}/{i % 2}") for i in range(500)}
    assert calls.value == 10


def test_grams_of_words(spark):
    texts = ["Rain  in Agra, at 5:30!", "", "a", "ab c", "  é ", "x" * 40, "the the THE", " ".join(f"w{i}" for i in range(3000))]
    for r in ml.grams(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        words = re.sub(" +", " ", re.sub("[^a-z0-9:]+", " ", r["text"].lower())).strip().split(" ")
        assert r["words"] == words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        assert sorted(r["chars"]) == sorted(p[i : i + n] for p in (f" {w} " for w in words) for n in (3, 4, 5) for i in range(len(p) - n + 1))


def test_words_of_texts_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, "red gram and Red gram " * 3) for i in range(20)], "id long, text string")
    vocabulary = spark.createDataFrame([("red gram", "crop", 0), ("gram", "crop", 1), ("red", "colour", 2)], "term string, type string, no int")
    found = marks.entities(rows, vocabulary, ["id"])
    assert {(r["type"], *r["spans"]) for r in found.collect()} == {("crop", "red gram", "Red gram")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\((\w+)", plan.split("== Initial Plan ==")[0]) == ["id"]  # the texts, once


def test_commonest_terms(spark):
    rnd = random.Random(3)
    for many, uses in ((40, 400), (6000, 9000), (3000, 3000)):  # few terms; many alike; all used about once
        said = [(rnd.choice((1, 2)), f"w{min(rnd.randrange(many), rnd.randrange(many))}") for _ in range(uses)] + [(3, "alone")]
        got = marks.commonest(spark.createDataFrame(said, "kind int, term string"), 20)
        want = {(k, t, n) for kind in (1, 2, 3) for (k, t), n in sorted(((x, n) for x, n in Counter(said).items() if x[0] == kind), key=lambda x: (-x[1], x[0][1]))[:20]}
        assert {(r["kind"], r["term"], r["n"]) for r in got.collect()} == want


def test_matches_with_the_same_place(spark):
    at = [(1, 0, 2, "b", 1), (1, 0, 2, "a", 0), (1, 2, 3, "lone", 5), (1, 3, 5, "c", 2), (1, 4, 6, "d", 1), (1, 5, 8, "e", 0), (2, 0, 1, "lone", 9), (2, 4, 5, "x", 1), (2, 4, 5, "y", 2)]
    found = spark.createDataFrame(at, "id int, start int, end int, term string, no int")
    got = {(r["id"], r["term"]) for r in marks.longest_first(found, ["id"], [F.col("no")]).collect()}
    assert got == {(1, "a"), (1, "lone"), (1, "e"), (1, "c"), (2, "lone"), (2, "x")}


def test_counts_of_grams_are_those_of_hashing_tf(spark):
    rnd = random.Random(5)
    texts = ["Rain  in Agra, at 5:30!", "", "a", "ab c", "  \u00e9 ", "x" * 41, "the the THE", "12:30 a: :", "\u212a \u0130i"]
    texts += [" ".join("".join(rnd.choices("abcXYZ019:-\u00e9", k=rnd.randint(1, 14))) for _ in range(rnd.choice((1, 5, 90, 4000)))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for features in (64, 1 << 10, 1000, 1 << 14):
        want = ml.grams(rows)
        for c in ("words", "chars"):
            want = HashingTF(inputCol=c, outputCol=f"tf_{c}", numFeatures=features).transform(want)
        want = {r["id"]: (len(r["words"]), len(r["chars"]), *[{int(i): r[c][int(i)] for i in r[c].indices} for c in ("tf_words", "tf_chars")]) for r in want.collect()}
        got = {r["id"]: (r["n_words"], r["n_chars"], *[{i: v for i, v in enumerate(r[c].toArray()) if v} for c in ("tf_words", "tf_chars")]) for r in ml.gram_counts(rows, features).collect()}
        assert got == want
    assert ml.gram_counts(spark.createDataFrame([(1, None)], "id long, text string"), 64).first()["n_words"] == 1


def test_texts_are_read_once_for_a_fit(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(i):
        calls.add(1)
        return f"some words {i}"

    rows = spark.range(40).select("id", read("id").alias("text"))
    ml.tfidf(rows, 64)[1].write.parquet(f"{tmp_path}/features")
    assert calls.value == 40
