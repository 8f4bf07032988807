"""Benchmark decontamination by winnowing (DataFrame functions only).

A text's fingerprints are the smallest K-gram hash of each run of W consecutive K-grams, so
any N = K + W - 1 words that two texts share give both at least one fingerprint in common.
Fingerprints of documents and benchmark are joined to find candidates; in those, every K-gram
that is a benchmark fingerprint is extended to the N-word windows around it, which are compared
word for word. Items shorter than N words have no such fingerprint: a hash of their whole word
sequence is looked up among those of the texts' runs of that length, and hits are compared in words.

Work is done once per distinct text (two 64-bit hashes of it), so copies cost nothing more.
The benchmark side is small as a rule; Spark broadcasts it if its files are below the session's
threshold, and sort-merge joins it otherwise.

A text is one row of word and hash arrays, so one task needs memory for the longest text.

Nulls: a null text has no words; a null item_id counts as the empty string. Empty tables,
repeated rows and further columns need nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.llm.common import lower_ascii, materialize, packed

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N, K = 10, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def with_grams(df: DataFrame, k: int = K) -> DataFrame:
    """grams: the hash of the k words from each position (empty for shorter texts)."""
    parts = ", ".join(f"get(words, i + {j})" for j in range(k))
    return df.withColumn("grams", F.expr(f"if(size(words) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {k}), i -> xxhash64({parts})))"))


def with_fingerprints(df: DataFrame, n: int = N, k: int = K) -> DataFrame:
    w = n - k + 1
    return df.withColumn(
        "fingerprints",
        F.expr(f"if(size(grams) < {w}, cast(array() as array<bigint>), array_distinct(transform(sequence(1, size(grams) - {w - 1}), i -> array_min(slice(grams, i, {w})))))"),
    )


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(7), text)})


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per row of docs."""
    base, verdicts = _verdicts(docs, benchmark, n, k)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return base.select("doc_id", "k1", "k2", "n_words").join(verdicts, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.when(F.col("items").isNull(), none).otherwise(F.sha2(F.concat_ws(",", "items").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = N, k: int = K) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    _, verdicts = _verdicts(docs, benchmark, n, k)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(packed(docs), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    return rows.join(verdicts, ["k1", "k2"], "left_anti").select("row.*")


def _runs(m: int, each: str) -> str:
    """SQL: `each` for every start i of m words, an array; none for fewer words."""
    return f"if(size(words) < {m}, null, transform(sequence(0, size(words) - {m}), i -> {each}))"


def _window(m: int) -> str:
    return f"concat_ws(' ', slice(words, i + 1, {m}))"


def _verdicts(docs: DataFrame, benchmark: DataFrame, n: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Words and keys of every document; n_hit and items of the texts that are hit."""
    base = materialize(
        with_fingerprints(with_grams(with_key(docs.select("doc_id", "text")).withColumn("words", words(F.col("text"))), k), n, k).select(
            "doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"), "fingerprints"
        ),
        "winnow-docs",
    )
    # Words are split once and written: what explodes below must not split a text anew for each of its words.
    said = materialize(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")), "winnow-items")
    windows = materialize(
        said.where("size(words) > 0").select(
            "item", F.least(F.size("words"), F.lit(n)).alias("n"),
            F.explode(F.expr(f"transform(sequence(0, greatest(size(words) - {n}, 0)), i -> {_window(n)})")).alias("window"),
        ).distinct(),
        "winnow-windows",
    )
    marked = materialize(with_fingerprints(with_grams(said, k), n, k).select("fingerprints"), "winnow-marks")
    prints = materialize(marked.select(F.explode("fingerprints").alias("fp")).distinct(), "winnow-prints")

    candidates = base.select("k1", "k2", F.explode("fingerprints").alias("fp")).join(prints, "fp", "left_semi").select("k1", "k2")
    short = sorted(r["n"] for r in windows.where(F.col("n") < n).select("n").distinct().collect())  # at most n - 1 lengths
    texts = with_key(docs.select("text"))
    if short:
        grams = F.expr(f"array_distinct(concat({', '.join(f'coalesce({_runs(m, f"xxhash64({_window(m)})")}, array())' for m in short)}))")
        hashes = windows.where(F.col("n") < n).select(F.xxhash64("window").alias("h")).distinct()
        holding = texts.withColumn("words", words(F.col("text"))).select("k1", "k2", F.explode(grams).alias("h")).join(hashes, "h", "left_semi")
        candidates = candidates.union(holding.select("k1", "k2"))
    candidates = materialize(candidates.distinct(), "winnow-candidates")
    near = texts.join(candidates, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).withColumn("words", words(F.col("text"))).drop("text")
    near = materialize(with_grams(near, k), "winnow-near")

    left, size = n - k, 2 * n - k
    spots = near.select("k1", "k2", F.posexplode("grams").alias("p", "fp")).join(prints, "fp", "left_semi")
    spots = spots.groupBy("k1", "k2").agg(F.collect_list("p").alias("spots"))  # at most a text's words
    around = near.join(spots, ["k1", "k2"]).select(
        "k1", "k2", F.size("words").alias("total"), F.explode(F.expr(f"transform(spots, p -> struct(p as p, slice(words, greatest(p - {left}, 0) + 1, {size}) as context))")).alias("a")
    ).select("k1", "k2", "total", "a.*")
    hits = (
        around.withColumn("from", F.greatest(F.col("p") - left, F.lit(0)))
        .withColumn("to", F.least(F.col("p"), F.col("total") - n))
        .where("to >= from")
        .select("k1", "k2", "from", "context", F.explode(F.sequence("from", "to")).alias("start"))
        .select("k1", "k2", "start", F.concat_ws(" ", F.slice("context", F.col("start") - F.col("from") + 1, n)).alias("window"))
        .distinct()
    )
    for m in short:
        hits = hits.union(near.select("k1", "k2", F.posexplode(F.expr(_runs(m, _window(m)))).alias("start", "window")))
    hits = materialize(hits.join(windows.select("window", "n").distinct(), "window"), "winnow-hits")

    order = Window.partitionBy("k1", "k2").orderBy("start", "n")
    reached = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = (
        hits.select("k1", "k2", "start", "n").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0)))))
        .groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    )
    # Windows that the same items share are one list, and texts with the same lists one case: each is named once,
    # so a passage that many items and many texts share is not multiplied out.
    listed = materialize(windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("list", F.xxhash64("items")), "winnow-lists")
    cases = hits.select("k1", "k2", "window").distinct().join(listed.select("window", "list"), "window").groupBy("k1", "k2").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    cases = materialize(cases, "winnow-cases")
    named = (
        cases.select("lists").distinct().select("lists", F.explode("lists").alias("list")).join(listed.select("list", "items").dropDuplicates(["list"]), "list")
        .select("lists", F.explode("items").alias("item")).groupBy("lists").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return base, materialize(covered.join(cases, ["k1", "k2"]).join(named, "lists").select("k1", "k2", "n_hit", "items"), "winnow-verdicts")
