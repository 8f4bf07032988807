"""Assembling a labelled corpus and gating it: uniqueness, caps, quotas, leaks, balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "test", "eval")


def first_per(rows: DataFrame, key: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; the rest has rank > 1 in the column _rank of `ranked`."""
    return ranked(rows, key, order).where("_rank = 1").drop("_rank")


def ranked(rows: DataFrame, key: Column, order: Sequence[str | Column]) -> DataFrame:
    return rows.withColumn("_key", key).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).drop("_key")


def split_order() -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))


def skeleton_cap(rows: DataFrame, skeleton: Column, cap: int = 6) -> DataFrame:
    """At most `cap` rows per split and template."""
    return ranked(rows, F.struct("split", skeleton), ["row_id"]).where(F.col("_rank") <= cap).drop("_rank")


def cell_quota(rows: DataFrame, cells: Sequence[str], quota: int) -> DataFrame:
    """At most `quota` rows per cell."""
    return ranked(rows, F.struct(*cells), ["row_id"]).where(F.col("_rank") <= quota).drop("_rank")


def top_up(rows: DataFrame, cells: Sequence[str], want: int) -> DataFrame:
    """cells, have, missing: what each cell still needs."""
    return rows.groupBy(*cells).agg(F.count("*").alias("have")).withColumn("missing", F.greatest(F.lit(want) - F.col("have"), F.lit(0)))


def cross_split(rows: DataFrame) -> DataFrame:
    """One row per text over all splits; the first split keeps it."""
    return first_per(rows, F.lower("text"), [split_order(), "row_id"])


def rejections(rows: DataFrame, skeleton: Column, cap: int = 6) -> DataFrame:
    """reason, n: why rows do not enter the corpus."""
    r = rows.withColumn("skeleton", skeleton).withColumn("again", F.row_number().over(Window.partitionBy(F.lower("text")).orderBy("row_id")) > 1)
    r = r.withColumn("over", F.row_number().over(Window.partitionBy("split", "skeleton", "again").orderBy("row_id")) > cap)
    reason = F.when(F.trim("text") == "", "empty").when(F.col("again"), "duplicate").when(F.col("over"), "template cap").otherwise("kept")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def redundancy(rows: DataFrame) -> DataFrame:
    """share, groups: how much of the corpus is paraphrase."""
    return rows.agg((F.count("paraphrase").cast("double") / F.count("*")).alias("share"), F.countDistinct("paraphrase").alias("groups"))


def disagreeing(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """paraphrase, kinds: groups whose rows do not have the same labels."""
    return rows.where("paraphrase IS NOT NULL").groupBy("paraphrase").agg(F.countDistinct(F.struct(*labels)).alias("kinds")).where("kinds > 1")


def shortcut_rate(rows: DataFrame, cues: DataFrame) -> DataFrame:
    """activity (null: all), n, share: rows that name a cue (activity, cue) of their own activity."""
    hits = rows.join(F.broadcast(cues), (rows["activity"] == cues["activity"]) & F.lower(rows["text"]).contains(cues["cue"]), "left_semi").select("row_id").withColumn("hit", F.lit(1))
    flagged = rows.join(hits, "row_id", "left")
    return flagged.rollup("activity").agg(F.count("*").alias("n"), (F.count("hit").cast("double") / F.count("*")).alias("share"))


def entity_leak(terms: DataFrame) -> DataFrame:
    """type, terms, leaking: terms (type, term, activity) seen with one activity only, by type."""
    per = terms.groupBy("type", "term").agg(F.countDistinct("activity").alias("k"))
    return per.groupBy("type").agg(F.count("*").alias("terms"), F.count_if(F.col("k") == 1).alias("leaking"))


def coverage_grid(rows: DataFrame, a: str, a_values: Sequence[str], b: str, b_values: Sequence[str]) -> DataFrame:
    """a, b, n: every cell of the grid, the empty ones too (the grid is two fixed lists)."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    return grid.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])


def violations(rows: DataFrame, skeleton: Column, cap: int = 6) -> DataFrame:
    """check, key, detail: everything that is wrong with a corpus; an empty result passes the gate."""
    twice = rows.groupBy(F.lower("text").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("check"), F.substring("key", 1, 30).alias("key"), "n")
    over = rows.groupBy(F.concat_ws(":", "split", skeleton).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(F.lit("template cap").alias("check"), F.substring("key", 1, 30).alias("key"), "n")
    both = rows.groupBy(F.lower("text").alias("key")).agg(F.countDistinct("split").cast("bigint").alias("n")).where("n > 1").select(F.lit("splits overlap").alias("check"), F.substring("key", 1, 30).alias("key"), "n")
    return twice.unionByName(over).unionByName(both)


def word_cut(rows: DataFrame, names: DataFrame) -> DataFrame:
    """word, n, inside: how often a word occurs, and how often as one of the names."""
    words = rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    return n.join(names.withColumn("inside", F.lit(True)), "word", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def smallest_cut(cuts: DataFrame) -> DataFrame:
    """cut: the smallest word count above every name's."""
    return cuts.agg((F.coalesce(F.max(F.when(F.col("inside"), F.col("n"))), F.lit(0)) + 1).alias("cut"))


def unseen_spans(rows: DataFrame, word: str = "word") -> DataFrame:
    """Words of the eval split that occur in no other split."""
    w = rows.select("split", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))).alias(word))
    return w.where("split = 'eval'").select(word).distinct().join(w.where("split != 'eval'").select(word).distinct(), word, "left_anti")


def label_counts(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label, value, n: value counts of every label column."""
    return rows.unpivot(["row_id"], list(labels), "label", "value").groupBy("label", "value").agg(F.count("*").alias("n"))


def sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")).cast("binary")), "row_id").limit(n)


def row_faults(rows: DataFrame, intents: Sequence[str], actions: Sequence[str], aggregations: Sequence[str]) -> DataFrame:
    """rows with fault: the first rule a row breaks, null for none. rows: text, intent, action, aggregation, location, time (arrays of spans)."""
    def stray(spans: str) -> Column:
        return F.exists(spans, lambda s: ~F.contains("text", s))

    preposition = F.exists("time", lambda s: s.rlike(r"(?i)^(on|at|in|from|for|during|by|over)\s"))
    fault = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text").when(~F.col("intent").isin(*intents), "bad intent").when(~F.col("action").isin(*actions), "bad action")
        .when(~F.col("aggregation").isin(*aggregations), "bad aggregation").when(F.col("location").isNull(), "location is not a list").when(stray("location"), "location span not verbatim")
        .when(F.col("time").isNull(), "time is not a list").when(stray("time"), "time span not verbatim").when(preposition, "time span includes a preposition")
        .when((F.col("action") == "COMPARE") & (F.size("location") + F.size("time") < 2), "COMPARE needs two spans")
    )
    return rows.withColumn("fault", fault)


def corpus_stats(rows: DataFrame, skeleton: Column) -> DataFrame:
    """n, distinct_texts, templates, rows_per_template, busiest."""
    per = rows.groupBy(skeleton.alias("_s")).agg(F.count("*").alias("_n")).agg(F.count("*").alias("templates"), F.max("_n").alias("busiest"))
    texts = rows.agg(F.count("*").alias("n"), F.countDistinct(F.lower("text")).alias("distinct_texts"))
    return texts.join(per).withColumn("rows_per_template", F.col("n").cast("double") / F.col("templates"))  # one row beside one row


def balance(rows: DataFrame, a: str, a_values: Sequence[str], b: str, b_values: Sequence[str], least: float = 0.8) -> DataFrame:
    """cells, empty, low, high, balanced: whether all cells of the grid are there and the rarest has a share `least` of the fullest."""
    grid = coverage_grid(rows, a, a_values, b, b_values)
    low, high = F.min("n"), F.max("n")
    return grid.agg(F.count("*").alias("cells"), F.count_if(F.col("n") == 0).alias("empty"), low.alias("low"), high.alias("high"), ((low > 0) & (low >= least * high)).alias("balanced"))


def merged(sources: Sequence[tuple[str, DataFrame]], by: Sequence[str] = ("chat_id", "turn")) -> DataFrame:
    """The rows of all sources, named in `origin`; of rows with one key, those of the first source."""
    out = None
    for k, (name, rows) in enumerate(sources):
        part = rows.withColumns({"origin": F.lit(name), "_o": F.lit(k)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).where("_r = 1").drop("_o", "_r")


def relabelled(rows: DataFrame, labels: dict[str, str], tense: Column) -> DataFrame:
    """rows with intent in the newer scheme: by the map of old labels, and by tense where the old one only said data."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    new = table[F.col("intent")]
    return rows.withColumn("intent", F.when(new == "DATA", F.when(tense == "HISTORICAL", "HISTORY").otherwise("FORECAST")).otherwise(new))
