"""What a labelled corpus must hold before it is trained on: a row for each gate, with what was measured and the limits.

rows: row_id, text, split, intent, window, activity, action, variables, locations, times (arrays), entities (MAP<type,
ARRAY<span>>), paraphrase (null for most). Spans are compared as written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agro_jobs.functions.text import skeleton
from agro_jobs.operators import marks

#: Rows of one template in a split; shares of rows and terms that the gates ask for.
TEMPLATE_CAP, IMPLICIT, LEAK, REDUNDANCY, RAREST, BALANCED, EDGES = 6, 0.20, 0.25, (0.08, 0.14), 0.05, 0.8, 5
#: Words of a location span that are no names.
GENERIC = (
    "and", "my", "me", "by", "this", "our", "here", "i", "near", "nearby", "area", "place", "field", "farm", "village", "plot", "location", "feild", "vilage", "ka", "ki", "point", "bad",
    "whole", "entire", "full", "complete", "all", "rest", "remainder", "throughout", "day", "week", "month", "year", "night",
)
CUTS = (20, 40, 80, 120, 160, 200, 300, 500)  # fixed values: the ladder of word counts


def spans() -> Column:
    """All spans of a row: places, times and entities."""
    return F.concat("locations", "times", F.flatten(F.map_values("entities")))


def unrecovered(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row_id, type, term: recorded entities that the vocabulary does not find in their text, whatever their case."""
    said = rows.select("row_id", F.explode("entities").alias("type", "terms")).select("row_id", "type", F.explode("terms").alias("term"))
    found = marks.entities(rows.where(F.size("entities") > 0).select("row_id", "text"), vocabulary, ["row_id"]).select("row_id", "type", F.explode("spans").alias("span"))
    return said.withColumn("low", F.lower("term")).join(found.select("row_id", "type", F.lower("span").alias("low")), ["row_id", "type", "low"], "left_anti").select("row_id", "type", "term")


def _counts(rows: DataFrame) -> DataFrame:
    """One row of measures over texts, templates, windows and paraphrase groups, from one pass with grouping sets."""
    keyed = rows.select(
        "split", F.col("split").alias("s"), "window", "paraphrase", F.md5(F.lower("text").cast("binary")).alias("key"), F.md5(skeleton(F.col("text"), F.concat("locations", "times")).cast("binary")).alias("shape"),
        F.struct("intent", "window", "activity", F.array_sort("variables")).alias("labels"),
    ).withColumn("w", F.col("window"))
    sets = [[F.col("key")], [F.col("split"), F.col("shape")], [F.col("w")], [F.col("paraphrase")]]
    kind = F.grouping_id("key", "split", "shape", "w", "paraphrase")
    per = keyed.groupingSets(sets, "key", "split", "shape", "w", "paraphrase").agg(
        kind.alias("kind"), F.count("*").alias("n"), F.min("s").alias("first"), F.max("s").alias("last"), F.min("labels").alias("a"), F.max("labels").alias("b")
    )
    text, shape, window, group = F.col("kind") == 0b01111, F.col("kind") == 0b10011, F.col("kind") == 0b11101, (F.col("kind") == 0b11110) & F.col("paraphrase").isNotNull()
    total = F.sum(F.when(text, F.col("n")))
    return per.agg(
        total.alias("rows"), F.coalesce(F.sum(F.when(text, F.col("n") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.max(F.when(shape, F.col("n"))), F.lit(0)).alias("template"),
        F.count_if(text & (F.col("first") != F.col("last"))).alias("shared"), F.coalesce(F.min(F.when(window, F.col("n"))) / total, F.lit(0.0)).alias("rarest"),
        F.coalesce(F.sum(F.when(group, F.col("n"))) / total, F.lit(0.0)).alias("redundancy"), F.count_if(group & (F.col("a") != F.col("b"))).alias("disagree"),
    )


def report(rows: DataFrame, vocabulary: DataFrame, cues: DataFrame, groups: dict[str, str], no_data: Sequence[str]) -> DataFrame:
    """gate, measured, low, high, passed: all gates of the corpus; cues: activity, cue; groups: the action of each activity."""
    whole = _counts(rows)
    stray = F.exists(spans(), lambda s: ~F.contains(F.col("text"), s))
    action = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("activity")]
    none = F.col("intent").isin(*no_data)
    wrong = ~F.col("action").eqNullSafe(action) | ((F.col("intent") == "ADVICE") == (F.col("activity") == "NONE"))
    claims = (F.col("window") != "NONE") | (F.size("variables") > 0) | (F.size("times") > 0)
    cued = rows.where("intent = 'ADVICE'").join(F.broadcast(cues), (rows["activity"] == cues["activity"]) & F.lower(rows["text"]).contains(cues["cue"]), "left_semi").groupBy("activity").agg(F.count("*").alias("hit"))
    per = rows.where("intent = 'ADVICE'").groupBy("activity").agg(F.count("*").alias("n")).join(cued, "activity", "left")
    terms = rows.select("activity", F.explode("entities").alias("type", "terms")).select("activity", "type", F.explode("terms").alias("term")).groupBy("type", F.lower("term").alias("term")).agg(F.min("activity").alias("a"), F.max("activity").alias("b"))
    flagged = rows.agg(F.count_if(stray).alias("stray"), F.count_if(wrong).alias("wrong"), F.count_if(F.when(none, claims).otherwise(F.col("window") == "NONE")).alias("unfetched"))
    missing = unrecovered(rows, vocabulary).agg(F.count("*").alias("missing"))
    implicit = per.agg(F.coalesce(F.min(1 - F.coalesce("hit", F.lit(0)) / F.col("n")), F.lit(1.0)).alias("implicit"))
    leak = terms.agg(F.coalesce(F.avg((F.col("a") == F.col("b")).cast("double")), F.lit(0.0)).alias("leak"))
    one = whole.join(flagged).join(missing).join(implicit).join(leak)  # a row each
    limits = [
        ("duplicate texts", "duplicates", None, 0.0), ("template cap", "template", None, float(TEMPLATE_CAP)), ("spans verbatim", "stray", None, 0.0), ("entities recovered", "missing", None, 0.0), ("labels agree", "wrong", None, 0.0),
        ("windows only where data is fetched", "unfetched", None, 0.0), ("splits disjoint", "shared", None, 0.0), ("rows without a cue", "implicit", IMPLICIT, None), ("entity leak", "leak", None, LEAK),
        ("paraphrases", "redundancy", *REDUNDANCY), ("paraphrases agree", "disagree", None, 0.0), ("rarest window", "rarest", RAREST, None),
    ]
    gate = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("measured"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high")) for g, c, lo, hi in limits])
    out = one.select(F.inline(gate))
    return out.withColumn("passed", (F.coalesce(F.col("measured") >= F.col("low"), F.lit(True))) & (F.coalesce(F.col("measured") <= F.col("high"), F.lit(True))))


def edge_cases(rows: DataFrame, least: int = EDGES) -> DataFrame:
    """edge, n, enough: how many rows (locations, times) carry what no template makes by itself."""
    has = {
        "address form": F.exists("locations", lambda s: F.contains(s, F.lit(","))), "clock time": F.exists("times", lambda s: s.rlike(r"(?i)\d[:\d]* ?(am|pm)")), "multi-location": F.size("locations") > 1,
        "no entities": F.size("locations") + F.size("times") == 0, "two time spans": F.size("times") > 1,
    }
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in has.items()]).unpivot([], list(has), "edge", "n")
    return counts.withColumn("enough", F.col("n") >= least)


def cell_balance(rows: DataFrame, a: str, a_values: Sequence[str], b: str, b_values: Sequence[str], least: float = BALANCED) -> DataFrame:
    """a, b, n, passed: every cell of the grid, empty ones too, held against the fullest."""
    grid = rows.sparkSession.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} string, {b} string")
    cells = grid.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").fillna(0, ["n"])
    top = cells.agg(F.max("n").alias("_top"))
    return cells.join(F.broadcast(top)).withColumn("passed", (F.col("n") > 0) & (F.col("n") >= least * F.col("_top"))).drop("_top")


def vocabulary_use(rows: DataFrame, vocabulary: DataFrame, key: Sequence[str]) -> DataFrame:
    """type, term, n, unused: how often every term of the vocabulary (term, type) stands in the texts, those that never do too."""
    used = marks.hits(rows, vocabulary.select("term", "type"), key).groupBy("type", "term").agg(F.count("*").alias("n"))
    return vocabulary.select("type", "term").join(used, ["type", "term"], "left").fillna(0, ["n"]).withColumn("unused", F.col("n") == 0)


def token_shares(rows: DataFrame, text: str = "text", locations: str = "locations") -> DataFrame:
    """word, n, inside: how often each token is used, and how often in the head of a location span (before its first comma)."""
    def words(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(marks.TOKEN), F.lit(0))

    used = rows.select(F.explode(words(F.col(text))).alias("word"), F.lit(0).alias("in_span"))
    heads = rows.select(F.explode(locations).alias("span")).select(F.explode(words(F.substring_index("span", ",", 1))).alias("word"), F.lit(1).alias("in_span"))
    return used.unionByName(heads).groupBy("word").agg(F.count_if(F.col("in_span") == 0).alias("n"), F.count_if(F.col("in_span") == 1).alias("inside"))


def word_cut(rows: DataFrame, text: str = "text", locations: str = "locations", cuts: Sequence[int] = CUTS, share: float = 0.5) -> DataFrame:
    """cut, names, commonest: the first cut at which no place name is as frequent, else the last one.

    A word is a place name if at least `share` of its uses are in heads of location spans; a few uses of "the" inside a
    country's name don't make it one.
    """
    shares = token_shares(rows, text, locations)
    name = (F.col("inside") > 0) & (F.col("n") > 0) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*GENERIC) & (F.col("inside") >= share * F.col("n"))
    most = shares.agg(F.count_if(name).alias("names"), F.coalesce(F.max(F.when(name, F.col("n"))), F.lit(0)).alias("commonest"))
    first = F.get(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("commonest")), F.lit(0))
    return most.select(F.coalesce(first, F.lit(cuts[-1])).cast("int").alias("cut"), "names", "commonest")
