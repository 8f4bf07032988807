"""Where words and vocabulary terms stand in texts: rows with offsets in code points (terms: in words), end exclusive.

Rows are told apart by the key columns, which must name one text each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agro_jobs.sources.shared import dealt_by, written

#: Fixed value: what a tagger reads as one token: clock times, numbers with a unit, words, numbers, single marks.
TOKEN = r"\d+:\d+|\d+[a-zA-Z]+|[A-Za-z]+|\d+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"  # what a word boundary lies around


def located(rows: DataFrame, key: Sequence[str], text: str = "text", pattern: str = TOKEN) -> DataFrame:
    """key, pos, token, start, end, gap: every match of the pattern in order; gap is the text before it, back to the one before.

    What lies between matches is what splitting by the same pattern leaves, so offsets are
    running sums of lengths, taken over rows: a text may be as long as it likes.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    found = F.regexp_extract_all(said, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(found.alias("token"), F.slice(F.split(said, pattern), F.lit(1), F.size(found)).alias("gap"))
    each = rows.select(*key, F.posexplode(parts).alias("pos", "part")).select(*key, "pos", "part.token", "part.gap")
    size = F.char_length("token")
    upto = F.sum(size + F.char_length("gap")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("end", upto.cast("int")).select(*key, "pos", "token", (F.col("end") - size).alias("start"), "end", "gap")


def word_runs(rows: DataFrame, key: Sequence[str], text: str, longest: int) -> DataFrame:
    """key, start, end, span: every word, and up to `longest` words that are one blank apart. start and end count the text's words, end exclusive.

    All of this is worked out within the text's own row, and nothing is shuffled. A word that is one blank before the next one is found with that blank.
    """
    words = rows.select(*key, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"{WORD}(?: (?={WORD[:-1]}))?"), F.lit(0)).alias("_w"))
    each = words.select(*key, F.posexplode(F.arrays_zip(*[F.slice("_w", F.lit(i + 1), F.size("_w")).alias(f"w{i}") for i in range(longest)])).alias("start", "_w"))
    spans, whole = [], F.lit(True)
    for n in range(1, longest + 1):
        before = [F.col(f"_w.w{i}") for i in range(n - 1)]
        whole = whole & F.endswith(before[-1], F.lit(" ")) if before else whole
        spans.append(F.struct((F.col("start") + n).alias("end"), F.when(whole, F.concat(*before, F.rtrim(F.col(f"_w.w{n - 1}")))).alias("span")))
    return each.select(*key, "start", F.inline(F.array(*spans))).where("span IS NOT NULL")


def hits(rows: DataFrame, terms: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, start, end, span and the columns of terms (term, type; words apart by one blank): every place where a term stands between word boundaries, whatever its case.

    start and end count the text's words, end exclusive; span is what is written there.
    """
    longest = terms.agg(F.coalesce(F.max(F.size(F.split("term", " "))), F.lit(1))).first()[0]
    found = word_runs(rows, key, text, longest).withColumn("_said", F.lower("span"))
    return found.join(terms.withColumn("_said", F.lower("term")), "_said").drop("_said")


#: Fixed value: how many groups the terms of a kind are counted in before they are told apart.
BUCKETS = 1 << 16


def commonest(said: DataFrame, n: int) -> DataFrame:
    """kind, term, n: the n commonest terms of each kind (int) of the rows (kind, term; a row for each use), the first in order on ties.

    A term is used no more often than all the terms of its bucket (of a hash), so terms are told apart only in the fullest buckets, and
    then in all that may hold one as common as those: of the many rare terms, hardly any is shuffled.
    """
    said = said.select("kind", "term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    sizes = written(said.groupBy("kind", "bucket").agg(F.count("*").alias("n")), "buckets")

    def first(counted: DataFrame, by: str, most: int) -> DataFrame:
        return counted.withColumn("_no", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), by))).where(F.col("_no") <= most).drop("_no")

    def counted(buckets: DataFrame) -> DataFrame:
        return said.join(F.broadcast(buckets.select("kind", "bucket")), ["kind", "bucket"], "left_semi").groupBy("kind", "term").agg(F.count("*").alias("n"))

    fullest = written(first(sizes, "bucket", 8 * n), "buckets")
    found = written(first(counted(fullest), "term", n), "terms")
    least = found.groupBy("kind").agg(F.when(F.count("*") == n, F.min("n")).alias("_least"))
    rest = sizes.join(F.broadcast(least), "kind", "left").where(F.col("n") >= F.coalesce("_least", F.lit(0)))
    rest = written(rest.join(F.broadcast(fullest.select("kind", "bucket")), ["kind", "bucket"], "left_anti"), "buckets")
    return found if rest.isEmpty() else first(found.unionByName(counted(rest)), "term", n)


def longest_first(found: DataFrame, key: Sequence[str], rank: Sequence[Column]) -> DataFrame:
    """The matches (start, end) that stay when they are taken in the order of `rank` and none may overlap one taken before.

    Matches that touch each other directly or through others form an island; islands don't affect each
    other, so each is decided by itself, over the few matches it has.
    """
    order = Window.partitionBy(*key).orderBy("start", "end")
    begins = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.withColumn("_new", begins.cast("int"))
    upto = F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # the same for all matches with this start and end
    alone = (F.col("_new") == 1) & F.coalesce(F.lead("start").over(order) >= F.col("end"), F.lit(True)) & F.coalesce(F.lag("start").over(order) < F.col("start"), F.lit(True))
    numbered = numbered.withColumn("_island", F.when(~alone, upto))  # those that touch none, which all stay, are one group
    others = [c for c in found.columns if c not in key]
    match = F.struct(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]).alias("rank"), *[F.col(c) for c in others])
    islands = numbered.groupBy(*key, "_island").agg(F.collect_list(match).alias("all"))
    none = F.expr("filter(all, x -> false)")
    kept = F.when(F.col("_island").isNull(), F.col("all")).otherwise(
        F.aggregate(F.array_sort("all"), none, lambda taken, m: F.when(F.exists(taken, lambda t: (t["start"] < m["end"]) & (m["start"] < t["end"])), taken).otherwise(F.concat(taken, F.array(m))))
    )
    return islands.select(*key, F.explode(kept).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in others])


def entities(rows: DataFrame, terms: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, type, spans: the terms (term, type, and their order `no`) of each text as written, longest terms first over the whole text; a span counts once a type."""
    wanted = written(terms.select("term", "type", "no"), "terms")  # a small table; each step reads it
    found = hits(dealt_by(rows.select(*key, text), key), wanted, key, text)  # from here on all of a text's rows are in one task
    rank = [-F.col("size"), F.col("no"), F.col("start")]
    kept = longest_first(found.select(*key, "start", "end", F.char_length("term").alias("size"), "no", "type", "span"), key, rank)
    ranked = F.array_sort(F.collect_list(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], "span")))
    return kept.groupBy(*key, "type").agg(F.array_distinct(F.transform(ranked, lambda x: x["span"])).alias("spans"))


def vocabulary(spark, table: dict[str, tuple[str, ...]]) -> DataFrame:
    """term, type, no: a closed vocabulary as rows, in its own order."""
    return spark.createDataFrame([(t, kind, i) for i, (kind, t) in enumerate((k, t) for k, ts in table.items() for t in ts)], "term string, type string, no int")
