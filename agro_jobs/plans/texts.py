"""Queries over texts: time wording, vocabulary, audits, corpus gates, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.functions import text as X
from agro_jobs.functions import timex
from agro_jobs.operators import audit, corpus, evaluate
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import ansi, table, view
from agro_jobs.sources.shared import once_each

AS_OF = "DATE '2024-03-15'"
#: A time phrase for each event, written from its own day and value.
PHRASE = (
    "CASE event_id % 9 WHEN 0 THEN 'today' WHEN 1 THEN 'next ' || CAST(1 + event_id % 13 AS STRING) || ' days' WHEN 2 THEN 'rain on ' || CAST(CAST(ts AS DATE) AS STRING) WHEN 3 THEN 'in 2023' WHEN 4 THEN 'from 2019 to 2021' WHEN 5 THEN 'the last decade' "
    "WHEN 6 THEN 'june 2022' WHEN 7 THEN '' ELSE 'between 2024-02-30 and ' || CAST(CAST(ts AS DATE) AS STRING) END"
)
ASKED = f"asked AS (SELECT event_id, {PHRASE.replace('STRING', 'VARCHAR')} AS phrase FROM events)"
HORIZON = f"CAST({AS_OF} + 6 AS DATE)"


def _asked(spark, d):
    return table(spark, d, "events").selectExpr("event_id", f"{PHRASE} AS phrase")


@query("dates_in_text", f"WITH {ASKED} SELECT event_id, array_to_string([CAST(TRY_CAST(x AS DATE) AS VARCHAR) FOR x IN regexp_extract_all(phrase, '\\d{{4}}-\\d{{2}}-\\d{{2}}') IF TRY_CAST(x AS DATE) IS NOT NULL], ',') AS dates FROM asked")
def _(spark, d):
    return _asked(spark, d).select("event_id", F.array_join(F.transform(timex.dates_in(F.col("phrase")), lambda x: x.cast("string")), ",").alias("dates"))


WINDOW = (
    f"WITH {ASKED} SELECT event_id, CASE WHEN phrase IN ('', 'today') OR phrase LIKE 'next %' THEN {AS_OF} WHEN phrase LIKE 'rain on %' OR phrase LIKE 'between %' THEN CAST(right(phrase, 10) AS DATE) WHEN phrase = 'in 2023' THEN DATE '2023-01-01' WHEN phrase LIKE 'from 2019%' THEN DATE '2019-01-01' WHEN phrase = 'june 2022' THEN DATE '2022-06-01' ELSE CAST({AS_OF} - 3653 AS DATE) END AS start, "
    f"CASE WHEN phrase = '' THEN {HORIZON} WHEN phrase = 'today' THEN {AS_OF} WHEN phrase LIKE 'next %' THEN CAST({AS_OF} + CAST(split_part(phrase, ' ', 2) AS INT) - 1 AS DATE) WHEN phrase LIKE 'rain on %' OR phrase LIKE 'between %' THEN CAST(right(phrase, 10) AS DATE) WHEN phrase = 'in 2023' THEN DATE '2023-12-31' WHEN phrase LIKE 'from 2019%' THEN DATE '2021-12-31' WHEN phrase = 'june 2022' THEN DATE '2022-06-30' ELSE {AS_OF} END AS stop FROM asked"
)


@query("resolve_window", WINDOW)
def _(spark, d):
    w = timex.window(F.col("phrase"), F.expr(AS_OF))
    return once_each(_asked(spark, d), ["phrase"], w=w).select("event_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"))


@query("grain_for_span", f"SELECT event_id, days, CASE WHEN days <= 10 THEN 'hourly,daily' WHEN days <= 31 THEN 'daily' WHEN days <= 366 THEN 'daily,weekly,monthly' WHEN days <= 3653 THEN 'monthly,yearly' ELSE 'yearly' END AS grains FROM (SELECT event_id, date_diff('day', start, stop) + 1 AS days FROM ({WINDOW}))")
def _(spark, d):
    days = timex.span_days(F.col("w"))
    return _asked(spark, d).select("event_id", timex.window(F.col("phrase"), F.expr(AS_OF)).alias("w")).select("event_id", days.cast("long").alias("days"), F.array_join(timex.grains(days), ",").alias("grains"))


@query(
    "rows_in_window",
    f"WITH {ansi('archive')} SELECT place_id, count(*) AS n, CAST(sum(CAST(Rainfall AS DECIMAL(18,4))) AS DOUBLE) AS rain FROM archive WHERE day BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' GROUP BY 1",
)
def _(spark, d):
    asked = spark.range(1).select(timex.window(F.lit("june 1996"), F.expr("DATE '1999-01-01'")).alias("w"))
    rows = view(spark, d, "archive").join(F.broadcast(asked), F.col("day").between(F.col("w.start"), F.col("w.end")))
    return rows.groupBy("place_id").agg(F.count("*").alias("n"), F.sum(F.col("Rainfall").cast("decimal(18,4)")).cast("double").alias("rain"))


@query("time_bucket", f"WITH {ASKED} SELECT event_id, CASE WHEN phrase = '' THEN 'NONE' WHEN phrase = 'today' THEN 'TODAY' WHEN phrase LIKE 'next %' THEN 'NONE' WHEN phrase = 'the last decade' THEN 'PAST' ELSE 'DATE' END AS bucket FROM asked")
def _(spark, d):
    return _asked(spark, d).select("event_id", timex.bucket(F.col("phrase")).alias("bucket"))


# ---------------------------------------------------------------- text


@query("clean_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9:]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query("tokens", r"SELECT item_id, len(regexp_extract_all(text, '([A-Za-z]+(?:''[a-z]+)?|\d+(?:[:.]\d+)*|[^\sA-Za-z0-9])')) AS n, regexp_extract_all(text, '([A-Za-z]+(?:''[a-z]+)?|\d+(?:[:.]\d+)*|[^\sA-Za-z0-9])')[1] AS first FROM benchmark")
def _(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"))


TERMS = [t for ts in X.ENTITIES.values() for t in ts]


@query(
    "entities",
    "WITH said AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' for my cotton field' WHEN 1 THEN ' by Tractor and bus' WHEN 2 THEN ' bengal gram and Neem Oil' WHEN 3 THEN ' at the wedding' ELSE '' END AS text FROM part) "
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'cotton' WHEN 2 THEN 'bengal gram' ELSE '' END AS crop, CASE p_partkey % 5 WHEN 1 THEN 'Tractor,bus' ELSE '' END AS transport, CASE p_partkey % 5 WHEN 2 THEN 'Neem Oil' ELSE '' END AS material, CASE p_partkey % 5 WHEN 3 THEN 'wedding' ELSE '' END AS event FROM said",
)
def _(spark, d):
    said = table(spark, d, "part").selectExpr("p_partkey", "p_name || CASE p_partkey % 5 WHEN 0 THEN ' for my cotton field' WHEN 1 THEN ' by Tractor and bus' WHEN 2 THEN ' bengal gram and Neem Oil' WHEN 3 THEN ' at the wedding' ELSE '' END AS text")
    e = said.withColumn("e", X.entities(F.col("text")))
    return e.select("p_partkey", *[F.coalesce(F.array_join(F.try_element_at("e", F.lit(k)), ","), F.lit("")).alias(k) for k in ("crop", "transport", "material", "event")])


SAID = "said AS (SELECT o_orderkey AS id, 'Total ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ' of 7777777' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' according to it' ELSE ' but wait' END AS said, 'given ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS given, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'CAUTION' END AS verdict FROM orders)"


def _said(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS id",
        "'Total ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ' of 7777777' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' according to it' ELSE ' but wait' END AS said",
        "'given ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS given", "CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'CAUTION' END AS verdict",
    )


@query("figures_grounded", f"WITH {SAID} SELECT id, id % 3 <> 0 AS grounded FROM said")
def _(spark, d):
    return _said(spark, d).select("id", audit.grounded(F.col("said"), F.col("given")).alias("grounded"))


@query("usable_reason", f"WITH {SAID} SELECT id, CASE WHEN id % 5 = 0 THEN 'scaffolding' WHEN id % 3 = 0 THEN 'figures' ELSE 'usable' END AS reason FROM said")
def _(spark, d):
    return _said(spark, d).select("id", F.coalesce(audit.reason(F.col("said"), F.col("given"), F.col("given"), F.col("verdict")), F.lit("usable")).alias("reason"))


W = "regexp_extract_all(lower(text), '([a-z0-9.]+)')"


@query("echo_8gram", f"WITH d AS (SELECT doc_id, {W} AS w FROM documents), b AS (SELECT DISTINCT array_to_string(w[i:i+7], ' ') AS g FROM (SELECT {W} AS w, unnest(range(1, len({W}) - 6)) AS i FROM benchmark)) SELECT doc_id, count(DISTINCT g) AS shared FROM (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)) JOIN b USING (g) GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(audit.grams(audit.words(F.col("text")))).alias("g"))
    items = table(spark, d, "benchmark").select(F.explode(audit.grams(audit.words(F.col("text")))).alias("g")).distinct()
    return docs.join(items, "g", "left_semi").groupBy("doc_id").agg(F.countDistinct("g").alias("shared"))


# ---------------------------------------------------------------- corpus

def skeleton():
    return F.regexp_replace(F.lower("text"), "[aeiou]+", "@")


SKELETON_SQL = "regexp_replace(lower(text), '[aeiou]+', '@', 'g')"


def csql(body: str, *more: str) -> str:
    return f"WITH {', '.join([ansi('corpus'), *more])} {body}"


@query("dedupe_text", csql("SELECT row_id, split FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY row_id) AS r FROM corpus) WHERE r = 1"))
def _(spark, d):
    return corpus.first_per(view(spark, d, "corpus"), F.lower("text"), ["row_id"]).select("row_id", "split")


@query("skeleton_cap", csql(f"SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY split, {SKELETON_SQL} ORDER BY row_id) AS r FROM corpus) WHERE r <= 2"))
def _(spark, d):
    return corpus.skeleton_cap(view(spark, d, "corpus"), skeleton(), 2).select("row_id")


@query("cell_quota", csql("SELECT row_id FROM (SELECT *, row_number() OVER (PARTITION BY source, intent ORDER BY row_id) AS r FROM corpus) WHERE r <= 7"))
def _(spark, d):
    return corpus.cell_quota(view(spark, d, "corpus"), ["source", "intent"], 7).select("row_id")


@query("top_up", csql("SELECT intent, activity, count(*) AS have, greatest(90 - count(*), 0) AS missing FROM corpus GROUP BY 1, 2"))
def _(spark, d):
    return corpus.top_up(view(spark, d, "corpus"), ["intent", "activity"], 90)


@query("cross_split", csql("SELECT row_id, split FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, row_id) AS r FROM corpus) WHERE r = 1"))
def _(spark, d):
    return corpus.cross_split(view(spark, d, "corpus")).select("row_id", "split")


@query("paraphrase_redundancy", csql("SELECT CAST(count(paraphrase) AS DOUBLE) / count(*) AS share, count(DISTINCT paraphrase) AS groups FROM corpus"))
def _(spark, d):
    return corpus.redundancy(view(spark, d, "corpus"))


@query("label_agreement", csql("SELECT paraphrase, count(DISTINCT intent || activity) AS kinds FROM corpus WHERE paraphrase IS NOT NULL GROUP BY 1 HAVING count(DISTINCT intent || activity) > 1"))
def _(spark, d):
    return corpus.disagreeing(view(spark, d, "corpus"), ["intent", "activity"])


@query("shortcut_rate", csql("SELECT activity, count(*) AS n, CAST(count(*) FILTER (contains(lower(text), CASE activity WHEN 'SPRAY' THEN 'the' WHEN 'TRAVEL' THEN 'que' ELSE 'der' END)) AS DOUBLE) / count(*) AS share FROM corpus GROUP BY ROLLUP (activity)"))
def _(spark, d):
    cues = spark.createDataFrame([("SPRAY", "the"), ("TRAVEL", "que"), ("SOW", "der")], "activity string, cue string")
    return corpus.shortcut_rate(view(spark, d, "corpus"), cues)


@query("entity_leak", csql("SELECT type, count(*) AS terms, count(*) FILTER (k = 1) AS leaking FROM (SELECT source AS type, term, count(DISTINCT activity) AS k FROM (SELECT source, activity, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM corpus) GROUP BY 1, 2) GROUP BY 1"))
def _(spark, d):
    terms = view(spark, d, "corpus").select(F.col("source").alias("type"), "activity", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1))).alias("term"))
    return corpus.entity_leak(terms)


@query("coverage_grid", csql("SELECT i.intent, a.activity, coalesce(c.n, 0) AS n FROM (SELECT unnest(['ADVICE', 'FORECAST', 'HISTORY', 'GREETING', 'CONTROL']) AS intent) i CROSS JOIN (SELECT unnest(['SPRAY', 'TRAVEL', 'SOW', 'DRYING']) AS activity) a LEFT JOIN (SELECT intent, activity, count(*) AS n FROM corpus GROUP BY 1, 2) c USING (intent, activity)"))
def _(spark, d):
    return corpus.coverage_grid(view(spark, d, "corpus"), "intent", ["ADVICE", "FORECAST", "HISTORY", "GREETING", "CONTROL"], "activity", ["SPRAY", "TRAVEL", "SOW", "DRYING"])


@query(
    "corpus_violations",
    csql(
        f"SELECT 'duplicate' AS \"check\", substr(lower(text), 1, 30) AS key, count(*) AS n FROM corpus GROUP BY lower(text) HAVING count(*) > 1 UNION ALL SELECT 'template cap', substr(split || ':' || {SKELETON_SQL}, 1, 30), count(*) FROM corpus GROUP BY split || ':' || {SKELETON_SQL} HAVING count(*) > 3 "
        "UNION ALL SELECT 'splits overlap', substr(lower(text), 1, 30), count(DISTINCT split) FROM corpus GROUP BY lower(text) HAVING count(DISTINCT split) > 1"
    ),
)
def _(spark, d):
    return corpus.violations(view(spark, d, "corpus"), skeleton(), 3)


@query(
    "reject_reasons",
    csql(
        "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN again THEN 'duplicate' WHEN row_number() OVER (PARTITION BY split, sk, again ORDER BY row_id) > 3 THEN 'template cap' ELSE 'kept' END AS reason FROM marked) GROUP BY 1",
        f"marked AS (SELECT *, {SKELETON_SQL} AS sk, row_number() OVER (PARTITION BY lower(text) ORDER BY row_id) > 1 AS again FROM corpus)",
    ),
)
def _(spark, d):
    return corpus.rejections(view(spark, d, "corpus"), skeleton(), 3)


@query("word_cut", csql("SELECT coalesce(max(CASE WHEN word IN (SELECT lower(n_name[1:3]) FROM nation UNION SELECT unnest(['the', 'und', 'que', 'los'])) THEN n END), 0) + 1 AS cut FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM corpus) GROUP BY 1)"))
def _(spark, d):
    names = table(spark, d, "nation").select(F.lower(F.substring("n_name", 1, 3)).alias("word")).union(spark.createDataFrame([("the",), ("und",), ("que",), ("los",)], "word string")).distinct()
    return corpus.smallest_cut(corpus.word_cut(view(spark, d, "corpus"), names))


@query("unseen_spans", csql("SELECT DISTINCT word FROM w WHERE split = 'eval' AND word NOT IN (SELECT word FROM w WHERE split <> 'eval')", "w AS (SELECT split, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM corpus)"))
def _(spark, d):
    return corpus.unseen_spans(view(spark, d, "corpus"))


@query("label_counts", csql("SELECT label, value, count(*) AS n FROM (SELECT 'intent' AS label, intent AS value FROM corpus UNION ALL SELECT 'activity', activity FROM corpus UNION ALL SELECT 'split', split FROM corpus) GROUP BY 1, 2"))
def _(spark, d):
    return corpus.label_counts(view(spark, d, "corpus"), ["intent", "activity", "split"])


# ---------------------------------------------------------------- scores

TARGETS = [("gold", "predicted"), ("gold2", "predicted2")]


def gsql(body: str) -> str:
    return f"WITH {ansi('gold')} {body}"


@query("target_accuracy", gsql("SELECT count(*) AS n, CAST(count(*) FILTER (gold = predicted) AS DOUBLE) / count(*) AS gold, CAST(count(*) FILTER (gold2 = predicted2) AS DOUBLE) / count(*) AS gold2, CAST(count(*) FILTER (gold = predicted AND gold2 = predicted2) AS DOUBLE) / count(*) AS everything FROM gold"))
def _(spark, d):
    return evaluate.accuracy(view(spark, d, "gold"), TARGETS)


@query("micro_f1", gsql("SELECT tp, fp, fn, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT CAST(sum(CAST(gold = predicted AS INT) + CAST(gold2 = predicted2 AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(gold <> predicted AS INT) + CAST(gold2 <> predicted2 AS INT)) AS BIGINT) AS fp, CAST(sum(CAST(gold <> predicted AS INT) + CAST(gold2 <> predicted2 AS INT)) AS BIGINT) AS fn FROM gold)"))
def _(spark, d):
    rows = view(spark, d, "gold").select(F.array("gold", F.col("gold2").cast("string")).alias("g"), F.array("predicted", F.col("predicted2").cast("string")).alias("p"))
    return evaluate.set_f1(rows, "g", "p")


@query("span_f1", gsql("SELECT tp, CAST(tp AS DOUBLE) / n AS precision, CAST(tp AS DOUBLE) / n AS recall, round(CAST(tp AS DOUBLE) / n, 9) AS f1 FROM (SELECT CAST(sum(CAST(gold = predicted AS INT) * 2) AS BIGINT) AS tp, count(*) * 2 AS n FROM gold)"))
def _(spark, d):
    rows = view(spark, d, "gold").select("doc_id", F.array("gold", F.lower("gold")).alias("g"), F.array(F.lower("predicted"), "predicted").alias("p"))
    return evaluate.span_f1(rows, "g", "p", "doc_id").withColumn("f1", F.round("f1", 9))


CUTS = "CASE WHEN score >= 0.95 THEN 0.95 WHEN score >= 0.85 THEN 0.85 WHEN score >= 0.75 THEN 0.75 WHEN score >= 0.6 THEN 0.6 WHEN score >= 0.45 THEN 0.45 WHEN score >= 0.3 THEN 0.3 ELSE 0.0 END"


@query("confidence_bands", gsql(f"SELECT low, n, CAST(k AS DOUBLE) / n AS accuracy, CAST(n AS DOUBLE) / sum(n) OVER () AS share, CAST(sum(k) OVER (ORDER BY low DESC) AS DOUBLE) / sum(n) OVER (ORDER BY low DESC) AS above FROM (SELECT CAST({CUTS} AS DOUBLE) AS low, count(*) AS n, count(*) FILTER (gold = predicted) AS k FROM gold GROUP BY 1)"))
def _(spark, d):
    return evaluate.bands(view(spark, d, "gold"), F.col("gold") == F.col("predicted"))


@query("threshold_sweep", gsql("SELECT cut, tp, fp, fn, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (SELECT CAST(c.cut AS DOUBLE) AS cut, count(*) FILTER (gold2 = 1 AND score >= c.cut) AS tp, count(*) FILTER (gold2 <> 1 AND score >= c.cut) AS fp, count(*) FILTER (gold2 = 1 AND score < c.cut) AS fn FROM gold CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS cut) c GROUP BY 1)"))
def _(spark, d):
    return evaluate.threshold_sweep(view(spark, d, "gold"), F.col("gold2") == 1, [0.2, 0.4, 0.6, 0.8])


@query("per_class_f1", gsql("SELECT class, CAST(sum(g) AS BIGINT) AS support, CAST(sum(t) AS DOUBLE) / nullif(sum(p), 0) AS precision, CAST(sum(t) AS DOUBLE) / nullif(sum(g), 0) AS recall, 2.0 * sum(t) / (sum(g) + sum(p)) AS f1 FROM (SELECT gold AS class, 1 AS g, 0 AS p, CAST(gold = predicted AS INT) AS t FROM gold UNION ALL SELECT predicted, 0, 1, 0 FROM gold) GROUP BY 1"))
def _(spark, d):
    return evaluate.per_class(view(spark, d, "gold"), "gold", "predicted")


@query("failure_harvest", gsql("SELECT doc_id, concat_ws(',', CASE WHEN gold <> predicted THEN 'gold' END, CASE WHEN gold2 <> predicted2 THEN 'gold2' END) AS wrong FROM gold WHERE gold <> predicted OR gold2 <> predicted2"))
def _(spark, d):
    return evaluate.failures(view(spark, d, "gold"), "doc_id", TARGETS).withColumn("wrong", F.concat_ws(",", "wrong"))


@query("kfold", gsql("SELECT doc_id, gold, CAST((row_number() OVER (PARTITION BY gold ORDER BY doc_id) - 1) % 5 AS INT) AS fold FROM gold"))
def _(spark, d):
    return evaluate.kfold(view(spark, d, "gold"), "gold", "doc_id")


@query("confusion_matrix", gsql("SELECT gold, predicted, count(*) AS n FROM gold WHERE gold <> predicted GROUP BY 1, 2"))
def _(spark, d):
    return evaluate.confusion(view(spark, d, "gold"), "gold", "predicted")
