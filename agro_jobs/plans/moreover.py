"""Queries over single rules: time words, spans, places, labels, scores, each held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.functions import text as X
from agro_jobs.functions import timewords, timex
from agro_jobs.operators import asked, convo, corpus, evaluate, ml, places, spans, turns
from agro_jobs.plans.registry import query
from agro_jobs.plans.texts import AS_OF, ASKED, csql, gsql
from agro_jobs.plans.texts import _asked as phrases
from agro_jobs.plans.views import ansi, table, view
from agro_jobs.sources.shared import once_each, spread

# ---------------------------------------------------------------- time words


@query("one_date", f"WITH {ASKED} SELECT event_id, CASE WHEN phrase LIKE 'rain on %' OR phrase LIKE 'between %' THEN CAST(right(phrase, 10) AS DATE) END AS day, CASE WHEN phrase LIKE 'rain on %' OR phrase LIKE 'between %' THEN CAST(day(last_day(CAST(right(phrase, 10) AS DATE))) AS INT) END AS days FROM asked")
def _(spark, d):
    day = timex.one_date_in(F.col("phrase"))
    return phrases(spark, d).select("event_id", day.alias("day")).select("event_id", "day", timex.month_days(F.col("day")).alias("days"))


@query("tense", f"WITH {ASKED} SELECT event_id, CASE WHEN phrase = 'today' THEN 'CURRENT' WHEN phrase IN ('in 2023', 'from 2019 to 2021', 'the last decade', 'june 2022') THEN 'HISTORICAL' WHEN phrase LIKE 'rain on %' OR phrase LIKE 'between %' THEN CASE WHEN CAST(right(phrase, 10) AS DATE) < {AS_OF} THEN 'HISTORICAL' ELSE 'FORECAST' END ELSE 'FORECAST' END AS tense FROM asked")
def _(spark, d):
    return phrases(spark, d).select("event_id", timex.tense(F.col("phrase"), F.expr(AS_OF)).alias("tense"))


@query("mentions_time", "SELECT p_partkey, p_partkey % 4 < 2 OR regexp_matches(lower(p_name), '\\b(monday|may|march|now|today|past|last)') AS says FROM part")
def _(spark, d):
    said = F.expr("p_name || CASE p_partkey % 4 WHEN 0 THEN ' this weekend' WHEN 1 THEN ' at 5 pm' ELSE ' please' END")
    return table(spark, d, "part").select("p_partkey", timex.mentions_time(said).alias("says"))


@query("window_of_duration", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) - to_days(CAST(o_orderkey % 10 AS INT)) ELSE CAST(o_orderdate AS TIMESTAMP) END AS start, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 10 AS INT)) END AS stop FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderdate", "CAST(o_orderkey % 10 AS INT) AS n", "CASE WHEN o_orderkey % 3 = 0 THEN 'rain so far' ELSE 'rain for' END AS said")
    w = spans.from_duration(F.col("n"), "DAY", F.col("said"), F.col("o_orderdate"))
    return rows.select("o_orderkey", w.alias("w")).select("o_orderkey", F.col("w.start").alias("start"), F.col("w.end").alias("stop"))


@query("run_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 40 >= 24 THEN strftime(o_orderdate, '%d %b') || ' to ' || strftime(o_orderdate + to_hours(CAST(o_orderkey % 40 AS INT)), '%d %b') ELSE strftime(o_orderdate, '%d %b %H:%M') || ' to ' || strftime(o_orderdate + to_hours(CAST(o_orderkey % 40 AS INT)), '%H:%M') END AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", spans.run_label(F.col("o_orderdate"), F.col("o_orderkey") % 40).alias("label"))


#: Spans as people write them, and what they mean.
WRITTEN = (
    ("on Friday", "friday"), ("5 pm to 8:30pm", "17:00-20:30"), ("at 6:45 PM", "18:45"), ("12 am", "00:00"), ("next 6 hrs", "next 6 hours"), ("in 3 weeks", "next 3 weeks"), ("the whole day", "today"), ("entire weekend", "this weekend"),
    ("previous records", "last 7 days"), ("tmrw!", "tomorrow"), ("weekand", "this weekend"), ("yesterdy", "yesterday"), ("for", ""), ("25:10", "25:10"), ("some odd words", "some odd words"), ("tonigth", "tonight"), ("12:30", "12:30"),
)


@query("normalize_time", "SELECT event_id, ([" + ", ".join(f"'{m}'" for _, m in WRITTEN) + f"])[CAST(event_id % {len(WRITTEN)} AS INT) + 1] AS meant FROM events")
def _(spark, d):
    said = F.element_at(F.array(*[F.lit(s) for s, _ in WRITTEN]), (F.col("event_id") % len(WRITTEN)).cast("int") + 1)
    rows = table(spark, d, "events").select("event_id", said.alias("said"))
    return once_each(rows, ["said"], meant=timewords.canonical(F.col("said"))).select("event_id", "meant")


HOURS = "CASE event_id % 6 WHEN 0 THEN '07:30-11:00' WHEN 1 THEN '18:45' WHEN 2 THEN 'early morning' WHEN 3 THEN '2024-01-02t06:00 to 2024-01-02t11:59' WHEN 4 THEN 'next 3 days' ELSE 'whenever' END"


@query(
    "resolve_hours",
    "SELECT event_id, CASE k WHEN 0 THEN day + to_days(CAST(hour(ts) > 11 AS INT)) + INTERVAL 7 HOUR WHEN 1 THEN day + to_days(CAST(ts > day + INTERVAL 1125 MINUTE AS INT)) + INTERVAL 1125 MINUTE WHEN 2 THEN day + INTERVAL 4 HOUR WHEN 3 THEN TIMESTAMP '2024-01-02 06:00:00' ELSE day END AS start, "
    "CASE k WHEN 0 THEN day + to_days(CAST(hour(ts) > 11 AS INT)) + INTERVAL 719 MINUTE WHEN 1 THEN day + to_days(CAST(ts > day + INTERVAL 1125 MINUTE AS INT)) + INTERVAL 1185 MINUTE WHEN 2 THEN day + INTERVAL 479 MINUTE WHEN 3 THEN TIMESTAMP '2024-01-02 11:59:00' WHEN 4 THEN day + INTERVAL 2 DAY ELSE day + INTERVAL 6 DAY END AS stop, "
    "CASE WHEN k < 4 THEN 'hourly' ELSE 'daily' END AS granularity, k < 5 AS understood FROM (SELECT event_id, event_id % 6 AS k, CAST(ts AS TIMESTAMP) AS ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events)",
)
def _(spark, d):
    w = timewords.moments(F.expr(HOURS), F.col("ts"))
    return table(spark, d, "events").select("event_id", w.alias("w")).select("event_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "w.granularity", "w.understood")


@query("time_spans", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '4:15 pm to 6 pm|next 3 days' WHEN 1 THEN '7 hrs' ELSE '' END AS spans FROM events")
def _(spark, d):
    said = F.expr("CASE event_id % 3 WHEN 0 THEN 'rain next 3 days at 4:15 pm to 6 pm' WHEN 1 THEN 'dry for 7 hrs' ELSE 'at 12 or 2024' END")
    return table(spark, d, "events").select("event_id", F.array_join(timewords.time_spans(said), "|").alias("spans"))


@query("qualified_spans", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'the Last 7 days' WHEN 1 THEN '7 days' WHEN 2 THEN 'coming 7 days' ELSE '7 days' END AS span, CASE event_id % 4 WHEN 1 THEN 'History' WHEN 2 THEN 'historical data' END AS noun FROM events")
def _(spark, d):
    said = F.expr("CASE event_id % 4 WHEN 0 THEN 'rain in the Last 7 days' WHEN 1 THEN 'History of 7 days' WHEN 2 THEN 'historical data for coming 7 days' ELSE 'for 7 days (last)' END")
    return table(spark, d, "events").select("event_id", timewords.with_qualifier(said, F.lit("7 days")).alias("span"), timewords.history_noun(said).alias("noun"))


@query("joined_spans", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '11 jan 2026 and 17 jan 2026' WHEN 1 THEN '2024-01-02 - 2024-01-05|monday' ELSE 'monday|friday' END AS spans FROM events")
def _(spark, d):
    said = F.expr("CASE event_id % 3 WHEN 0 THEN 'rain 11 jan 2026 and 17 jan 2026' WHEN 1 THEN 'from 2024-01-02 - 2024-01-05, then again on monday' ELSE 'monday, in Guntur if it is dry; friday' END")
    parts = F.expr("CASE event_id % 3 WHEN 0 THEN array('11', '2026 and 17 jan 2026') WHEN 1 THEN array('2024-01-02', '2024-01-05', 'monday') ELSE array('monday', 'friday') END")
    return table(spark, d, "events").select("event_id", F.array_join(timewords.joined_spans(said, parts), "|").alias("spans"))


# ---------------------------------------------------------------- what is read and shown


@query("unservable_columns", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Lowcloud,RH_max' WHEN 1 THEN '' ELSE 'Wind_max' END AS missing FROM orders")
def _(spark, d):
    wanted = F.expr("CASE o_orderkey % 3 WHEN 0 THEN array('RH_max', 'Tmax', 'Lowcloud') WHEN 1 THEN array('Tmax') ELSE array('Rainfall', 'Wind_max') END")
    return table(spark, d, "orders").select("o_orderkey", F.array_join(asked.unservable(wanted, ("Rainfall", "Tmax", "Tmin", "RH")), ",").alias("missing"))


FIELD = "CASE event_id % 6 WHEN 0 THEN 'Tavg' WHEN 1 THEN 'SunSD' WHEN 2 THEN 'Lowcloud' WHEN 3 THEN 'Wind_max' WHEN 4 THEN 'Soilt10' ELSE 'nothing' END"


@query("variable_of", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'TEMPERATURE' WHEN 1 THEN 'UV' WHEN 2 THEN 'UV' WHEN 3 THEN 'WIND' WHEN 4 THEN 'SOIL_TEMPERATURE' END AS variable FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", asked.variable_of(F.expr(FIELD)).alias("variable"))


@query("shape", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'rose' WHEN 1 THEN 'running' WHEN 2 THEN 'grid' WHEN 3 THEN 'lines' WHEN 4 THEN 'band' WHEN 5 THEN 'combo' ELSE 'bars' END AS shape FROM events")
def _(spark, d):
    fields = F.expr("CASE event_id % 7 WHEN 0 THEN array('Wind_Direction') WHEN 2 THEN array('RH') WHEN 3 THEN array('Tmax', 'Tmin') WHEN 4 THEN array('Tmax', 'Tmin') WHEN 5 THEN array('Rainfall', 'RH') ELSE array('Rainfall') END")
    statistic = F.expr("CASE event_id % 7 WHEN 0 THEN 'MODE' WHEN 1 THEN 'CUMULATIVE' ELSE 'RAW' END")
    k = F.col("event_id") % 7
    return table(spark, d, "events").select("event_id", asked.shape(fields, statistic, k == 2, F.when(k == 3, 2).otherwise(1), F.lit(5)).alias("shape"))


# ---------------------------------------------------------------- places


@query("plausible_names", r"SELECT p_partkey, regexp_matches(name, '^[A-Za-z][A-Za-z .''#0-9-]{3,27}$') AS ok FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE substr(p_name, 1, 3) END AS name FROM part)")
def _(spark, d):
    name = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE substr(p_name, 1, 3) END")
    return table(spark, d, "part").select("p_partkey", places.plausible(name).alias("ok"))


@query("clean_codes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AB' || CAST(p_size AS VARCHAR) || ',MH' WHEN 1 THEN 'DL1' ELSE '' END AS codes FROM part")
def _(spark, d):
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('mh', concat(' ab', p_size), 'MH', 'é1') WHEN 1 THEN array('INDL1', 'dl1', 'x') ELSE array('much too long', '') END")
    return table(spark, d, "part").select("p_partkey", F.array_join(places.clean_codes(raw), ",").alias("codes"))


@query("split_span", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || p_type ELSE 'a|' || p_brand || '|c|d' END AS parts FROM part")
def _(spark, d):
    span = F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' ,' || p_type ELSE 'a,' || p_brand || ',, c,d' END")
    return table(spark, d, "part").select("p_partkey", F.array_join(spans.split_span(span), "|").alias("parts"))


NEAR = "CASE s_suppkey % 3 WHEN 0 THEN substr(s_name, 2) WHEN 1 THEN 'X' || substr(s_name, 3) ELSE s_name || '7' END"


@query("near_names", f"WITH s AS (SELECT s_suppkey AS span_id, lower({NEAR}) AS said FROM supplier) SELECT span_id, id, distance FROM (SELECT span_id, n.s_suppkey AS id, levenshtein(lower(n.s_name), said) AS distance, row_number() OVER (PARTITION BY span_id ORDER BY levenshtein(lower(n.s_name), said), n.s_suppkey) AS r FROM s JOIN supplier n ON levenshtein(lower(n.s_name), said) <= 2) WHERE r <= 3")
def _(spark, d):
    s = table(spark, d, "supplier")
    got = places.suggestions(s.selectExpr("s_suppkey AS span_id", f"{NEAR} AS span"), s.selectExpr("s_suppkey AS id", "s_name AS name"))
    return got.withColumn("distance", F.col("distance").cast("long"))


@query("folded_names", r"SELECT doc_id, regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '^\s+|\s+$', '', 'g') AS key FROM documents")
def _(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", X.folded("text").alias("key"))


# ---------------------------------------------------------------- turns and labels


@query("whole_conversations", f"WITH {ansi('turns')} SELECT chat_id, id, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS pos, text, 'P' || CAST(turn % 3 AS VARCHAR) AS place FROM turns")
def _(spark, d):
    rows = view(spark, d, "turns").withColumn("places", F.to_json(F.array(F.concat(F.lit("P"), (F.col("turn") % 3).cast("string")))))
    return turns.conversations(rows, {"places": "array<string>"}).select("chat_id", "id", "pos", "text", F.get("places", F.lit(0)).alias("place"))


@query("missing_slots", f"WITH {ansi('turns')} SELECT chat_id, turn FROM turns WHERE intent IN ('ADVICE', 'FORECAST', 'HISTORY') AND turn % 3 = 0")
def _(spark, d):
    rows = view(spark, d, "turns").withColumn("places", F.expr("CASE WHEN turn % 3 > 0 THEN 'P' END"))
    return convo.missing_slots(rows).select("chat_id", "turn")


@query("replay_scores", f"WITH {ansi('turns')} SELECT avg(CAST((chat_id + turn) % 5 > 0 AS INT)) AS operation, avg(CAST((chat_id + turn) % 7 > 0 AS INT)) AS places, 1.0 AS time FROM turns")
def _(spark, d):
    gold = view(spark, d, "turns").selectExpr("chat_id", "turn", "'SET' AS operation", "'P' AS places", "CAST(NULL AS STRING) AS time")
    folded = view(spark, d, "turns").selectExpr("chat_id", "turn", "CASE WHEN (chat_id + turn) % 5 > 0 THEN 'SET' ELSE 'MODIFY' END AS operation", "CASE WHEN (chat_id + turn) % 7 > 0 THEN 'P' END AS places", "CAST(NULL AS STRING) AS time")
    return convo.replay_scores(folded, gold)


@query("constrained_labels", csql("SELECT row_id, CASE WHEN intent <> 'GREETING' THEN source END AS source, CASE WHEN intent = 'ADVICE' THEN activity END AS activity FROM corpus"))
def _(spark, d):
    return ml.constrained(view(spark, d, "corpus"), ("GREETING",), "intent", ("source",)).select("row_id", "source", "activity")


@query("sampled_rows", csql("SELECT row_id FROM corpus ORDER BY md5('5:' || CAST(row_id AS VARCHAR)), row_id LIMIT 40"))
def _(spark, d):
    return corpus.sampled(view(spark, d, "corpus"), 40, 5).select("row_id")


@query("cut_points", gsql("SELECT coalesce(min(low) FILTER (above >= 0.95), 0.95) AS accept, coalesce(max(low) FILTER (accuracy < 0.6), 0.45) AS clarify FROM (SELECT low, CAST(k AS DOUBLE) / n AS accuracy, CAST(sum(k) OVER (ORDER BY low DESC) AS DOUBLE) / sum(n) OVER (ORDER BY low DESC) AS above FROM (SELECT CAST(CASE WHEN score >= 0.95 THEN 0.95 WHEN score >= 0.85 THEN 0.85 WHEN score >= 0.75 THEN 0.75 WHEN score >= 0.6 THEN 0.6 WHEN score >= 0.45 THEN 0.45 WHEN score >= 0.3 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS low, count(*) AS n, count(*) FILTER (gold = predicted) AS k FROM gold GROUP BY 1))"))
def _(spark, d):
    return evaluate.cut_points(evaluate.bands(view(spark, d, "gold"), F.col("gold") == F.col("predicted")))


@query("references", f"WITH {ansi('turns')}, t AS (SELECT id, turn, CASE turn % 4 WHEN 0 THEN 'And over There' WHEN 1 THEN 'the same day' WHEN 2 THEN 'what about wind' ELSE 'rain please' END AS said FROM turns) SELECT id, CASE turn % 4 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'LOCATION' ELSE 'NONE' END AS kind, turn % 4 IN (0, 2) AS follows, turn % 4 IN (2, 3) AS measures, FALSE AS acts FROM t")
def _(spark, d):
    said = F.expr("CASE turn % 4 WHEN 0 THEN 'And over There' WHEN 1 THEN 'the same day' WHEN 2 THEN 'what about wind' ELSE 'rain please' END")
    return view(spark, d, "turns").select("id", X.reference(said).alias("kind"), X.follow_up(said).alias("follows"), X.mentions_any(said, ("rain", "wind")).alias("measures"), X.mentions_any(said, X.ACTIONS).alias("acts"))
