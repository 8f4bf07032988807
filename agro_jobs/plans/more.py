"""Queries on what was asked, how it is answered, and generated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.functions import dims
from agro_jobs.operators import asked, generate, spans
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import clean_readings, table, view, with_clean
from agro_jobs.sources import feeds

ASKED = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'RAIN' WHEN 1 THEN 'TEMPERATURE' WHEN 2 THEN 'HUMIDITY' ELSE 'OTHER' END AS variable, CASE o_orderkey % 3 WHEN 0 THEN 'SUM' WHEN 1 THEN 'AVG' ELSE 'COUNT' END AS statistic, "
    "CASE o_orderkey % 5 WHEN 0 THEN 'what is the total rain' WHEN 1 THEN 'average wind direction' WHEN 2 THEN 'is it the hottest day' WHEN 3 THEN 'strong gusts' ELSE 'weather' END AS text, CASE WHEN o_orderkey % 6 = 0 THEN 'SPRAY' WHEN o_orderkey % 6 = 1 THEN 'SOW' END AS activity, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'HISTORY' ELSE 'FORECAST' END AS intent, CAST(o_orderkey % 20 AS INT) AS days FROM orders"
)


def questions(spark, d):
    body = ASKED.removesuffix(" FROM orders").removeprefix("SELECT ")
    table(spark, d, "orders").createOrReplaceTempView("_asked_orders")
    return spark.sql(f"SELECT {body} FROM _asked_orders")


@query("fields_for", f"SELECT id, CASE variable WHEN 'RAIN' THEN 'Rainfall,Tavg,RH' WHEN 'TEMPERATURE' THEN 'Tmin,Tmax,Tavg,Rainfall,RH' WHEN 'HUMIDITY' THEN 'RH,RH_max,RH_min,Tavg,Rainfall' ELSE 'Tavg,Rainfall,RH' END AS fields FROM ({ASKED})")
def _(spark, d):
    q = questions(spark, d).select("id", F.array("variable", F.lit("GENERAL")).alias("variables"))
    return asked.fields_for(q).select("id", F.array_join("fields", ",").alias("fields"))


@query("statistic_pairs", f"SELECT id, variable, 'MAX' AS statistic, 2 AS pos FROM ({ASKED}) WHERE variable = 'RAIN' UNION ALL SELECT id, variable, 'SUM', 1 FROM ({ASKED}) WHERE variable = 'RAIN' UNION ALL SELECT id, variable, 'MAX', 1 FROM ({ASKED}) WHERE variable IN ('TEMPERATURE', 'HUMIDITY')")
def _(spark, d):
    q = questions(spark, d).select("id", F.array("variable").alias("variables"), F.array(F.lit("SUM"), F.lit("MAX")).alias("statistics"))
    return asked.pairs(q, dims.gates(spark))


@query("spoken_statistic", f"SELECT id, CASE WHEN id % 5 = 0 AND id % 3 = 0 THEN 'SUM' WHEN id % 5 = 1 AND id % 3 = 1 THEN 'AVG' ELSE 'RAW' END AS statistic, CASE id % 5 WHEN 1 THEN 'Wind_Direction' WHEN 3 THEN 'Wind_max' END AS column_name FROM ({ASKED})")
def _(spark, d):
    return questions(spark, d).select("id", asked.spoken_statistic(F.col("text"), F.col("statistic")).alias("statistic"), asked.column_named(F.col("text")).alias("column_name"))


@query("question_defaults", f"SELECT id, CASE activity WHEN 'SPRAY' THEN 'next 2 days' WHEN 'SOW' THEN 'next 7 days' ELSE 'next 7 days' END AS \"window\", CASE WHEN intent = 'HISTORY' AND days > 7 THEN CASE WHEN variable = 'RAIN' THEN 'SUM' ELSE 'AVG' END ELSE 'RAW' END AS statistic FROM ({ASKED})")
def _(spark, d):
    q = questions(spark, d).withColumns({"window": F.lit(None).cast("string"), "statistic": F.lit(None).cast("string")})
    return asked.with_defaults(q).select("id", "window", "statistic")


@query("digest", with_clean("SELECT place_id, field, min(value) AS low, max(value) AS high, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean FROM (SELECT place_id, 'Tmax' AS field, Tmax AS value FROM clean UNION ALL SELECT place_id, 'RH', RH FROM clean) WHERE value IS NOT NULL GROUP BY 1, 2"))
def _(spark, d):
    return asked.digest(clean_readings(spark, d), ["place_id"], ["Tmax", "RH"])


@query("headline_figure", with_clean("SELECT place_id, CAST(sum(CAST(Rainfall AS DECIMAL(18,4))) AS DOUBLE) AS figure FROM clean GROUP BY 1"))
def _(spark, d):
    return asked.headline(clean_readings(spark, d), ["place_id"], "Rainfall", "SUM")


@query("selected_rows", with_clean("SELECT place_id, event_id FROM (SELECT *, CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND CAST(DATE '2024-01-10' + CAST(place_id % 3 AS INT) AS DATE) AS inside, place_id % 3 > 0 AS span, row_number() OVER (PARTITION BY place_id ORDER BY ts) AS r, max(CAST(CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND CAST(DATE '2024-01-10' + CAST(place_id % 3 AS INT) AS DATE) AS INT)) OVER (PARTITION BY place_id) AS hit FROM clean) WHERE inside OR (hit = 0 AND span AND r <= 7)"))
def _(spark, d):
    rows = clean_readings(spark, d)
    windows = rows.select("place_id").distinct().select("place_id", F.expr("DATE '2024-01-10'").alias("start"), F.expr("date_add(DATE '2024-01-10', CAST(place_id % 3 AS INT))").alias("end"))
    return asked.selected(rows, windows, "place_id").select("place_id", "event_id")


@query("preferred_source", with_clean("SELECT place_id, ts, CASE WHEN event_id % 3 = 0 THEN 'lookback' ELSE 'archive' END AS source, CASE WHEN event_id % 3 = 0 THEN 'archive' END AS fell_back_from FROM clean"))
def _(spark, d):
    rows = clean_readings(spark, d).select("place_id", "ts", "event_id", "Rainfall")
    return feeds.preferred([("archive", rows.where("event_id % 3 != 0")), ("lookback", rows)]).select("place_id", "ts", "source", "fell_back_from")


@query("hourly_beside_daily", with_clean("SELECT c.place_id, c.event_id, c.Rainfall, d.rain AS day_Rainfall FROM clean c JOIN (SELECT place_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(Rainfall AS DECIMAL(18,4))) AS DOUBLE) AS rain FROM clean GROUP BY 1, 2) d ON d.place_id = c.place_id AND d.day = CAST(c.ts AS DATE)"))
def _(spark, d):
    rows = clean_readings(spark, d)
    days = rows.groupBy("place_id", F.to_date("ts").alias("ts")).agg(F.sum(F.col("Rainfall").cast("decimal(18,4)")).cast("double").alias("Rainfall"))
    return feeds.with_daily(rows, days, ["Rainfall"]).select("place_id", "event_id", "Rainfall", "day_Rainfall")


@query("model_disagreements", "SELECT question, 'intent' AS field FROM (SELECT user_id AS question, CASE WHEN user_id % 3 = 0 THEN 'view' ELSE event_type END AS intent FROM events) GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT intent) > 1")
def _(spark, d):
    answers = table(spark, d, "events").selectExpr("user_id AS question", "CASE WHEN user_id % 3 = 0 THEN 'view' ELSE event_type END AS intent")
    return asked.disagreements(answers, ["intent"])


@query("formatted_cells", with_clean("SELECT place_id, event_id, CASE WHEN Lowcloud IS NULL THEN '-' ELSE CAST(CAST(round(Lowcloud * 100) AS INT) AS VARCHAR) || '%' END AS cloud, CASE WHEN Rainfall IS NULL THEN '-' ELSE regexp_replace(regexp_replace(printf('%.2f', Rainfall), '0+$', ''), '\\.$', '') END AS rain FROM clean"))
def _(spark, d):
    return clean_readings(spark, d).select("place_id", "event_id", asked.formatted("Lowcloud", F.col("Lowcloud")).alias("cloud"), asked.formatted("Rainfall", F.col("Rainfall")).alias("rain"))


FRAMES = (("f1", "can i spray in {place} {time}", "SPRAY"), ("f2", "spraying at {place} {time}?", "SPRAY"), ("f3", "should i travel to {place} {time}", "TRAVEL"), ("f4", "is {place} fine for a trip {time}", "TRAVEL"))


def _generated(spark, d):
    keys = view(spark, d, "corpus").select("row_id")
    frames = spark.createDataFrame(FRAMES, "frame string, template string, activity string")
    places, times = table(spark, d, "nation").select(F.col("n_name").alias("place")), spark.createDataFrame([("today",), ("tomorrow",), ("next week",)], "time string")
    return generate.filled(keys, frames, places, times), frames


def picked(n, key: str, seed: int = 0) -> str:
    return f"(CAST('0x' || left(md5('{seed}:' || CAST({key} AS VARCHAR)), 8) AS BIGINT) % {n})"


GENERATED = (
    "frames AS (SELECT *, row_number() OVER (ORDER BY frame) - 1 AS pos, row_number() OVER (PARTITION BY activity ORDER BY frame) - 1 AS k FROM (VALUES " + ", ".join(f"('{f}', '{t}', '{a}')" for f, t, a in FRAMES) + ") v(frame, template, activity)), "
    "p AS (SELECT n_name AS place, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation), t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos FROM (VALUES ('today'), ('tomorrow'), ('next week')) v(time)), "
    f"rows_ AS (SELECT doc_id AS row_id, frame, k, activity, place, time, replace(replace(template, '{{place}}', place), '{{time}}', time) AS text FROM documents JOIN frames ON frames.pos = {picked(4, 'doc_id', 0)} JOIN p ON p.pos = {picked('(SELECT count(*) FROM nation)', 'doc_id', 1)} JOIN t ON t.pos = {picked(3, 'doc_id', 2)})"
)


@query("generated_rows", f"WITH {GENERATED} SELECT row_id, frame, text, activity, CASE WHEN {picked(100, 'row_id', 77)} < 30 THEN row_id END AS paraphrase FROM rows_ UNION ALL SELECT row_id, f.frame, replace(replace(f.template, '{{place}}', place), '{{time}}', time), r.activity, row_id FROM rows_ r JOIN frames f ON f.activity = r.activity AND f.k = (r.k + 1) % 2 WHERE {picked(100, 'row_id', 77)} < 30")
def _(spark, d):
    rows, frames = _generated(spark, d)
    return generate.paraphrased(rows, frames).select("row_id", "frame", "text", "activity", "paraphrase")


@query("generated_chats", f"WITH {GENERATED} SELECT row_id AS chat_id, CAST(turn AS INT) AS turn, CASE WHEN turn = 0 THEN text ELSE (['what about tomorrow?', 'and there next week?', 'and the wind?'])[CAST({picked(3, 'row_id || chr(58) || turn')} AS INT) + 1] END AS text, place FROM rows_ CROSS JOIN (SELECT unnest([0, 1, 2]) AS turn)")
def _(spark, d):
    return generate.chats(_generated(spark, d)[0])


# ---------------------------------------------------------------- spans and labels


@query("length_quartiles", "SELECT intent, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3 FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'ADVICE' WHEN doc_id % 4 = 1 THEN 'FORECAST' WHEN doc_id % 4 = 2 THEN 'HISTORY' ELSE 'GREETING' END AS intent, len(string_split_regex(trim(text), '\\s+')) AS n FROM documents) GROUP BY 1")
def _(spark, d):
    return spans.length_quartiles(view(spark, d, "corpus"), "intent")


@query("slot_presence", "SELECT 'paraphrase' AS slot, CAST(count(*) FILTER (doc_id % 6 = 0) AS DOUBLE) / count(*) AS share FROM documents UNION ALL SELECT 'activity', 1.0 FROM documents GROUP BY 1")
def _(spark, d):
    return spans.slot_presence(view(spark, d, "corpus"), ("paraphrase", "activity"))


@query("places_in_text", "WITH w AS (SELECT p_partkey AS id, unnest(string_split('rain in ' || p_name, ' ')) AS word, unnest(range(0, len(string_split('rain in ' || p_name, ' ')))) AS i FROM part), g AS (SELECT lower(split_part(p_name, ' ', 1)) AS word, min(p_partkey) AS place_id FROM part GROUP BY 1), h AS (SELECT w.id, g.place_id, min(i) AS i FROM w JOIN g USING (word) GROUP BY 1, 2) SELECT id, place_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i, place_id) AS r FROM h) WHERE r <= 2")
def _(spark, d):
    p = table(spark, d, "part")
    texts, names = p.selectExpr("p_partkey AS id", "'rain in ' || p_name AS text"), p.selectExpr("p_partkey AS id", "split_part(p_name, ' ', 1) AS name")
    return spans.find_in(texts, names).select("id", "place_id")


@query("capped_places", "SELECT question, span, CASE WHEN place_id IS NULL THEN 'unresolved' WHEN sum(CAST(place_id IS NOT NULL AS INT)) OVER (PARTITION BY question ORDER BY span) <= 3 THEN 'kept' ELSE 'dropped' END AS fate FROM (SELECT l_orderkey AS question, l_linenumber AS span, CASE WHEN l_partkey % 5 > 0 THEN l_partkey END AS place_id FROM lineitem)")
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS question", "l_linenumber AS span", "CASE WHEN l_partkey % 5 > 0 THEN l_partkey END AS place_id")
    return spans.capped_places(rows).select("question", "span", "fate")
