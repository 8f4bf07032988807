"""Queries over what answers are made of: rows of a window, remarks, alerts, scores of targets, misspelt names, disagreement of lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.operators import asked, audit, compare, evaluate, noise
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import clean_readings, table, with_clean
from agro_jobs.sources import feeds
from agro_jobs.sources.shared import spread

# ---------------------------------------------------------------- rows

FIRST_DAY = "CAST(DATE '2024-01-10' + CAST(place_id % 5 * 6 AS INT) AS DATE)"
LAST_DAY = "CAST(DATE '2024-01-10' + CAST(place_id % 5 * 6 + place_id % 3 AS INT) AS DATE)"


@query(
    "windowed_rows",
    with_clean(
        "SELECT place_id, event_id FROM k WHERE CASE WHEN place_id % 7 = 0 THEN r <= CASE WHEN hourly THEN 12 ELSE 7 END ELSE inside OR (NOT hit AND f <> l AND NOT late AND left_ <= 7) END",
        f"w AS (SELECT *, CAST(ts AS DATE) AS day, {FIRST_DAY} AS f, {LAST_DAY} AS l, row_number() OVER (PARTITION BY place_id ORDER BY ts) AS r, max(CAST(ts AS DATE)) OVER (PARTITION BY place_id) AS newest FROM clean)",
        "x AS (SELECT *, f >= DATE '2024-01-20' AND day < DATE '2024-01-20' AND newest >= DATE '2024-01-20' AND place_id % 7 <> 0 AS late, bool_or(r <= 24 AND hour(ts) <> 0) OVER (PARTITION BY place_id) AS hourly FROM w)",
        "k AS (SELECT *, day BETWEEN f AND l AND NOT late AS inside, bool_or(day BETWEEN f AND l AND NOT late) OVER (PARTITION BY place_id) AS hit, sum(CAST(NOT late AS INT)) OVER (PARTITION BY place_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS left_ FROM x)",
    ),
)
def _(spark, d):
    rows = clean_readings(spark, d)
    start, end = "date_add(DATE '2024-01-10', CAST(place_id % 5 * 6 AS INT))", "date_add(DATE '2024-01-10', CAST(place_id % 5 * 6 + place_id % 3 AS INT))"
    windows = rows.select("place_id").distinct().selectExpr("place_id", f"{start} AS start", f"{end} AS end", "place_id % 7 <> 0 AS understood")
    return asked.selected(rows, windows, "place_id", as_of=F.expr("DATE '2024-01-20'")).select("place_id", "event_id")


SERVED = (
    "a AS (SELECT * FROM clean WHERE place_id % 4 <> 0), wn AS (SELECT DISTINCT place_id, CAST(DATE '2024-01-01' + CAST(place_id % 9 AS INT) AS DATE) AS f FROM clean), ax AS (SELECT a.* FROM a JOIN wn USING (place_id) WHERE CAST(ts AS DATE) BETWEEN f AND f + 5), "
    "st AS (SELECT place_id, f, CASE WHEN place_id IN (SELECT place_id FROM ax) THEN 'archive' WHEN f >= CAST(DATE '2024-03-05' - 60 AS DATE) THEN 'lookback' ELSE 'error' END AS status FROM wn)"
)


@query("served_window", with_clean("SELECT place_id, event_id, CAST(NULL AS VARCHAR) AS fell_back_from FROM ax UNION ALL SELECT place_id, event_id, 'archive' FROM clean JOIN st USING (place_id) WHERE status = 'lookback' AND CAST(ts AS DATE) BETWEEN f AND f + 5", SERVED))
def _(spark, d):
    return _served(spark, d)[0].select("place_id", "event_id", "fell_back_from")


@query("served_status", with_clean("SELECT place_id, status FROM st", SERVED))
def _(spark, d):
    return _served(spark, d)[1]


def _served(spark, d):
    rows = clean_readings(spark, d).select("place_id", "ts", "event_id", "Rainfall")
    windows = rows.select("place_id").distinct().selectExpr("place_id", "date_add(DATE '2024-01-01', CAST(place_id % 9 AS INT)) AS start", "date_add(DATE '2024-01-01', CAST(place_id % 9 + 5 AS INT)) AS end")
    return feeds.served_window(rows.where("place_id % 4 != 0"), rows, windows, F.expr("DATE '2024-03-05'"))


# ---------------------------------------------------------------- remarks


@query(
    "remarks_on_rain",
    with_clean(
        "SELECT q, CAST(pos AS INT) AS pos, kind, place, text FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY pl, o) AS pos FROM n) WHERE pos <= 4",
        "p AS (SELECT place_id % 40 AS q, place_id, count(Rainfall) AS n, min(Rainfall) AS low, max(Rainfall) AS high, CAST(sum(CAST(Rainfall AS DECIMAL(18,4))) AS DOUBLE) / count(Rainfall) AS mean, count(*) FILTER (Rainfall >= 10) AS over_, count(*) FILTER (Rainfall < 1) AS dry FROM clean GROUP BY 1, 2 HAVING count(Rainfall) > 0)",
        "z AS (SELECT *, dense_rank() OVER (PARTITION BY q ORDER BY place_id) AS pl FROM p)",
        "n AS (SELECT q, 0 AS pl, 0 AS o, 'COMPARISON' AS kind, CAST(NULL AS VARCHAR) AS place, CAST(arg_min(place_id, struct_pack(m := -mean, i := place_id)) AS VARCHAR) || ' leads ' || CAST(arg_max(place_id, struct_pack(m := -mean, i := place_id)) AS VARCHAR) || ' by ' || printf('%.1f', round_even(max(mean) - min(mean), 1)) || ' on mean Rainfall' AS text FROM p GROUP BY q HAVING count(*) > 1 "
        "UNION ALL SELECT q, pl, 1, 'RANGE', CAST(place_id AS VARCHAR), 'mean ' || printf('%.1f', round_even(mean, 1)) || ', range ' || printf('%.1f', low) || '-' || printf('%.1f', high) FROM z WHERE n > 1 UNION ALL SELECT q, pl, 2, 'THRESHOLD', CAST(place_id AS VARCHAR), 'heavy rain on ' || CAST(over_ AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) FROM z WHERE over_ > 0 "
        "UNION ALL SELECT q, pl, 3, 'DRY_SPELL', CAST(place_id AS VARCHAR), CAST(dry AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' dry' FROM z WHERE n > 2 AND dry > 0)",
    ),
)
def _(spark, d):
    return compare.remarks(clean_readings(spark, d).withColumn("q", F.col("place_id") % 40), ["q"], "place_id", "Rainfall")


@query("alert_peaks", with_clean("SELECT place_id, CASE WHEN max(Tmax) IS NULL THEN 'no Tmax values' ELSE 'watching Tmax, peak in range ' || printf('%.1f', round_even(max(Tmax), 1)) END AS said FROM clean GROUP BY 1"))
def _(spark, d):
    return compare.watching(clean_readings(spark, d), ["place_id"], "Tmax")


TOKENS = r"regexp_extract_all(lower(text), '[a-z]+')"


@query(
    "list_disagreements",
    "WITH a AS (SELECT conv_id AS q, turn % 3 AS model, list_sort(list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:2], lambda x: lower(x))) AS words, role FROM conversations), g AS (SELECT q, count(*) AS k, count(DISTINCT CAST(words AS VARCHAR)) AS w, count(DISTINCT role) AS r FROM a GROUP BY 1 HAVING count(*) >= 2) SELECT q AS question, 'words' AS field FROM g WHERE w > 1 UNION ALL SELECT q, 'role' FROM g WHERE r > 1",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("question"), F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 2).alias("words"), "role")
    return asked.disagreements(rows, ["words", "role"], ["words"])


# ---------------------------------------------------------------- scores and names


@query(
    "target_shares",
    "WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'ADVICE' ELSE 'OTHER' END AS intent, CASE WHEN doc_id % 7 = 0 THEN 'OTHER' WHEN quality = 1 THEN 'ADVICE' ELSE 'OTHER' END AS intent2, doc_id % 5 <> 0 AS vars, doc_id % 3 <> 0 AS spans, toxic = 0 OR doc_id % 2 = 0 AS act FROM labels) "
    "SELECT target, n, CASE WHEN n > 0 THEN CAST(hits AS DOUBLE) / n END AS share FROM (SELECT 'intent' AS target, count(*) AS n, count(*) FILTER (intent = intent2) AS hits FROM r UNION ALL SELECT 'variables', count(*), count(*) FILTER (vars) FROM r UNION ALL SELECT 'locations', count(*), count(*) FILTER (spans) FROM r "
    "UNION ALL SELECT 'activity', count(*) FILTER (intent = 'ADVICE'), count(*) FILTER (intent = 'ADVICE' AND act) FROM r UNION ALL SELECT 'everything', count(*), count(*) FILTER (intent = intent2 AND vars AND spans AND (intent <> 'ADVICE' OR act)) FROM r)",
)
def _(spark, d):
    rows = table(spark, d, "labels").selectExpr(
        "CASE WHEN quality = 1 THEN 'ADVICE' ELSE 'OTHER' END AS intent", "CASE WHEN doc_id % 7 = 0 THEN 'OTHER' WHEN quality = 1 THEN 'ADVICE' ELSE 'OTHER' END AS intent2", "array('RAIN', 'WIND') AS variables", "CASE WHEN doc_id % 5 = 0 THEN array('RAIN') ELSE array('WIND', 'RAIN', 'RAIN') END AS variables2",
        "array('Guntur', 'Guntur', 'Agra') AS locations", "CASE WHEN doc_id % 3 = 0 THEN array('guntur', 'agra', 'agra') ELSE array('AGRA', 'guntur', 'guntur') END AS locations2", "'SPRAY' AS activity", "CASE WHEN toxic = 0 OR doc_id % 2 = 0 THEN 'SPRAY' ELSE 'SOW' END AS activity2",
    )
    return evaluate.target_shares(rows, [("intent", "intent2"), ("activity", "activity2")], [("variables", "variables2")], [("locations", "locations2")], {"activity": F.col("intent") == "ADVICE"})


@query("name_misspellings")
def _(spark, d):
    return spread(table(spark, d, "part").select("p_partkey", "p_name")).select("p_partkey", "p_name", noise.misspellings(F.col("p_name"), F.col("p_partkey")).alias("misspelt"))


@query(
    "invented_weather",
    "WITH s AS (SELECT p_partkey AS id, lower('It is ' || CASE p_partkey % 5 WHEN 0 THEN 'sunny' WHEN 1 THEN 'a ' || p_name WHEN 2 THEN 'raining 4.5 mm' WHEN 3 THEN 'cold' ELSE 'at ' || CAST(p_size AS VARCHAR) END) AS said, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ' rain 4.5 mm' WHEN 1 THEN ' cold ' || CAST(p_size AS VARCHAR) ELSE '' END) AS given FROM part) "
    "SELECT id, len(list_filter([" + ", ".join(f"'{w}'" for w in audit.WEATHER_WORDS) + "], lambda w: contains(said, w) AND NOT contains(given, w))) > 0 OR len(list_filter(regexp_extract_all(said, '\\d+(?:\\.\\d+)?'), lambda n: NOT list_contains(regexp_extract_all(given, '\\d+(?:\\.\\d+)?'), n))) > 0 AS invented FROM s",
)
def _(spark, d):
    said = table(spark, d, "part").selectExpr("p_partkey AS id", "'It is ' || CASE p_partkey % 5 WHEN 0 THEN 'sunny' WHEN 1 THEN 'a ' || p_name WHEN 2 THEN 'raining 4.5 mm' WHEN 3 THEN 'cold' ELSE 'at ' || CAST(p_size AS STRING) END AS said", "p_name || CASE p_partkey % 3 WHEN 0 THEN ' rain 4.5 mm' WHEN 1 THEN ' cold ' || CAST(p_size AS STRING) ELSE '' END AS given")
    return said.select("id", audit.invented(F.col("said"), F.col("given")).alias("invented"))


@query("cleaned_replies", r"SELECT conv_id, turn, substr(trim(t), 1, 600) AS cleaned, trim(coalesce(nullif(regexp_extract(trim(t), '(?s)^(.*?[?.!])', 1), ''), trim(t))) AS first FROM (SELECT conv_id, turn, text AS t FROM conversations)")
def _(spark, d):
    wrapped = F.concat(F.lit("<think>never\nmind</think>```json"), F.col("text"), F.lit("```"))
    return table(spark, d, "conversations").select("conv_id", "turn", audit.cleaned(wrapped).alias("cleaned"), audit.first_sentence(F.col("text")).alias("first"))
