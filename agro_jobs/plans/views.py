"""The weather and question-log tables, derived from the tables at hand by expressions that two SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agro_jobs.functions import clean

FIELDS = ("Rainfall", "Tmax", "Tmin", "Tavg", "RH", "Wind_Speed", "Wind_Direction", "SunSD", "DayLength", "Lowcloud", "Soilm10", "Soilt10")

#: events -> readings: a measurement column each, with gaps and sentinels.
READINGS = {
    "place_id": "user_id",
    "ts": "ts",
    "event_id": "event_id",
    "Rainfall": "CASE WHEN event_id % 97 = 0 THEN CAST(-999 AS DOUBLE) WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 4 = 0 THEN CAST(event_id * 7 % 250 AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END",
    "Tmax": "CASE WHEN event_id % 89 = 0 THEN CAST(9999 AS DOUBLE) ELSE 20 + CAST(event_id * 13 % 250 AS DOUBLE) / 10 END",
    "Tmin": "5 + CAST(event_id * 11 % 200 AS DOUBLE) / 10",
    "Tavg": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 12 + CAST(event_id * 5 % 220 AS DOUBLE) / 10 END",
    "RH": "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN NULL ELSE 30 + CAST(event_id * 17 % 70 AS DOUBLE) END",
    "Wind_Speed": "CASE WHEN value > 200 THEN CAST(20 AS DOUBLE) ELSE value / 10 END",
    "Wind_Direction": "CAST(event_id * 37 % 360 AS DOUBLE)",
    "SunSD": "CAST(event_id * 3 % 11 AS DOUBLE) / 10",
    "DayLength": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END",
    "Lowcloud": "CAST(event_id % 10 AS DOUBLE) / 10",
    "Soilm10": "CAST(event_id * 19 % 45 AS DOUBLE) / 100",
    "Soilt10": "8 + CAST(event_id * 23 % 200 AS DOUBLE) / 10",
}
#: lineitem -> archive: a daily series of several years.
ARCHIVE = {
    "place_id": "l_suppkey",
    "day": "CAST(l_shipdate AS DATE)",
    "Rainfall": "l_quantity / 2",
    "Tmax": "20 + l_discount * 100",
    "Tmin": "10 + l_tax * 100",
    "Normal_Rainfall": "CAST(12 AS DOUBLE)",
}
#: conversations -> turns of the question log.
TURNS = {
    "id": "conv_id * 100 + turn",
    "chat_id": "conv_id",
    "session": "conv_id % 37",
    "turn": "turn",
    "text": "CASE WHEN turn % 4 = 0 THEN '[m' || CAST(conv_id % 3 AS STRING) || '] ' || text ELSE text END",
    "role": "role",
    "day": "date_add(DATE '2024-01-01', CAST(conv_id * 3 % 40 AS INT))",
    "intent": "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'ADVICE' WHEN (conv_id + turn) % 5 = 1 THEN 'FORECAST' WHEN (conv_id + turn) % 5 = 2 THEN 'HISTORY' WHEN (conv_id + turn) % 5 = 3 THEN 'GREETING' ELSE 'OUT_OF_SCOPE' END",
    "confidence": "CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE) / 100",
    "latency_ms": "20 + (conv_id * 7 + turn * 13) % 400",
    "outcome": "CASE WHEN (conv_id + turn * 3) % 7 = 0 THEN 'clarified' WHEN (conv_id + turn * 3) % 7 = 1 THEN 'uncertain' WHEN (conv_id + turn * 3) % 7 = 2 THEN 'failed' ELSE 'answered' END",
    "state": "CASE WHEN turn % 2 = 0 THEN 'state ' || CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) ELSE NULL END",
}
#: events -> feedback on those turns; several events may revise one turn's feedback.
FEEDBACK = {
    "id": "event_id",
    "turn_id": "user_id * 100 + event_id % 4",
    "ts": "ts",
    "kind": "CASE event_type WHEN 'view' THEN 'up' WHEN 'click' THEN 'down' WHEN 'signup' THEN 'correction' WHEN 'purchase' THEN 'choice' ELSE NULL END",
    "intent": "CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'ADVICE' ELSE 'FORECAST' END",
    "note": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'note ' || CAST(event_id AS STRING) END",
}
#: documents -> rows of a labelled corpus.
CORPUS = {
    "row_id": "doc_id",
    "text": "text",
    "split": "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'test' ELSE 'eval' END",
    "source": "source",
    "intent": "CASE WHEN doc_id % 4 = 0 THEN 'ADVICE' WHEN doc_id % 4 = 1 THEN 'FORECAST' WHEN doc_id % 4 = 2 THEN 'HISTORY' ELSE 'GREETING' END",
    "activity": "CASE WHEN doc_id % 3 = 0 THEN 'SPRAY' WHEN doc_id % 3 = 1 THEN 'TRAVEL' ELSE 'SOW' END",
    "paraphrase": "CASE WHEN doc_id % 6 = 0 THEN doc_id - doc_id % 12 ELSE NULL END",
}
#: labels -> gold and predicted labels with a score.
GOLD = {
    "doc_id": "doc_id",
    "gold": "CASE WHEN quality = 1 AND toxic = 1 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 1 THEN 'C' ELSE 'D' END",
    "predicted": "CASE WHEN doc_id % 7 = 0 THEN 'B' WHEN doc_id % 11 = 0 THEN 'C' WHEN quality = 1 AND toxic = 1 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 1 THEN 'C' ELSE 'D' END",
    "gold2": "quality",
    "predicted2": "CASE WHEN doc_id % 13 = 0 THEN 1 - quality ELSE quality END",
    "score": "CAST(doc_id * 37 % 100 AS DOUBLE) / 100",
}
SOURCES = {"readings": ("events", READINGS), "archive": ("lineitem", ARCHIVE), "turns": ("conversations", TURNS), "feedback": ("events", FEEDBACK), "corpus": ("documents", CORPUS), "gold": ("labels", GOLD)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = SOURCES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaned(view(spark, sf_dir, "readings"), FIELDS)


def long_readings(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    return clean.long_form(clean_readings(spark, sf_dir), fields, ["place_id", "ts"])


def ansi(name: str) -> str:
    """The view as SQL for a CTE of the checking engine."""
    source, columns = SOURCES[name]
    body = ", ".join(f"{e} AS {c}" for c, e in columns.items()).replace("AS STRING", "AS VARCHAR").replace("date_add(DATE '2024-01-01', CAST(conv_id * 3 % 40 AS INT))", "CAST(DATE '2024-01-01' + CAST(conv_id * 3 % 40 AS INT) AS DATE)")
    return f"{name} AS (SELECT {body} FROM {source})"


CLEAN = "clean AS (SELECT place_id, ts, event_id, " + ", ".join(f"CASE WHEN isnan({f}) OR {f} IN (-999, -9999, 999, 9999) THEN NULL ELSE {f} END AS {f}" for f in FIELDS) + " FROM readings)"


def with_clean(body: str, *more: str) -> str:
    return f"WITH {', '.join([ansi('readings'), CLEAN, *more])} {body}"


def long_sql(*fields: str) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT place_id, ts, '{f}' AS field, {f} AS value FROM clean" for f in fields) + ")"
