"""Conversation folds, streams run to the end of their input, and models; checked by tests against batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agro_jobs.functions import text as X
from agro_jobs.operators import convo, ml
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import ansi, clean_readings, view, with_clean
from agro_jobs.sources.shared import shared, spread
from agro_jobs.streaming import jobs


def _as_stream(rows: DataFrame, at: str) -> DataFrame:
    """The rows as files that land, in Spark's own partitioning; they may be followed by more."""
    rows.write.mode("append").parquet(f"{at}/in")
    return rows.sparkSession.readStream.schema(rows.schema).parquet(f"{at}/in")


def _run(stream: DataFrame, at: str) -> DataFrame:
    """Run to the end of the input and read what was written."""
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


TURN = {
    "chat_id": "chat_id", "turn": "turn", "intent": "intent",
    "places": "CASE WHEN (chat_id + turn) % 3 = 0 THEN 'P' || CAST((chat_id + turn) % 11 AS STRING) END",
    "time": "CASE WHEN (chat_id * 2 + turn) % 4 = 0 THEN 'T' || CAST(turn AS STRING) END",
    "follow_up": "turn % 3 = 1", "compares": "(chat_id + turn) % 17 = 0", "silent": "turn % 2 = 1",
}


def slots(spark, d) -> DataFrame:
    return view(spark, d, "turns").withColumn("reference", X.reference(F.col("text"))).selectExpr(*[f"{e} AS {c}" for c, e in TURN.items()], "reference")


OPERATION = "CASE WHEN compares THEN 'COMPARE' WHEN f.k = 0 THEN 'SET' WHEN reference = 'LOCATION' AND p IS NULL THEN CASE WHEN t IS NULL THEN 'INHERIT' ELSE 'MODIFY' END WHEN follow_up AND (p IS NULL) <> (t IS NULL) THEN CASE WHEN p IS NULL THEN 'MODIFY' ELSE 'REPLACE' END WHEN p IS NOT NULL THEN CASE WHEN t IS NULL THEN 'REPLACE' ELSE 'SET' END WHEN t IS NOT NULL THEN 'MODIFY' ELSE 'INHERIT' END"
BACK = " OR ".join(f"contains(said, '{x}')" for x in X.PLACE_BACK)
#: The fold, turn after turn, as a recursion.
FOLD_SQL = (
    f"WITH RECURSIVE {ansi('turns')}, s AS (SELECT chat_id, turn, intent, CASE WHEN (chat_id + turn) % 3 = 0 THEN 'P' || CAST((chat_id + turn) % 11 AS VARCHAR) END AS p, CASE WHEN (chat_id * 2 + turn) % 4 = 0 THEN 'T' || CAST(turn AS VARCHAR) END AS t, turn % 3 = 1 AS follow_up, (chat_id + turn) % 17 = 0 AS compares, turn % 2 = 1 AS silent, "
    f"CASE WHEN {BACK} THEN 'LOCATION' ELSE 'NONE' END AS reference, row_number() OVER (PARTITION BY chat_id ORDER BY turn) AS k FROM (SELECT *, regexp_replace(lower(text), '\\s+', ' ', 'g') AS said FROM turns)), "
    "f AS (SELECT DISTINCT chat_id, 0::BIGINT AS k, 0::BIGINT AS turn, NULL::VARCHAR AS operation, NULL::VARCHAR AS intent, NULL::VARCHAR AS places, NULL::VARCHAR AS time FROM s UNION ALL "
    "SELECT chat_id, k, turn, op, CASE WHEN op IN ('MODIFY', 'REPLACE', 'INHERIT') AND old_intent IS NOT NULL AND silent THEN old_intent ELSE intent END, CASE WHEN p IS NOT NULL AND op IN ('SET', 'COMPARE', 'REPLACE') THEN p ELSE old_places END, "
    "CASE WHEN t IS NOT NULL AND op IN ('SET', 'COMPARE', 'MODIFY', 'INHERIT') THEN t WHEN op = 'SET' THEN NULL ELSE old_time END "
    f"FROM (SELECT s.*, f.intent AS old_intent, f.places AS old_places, f.time AS old_time, {OPERATION} AS op FROM f JOIN s ON s.chat_id = f.chat_id AND s.k = f.k + 1)) SELECT chat_id, turn, operation, intent, places, time FROM f WHERE k > 0"
)


@query("conversation_fold", FOLD_SQL)
def _(spark, d):
    return convo.fold(slots(spark, d))


@query("stream_conversation", FOLD_SQL)
def _(spark, d):
    at, backend = shared(spark), "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(backend)
    spark.conf.set(backend, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _run(jobs.conversation(_as_stream(slots(spark, d), at)), at)
    finally:
        spark.conf.set(backend, was)


@query("stream_alerts", with_clean("SELECT place_id, CAST(ts AS DATE) AS day, field, count(*) AS n FROM (SELECT place_id, ts, 'Rainfall' AS field FROM clean WHERE Rainfall >= 10 UNION ALL SELECT place_id, ts, 'Tmax' FROM clean WHERE Tmax >= 40 UNION ALL SELECT place_id, ts, 'Tmin' FROM clean WHERE Tmin <= 10 UNION ALL SELECT place_id, ts, 'Wind_Speed' FROM clean WHERE Wind_Speed >= 11 UNION ALL SELECT place_id, ts, 'RH' FROM clean WHERE RH >= 90) GROUP BY 1, 2, 3"))
def _(spark, d):
    at = shared(spark)
    out = _run(jobs.alerts(_as_stream(clean_readings(spark, d), at)), at)
    return out.groupBy("place_id", F.to_date("ts").alias("day"), "field").agg(F.count("*").alias("n"))


@query(
    "stream_daily_rain",
    with_clean("SELECT place_id, day, n, rain, peak, wet FROM (SELECT place_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(Rainfall AS DECIMAL(18,4))) AS DOUBLE) AS rain, max(Rainfall) AS peak, count(*) FILTER (Rainfall >= 0.2) AS wet FROM clean GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM clean) - INTERVAL 2 DAY"),
)
def _(spark, d):
    at = shared(spark)
    return _run(jobs.daily_rain(_as_stream(clean_readings(spark, d).select("place_id", "ts", "Rainfall"), at)), at)


FOLDED = (
    "SELECT turn_id, arg_min(id, struct_pack(t := ts, i := id)) AS id, min(ts) AS first_ts, max(ts) AS updated_at, count(*) - 1 AS revisions, arg_max(kind, struct_pack(t := ts, i := id)) AS kind, "
    "arg_max(intent, struct_pack(t := ts, i := id)) FILTER (intent IS NOT NULL) AS intent, arg_max(note, struct_pack(t := ts, i := id)) FILTER (note IS NOT NULL) AS note FROM feedback WHERE kind IS NOT NULL GROUP BY 1"
)


@query("stream_feedback", f"WITH {ansi('feedback')} {FOLDED}")
def _(spark, d):
    at = shared(spark)
    for half in (0, 1):  # as events would arrive on two days: the second run goes on where the first one ended
        stream = _as_stream(view(spark, d, "feedback").where(F.col("id") % 2 == half), at)
        stream.writeStream.foreachBatch(jobs.feedback_sink(f"{at}/table")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.feedback_state(spark, f"{at}/table")


@query("tfidf", f"WITH {ansi('corpus')}, w AS (SELECT row_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9:]+', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM corpus) SELECT row_id, CAST(len(w) + greatest(len(w) - 1, 0) AS INT) AS words, CAST(list_sum(list_transform(w, lambda x: greatest(len(x), 0) + greatest(len(x) - 1, 0) + greatest(len(x) - 2, 0))) AS INT) AS chars FROM w")
def _(spark, d):
    rows = view(spark, d, "corpus").select("row_id", "text")
    return ml.tfidf(rows)[1].select("row_id", F.col("n_words").alias("words"), F.col("n_chars").alias("chars"))


@query("heads_score")
def _(spark, d):
    rows = view(spark, d, "corpus").select("row_id", "text", "split", "activity")
    ready = ml.tfidf(rows, 1 << 10)[1].select("row_id", "split", "activity", "features")
    model = ml.head(ready.where("split = 'train'"), "activity")
    return model.transform(ready.where("split != 'train'").withColumn("weight", F.lit(1.0))).select("row_id", "activity", "activity_hat")


@query("span_tag")
def _(spark, d):
    rows = spread(view(spark, d, "corpus").select("row_id", "text")).select("row_id", "text", F.slice(F.split("text", " "), 2, 2).alias("spans"))
    return ml.decoded(ml.token_rows(rows, "row_id", "text", "spans"), "row_id")


SLIP = "CASE (p_partkey // 3) % 3 WHEN 0 THEN left(w, i) || substr(w, i + 2) WHEN 1 THEN left(w, i) || substr(w, i + 1, 1) || substr(w, i + 1) ELSE left(w, i) || substr(w, i + 2, 1) || substr(w, i + 1, 1) || substr(w, i + 3) END"


@query(
    "misspellings",
    "WITH a AS (SELECT p_partkey, p_name, regexp_extract_all(p_name, '[A-Za-z]{4,}') AS ws FROM part), b AS (SELECT *, ws[CAST(p_partkey % greatest(len(ws), 1) AS INT) + 1] AS w FROM a), c AS (SELECT *, CAST(1 + (p_partkey // 7) % (len(w) - 2) AS INT) AS i FROM b) "
    f"SELECT p_partkey, CASE WHEN len(ws) = 0 THEN p_name ELSE replace(p_name, w, {SLIP}) END AS misspelt FROM c",
)
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", X.misspelt(F.col("p_name"), F.col("p_partkey")).alias("misspelt"))
