"""Queries over the question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.operators import turns as T
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import ansi, view

CLEAN = r"trim(regexp_replace(trim(text), '^\[[^\]]*\]', ''))"
FOLD = (
    "fb AS (SELECT turn_id, arg_min(id, struct_pack(t := ts, i := id)) AS id, min(ts) AS first_ts, max(ts) AS updated_at, count(*) - 1 AS revisions, arg_max(kind, struct_pack(t := ts, i := id)) AS kind, "
    "arg_max(intent, struct_pack(t := ts, i := id)) FILTER (intent IS NOT NULL) AS intent, arg_max(note, struct_pack(t := ts, i := id)) FILTER (note IS NOT NULL) AS note FROM feedback WHERE kind IS NOT NULL GROUP BY 1)"
)


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([ansi('turns'), ansi('feedback'), FOLD, *more])} {body}"


def _turns(spark, d):
    return view(spark, d, "turns")


def _fb(spark, d):
    return T.folded(view(spark, d, "feedback"))


@query("feedback_fold", sql("SELECT turn_id, id, first_ts, updated_at, revisions, kind, intent, note FROM fb"))
def _(spark, d):
    return _fb(spark, d)


@query("chat_list", sql(f"SELECT chat_id, count(*) AS turns, min(id) AS first, max(id) AS last, count(*) FILTER (outcome = 'answered') AS answered, substr(arg_min({CLEAN}, id), 1, 80) AS title FROM turns GROUP BY 1 ORDER BY last DESC LIMIT 40"))
def _(spark, d):
    return T.chats(_turns(spark, d))


@query("last_state", sql("SELECT chat_id, arg_max(state, id) FILTER (state IS NOT NULL) AS state FROM turns GROUP BY 1 HAVING count(state) > 0"))
def _(spark, d):
    return T.last_state(_turns(spark, d))


@query("recent_exchanges", sql("SELECT chat_id, string_agg(text || ' > ' || coalesce(state, '-'), ' / ' ORDER BY id) AS exchanges FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) AS r FROM turns WHERE outcome = 'answered') WHERE r <= 3 GROUP BY 1"))
def _(spark, d):
    return T.recent(_turns(spark, d), answer="state").withColumn("exchanges", F.array_join(F.transform("exchanges", lambda e: F.concat(e.question, F.lit(" > "), F.coalesce(e.answer, F.lit("-")))), " / "))


@query("turn_stats", sql("SELECT outcome, count(*) AS turns, count(DISTINCT session) AS sessions, count(DISTINCT chat_id) AS chats, CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(confidence) AS confidence, CAST(sum(latency_ms) AS DOUBLE) / count(*) AS latency FROM turns GROUP BY ROLLUP (outcome)"))
def _(spark, d):
    return T.usage(_turns(spark, d))


PAIRS = "pairs AS (SELECT f.intent AS actual, t.intent AS predicted, count(*) AS n FROM fb f JOIN turns t ON t.id = f.turn_id WHERE f.kind IN ('choice', 'correction') AND f.intent IS NOT NULL GROUP BY 1, 2)"


@query("confusion_pairs", sql("SELECT * FROM (SELECT * FROM pairs ORDER BY n DESC, actual, predicted LIMIT 5) WHERE actual <> predicted", PAIRS))
def _(spark, d):
    return T.worst(T.confusion(_turns(spark, d), _fb(spark, d)))


@query("close_calls", sql("SELECT id, round(a - b, 6) AS margin FROM (SELECT id, list_sort([confidence, CAST(id * 7 % 100 AS DOUBLE) / 100, CAST(id * 13 % 100 AS DOUBLE) / 100], 'DESC') AS s, s[1] AS a, s[2] AS b FROM turns) WHERE a - b < 0.25 ORDER BY margin, id LIMIT 10"))
def _(spark, d):
    scores = F.create_map(F.lit("a"), F.col("confidence"), F.lit("b"), F.expr("CAST(id * 7 % 100 AS DOUBLE) / 100"), F.lit("c"), F.expr("CAST(id * 13 % 100 AS DOUBLE) / 100"))
    return T.close_calls(_turns(spark, d).withColumn("scores", scores))


@query(
    "labelled_rows",
    sql(f"SELECT text, coalesce(nullif(said, ''), intent) AS intent, kind AS source_kind FROM (SELECT {CLEAN} AS text, t.intent, f.intent AS said, f.kind, row_number() OVER (PARTITION BY lower({CLEAN}) ORDER BY f.id) AS r FROM fb f JOIN turns t ON t.id = f.turn_id WHERE f.kind IN ('choice', 'correction') OR (f.kind = 'up' AND t.confidence >= 0.9)) WHERE r = 1 AND text <> ''"),
)
def _(spark, d):
    return T.labelled(_turns(spark, d), _fb(spark, d), approved=True)


@query("review_queue", sql("SELECT t.id, text, confidence, CAST(coalesce(kind = 'down', false) AS INT) AS flagged FROM turns t LEFT JOIN fb f ON f.turn_id = t.id WHERE kind = 'down' OR (outcome IN ('uncertain', 'clarified') AND coalesce(kind NOT IN ('choice', 'correction', 'up'), true)) ORDER BY flagged DESC, confidence, t.id LIMIT 50"))
def _(spark, d):
    return T.review_queue(_turns(spark, d), _fb(spark, d))


@query("failed_turns", sql(f"SELECT t.id, {CLEAN} AS text, outcome, coalesce(note, CASE WHEN outcome = 'clarified' THEN 'no_place_named' ELSE outcome END) AS cause, f.intent AS corrected FROM turns t LEFT JOIN fb f ON f.turn_id = t.id WHERE outcome IN ('failed', 'clarified') OR kind IN ('down', 'correction') ORDER BY t.id DESC LIMIT 500"))
def _(spark, d):
    return T.failed(_turns(spark, d), _fb(spark, d))


@query("export_active_days", sql(rf"SELECT t.id, day, {CLEAN} AS text, coalesce(nullif(regexp_extract(trim(text), '^\[([^\]]*)\]', 1), ''), 'legacy') AS model, kind AS fb_kind, f.intent AS fb_intent FROM turns t LEFT JOIN fb f ON f.turn_id = t.id WHERE day IN (SELECT DISTINCT day FROM turns ORDER BY day DESC LIMIT 7)"))
def _(spark, d):
    return T.active_days(_turns(spark, d), _fb(spark, d))


@query("collapse_retries", sql(f"SELECT max(id) AS id, array_to_string(list_sort(list(id))[:-2], ',') AS retry_of FROM (SELECT id, chat_id, turn % 3 AS turn, lower({CLEAN}) AS said FROM turns) GROUP BY chat_id, turn, said"))
def _(spark, d):
    return T.without_retries(_turns(spark, d).withColumn("turn", F.col("turn") % 3))


@query("unique_questions", sql(f"SELECT lower({CLEAN}) AS said, max(id) AS id, count(*) AS times, min(id) AS first, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM turns GROUP BY 1"))
def _(spark, d):
    return T.unique_questions(_turns(spark, d))


@query("feedback_kinds", sql("SELECT kind, count(*) AS n FROM fb GROUP BY 1"))
def _(spark, d):
    return T.feedback_kinds(_fb(spark, d))


@query("turn_outcome", sql("SELECT id, CASE WHEN intent IN ('ADVICE', 'FORECAST', 'HISTORY') THEN 'data' WHEN intent = 'GREETING' THEN 'conversational' WHEN intent = 'OUT_OF_SCOPE' THEN 'declined' ELSE 'control' END AS family, CASE WHEN confidence < 0.45 THEN 'too thin' WHEN confidence < 0.95 THEN 'uncertain' ELSE 'certain' END AS certainty FROM turns"))
def _(spark, d):
    return T.outcomes(_turns(spark, d))


@query("chat_sizes", sql("SELECT chat_id, count(*) AS turns FROM turns GROUP BY 1 HAVING count(*) > 1"))
def _(spark, d):
    return _turns(spark, d).groupBy("chat_id").agg(F.count("*").alias("turns")).where("turns > 1")
