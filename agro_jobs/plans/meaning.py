"""Queries over what a question means: its days, its statistic, its activity and the detail it wants; the SQL works each rule out from the text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from agro_jobs.functions import activity as A
from agro_jobs.functions import text as X
from agro_jobs.functions import timex
from agro_jobs.functions.dims import FULL_FIELDS, MINIMAL_FIELDS, VARIABLE_FIELDS
from agro_jobs.operators import asked
from agro_jobs.plans.registry import query
from agro_jobs.plans.texts import AS_OF
from agro_jobs.plans.views import table
from agro_jobs.sources.shared import once_each


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def pick_of(items, key: str) -> str:
    """SQL for both engines: one of the items by a key."""
    return "CASE " + " ".join(f"WHEN ({key}) % {len(items)} = {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


# ---------------------------------------------------------------- days

MONTH_WORDS = tuple(timex.MONTH_OF)
DATE = "CAST(CAST(ts AS DATE) AS VARCHAR)"
YEARS = "CAST(1995 + event_id * 7 % 34 AS VARCHAR)"
SAID = (
    f"CASE event_id % 13 WHEN 0 THEN 'in ' || {pick_of(MONTH_WORDS, 'event_id // 13')} WHEN 1 THEN {pick_of(MONTH_WORDS, 'event_id // 13')} || ' ' || {YEARS} WHEN 2 THEN 'rain may fall in ' || {pick_of(MONTH_WORDS, 'event_id // 13')} "
    f"WHEN 3 THEN 'from ' || {YEARS} || ' to 2009 and 1999' WHEN 4 THEN 'how much may it rain' WHEN 5 THEN 'for all of ' || {YEARS} WHEN 6 THEN 'between ' || {DATE} || ' and 2024-02-30' WHEN 7 THEN ' ' WHEN 8 THEN 'the last decade' WHEN 9 THEN 'next ' || CAST(1 + event_id % 13 AS VARCHAR) || ' days' "
    f"WHEN 10 THEN {DATE} || ' or ' || CAST(CAST(ts AS DATE) + 3 AS VARCHAR) WHEN 11 THEN 'whats up ' || {pick_of(MONTH_WORDS, 'event_id // 13')} ELSE 'march on, ' || {YEARS} END"
)
NUMBER = "CASE {w} " + " ".join(f"WHEN '{w}' THEN {n}" for w, n in timex.MONTH_OF.items()) + " END"
WINDOWS = (
    f"WITH s AS (SELECT event_id, trim(lower({SAID})) AS t FROM events), d AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), lambda x: TRY_CAST(x AS DATE)), lambda x: x IS NOT NULL)) AS ds, regexp_extract(t, '((?:19|20)\\d{{2}})\\s*(?:to|-|and|until)\\s*((?:19|20)\\d{{2}})', ['a', 'b']) AS pair, "
    f"regexp_extract(t, '([a-z]+)\\s+((?:19|20)\\d{{2}})', ['w', 'y']) AS my, regexp_extract(t, '([a-z]+)\\s+((?:19|20)\\d{{2}})') AS my_said, regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1) AS y, "
    f"list_filter(regexp_extract_all(t, '[a-z]+'), lambda w: list_contains({sql_list(MONTH_WORDS)}, w) AND (w NOT IN ('may', 'march') OR regexp_matches(t, '\\b(?:last|in|of|during|for)\\s+' || w || '\\b')))[1] AS w FROM s), "
    f"e AS (SELECT *, {NUMBER.format(w='my.w')} AS m, {NUMBER.format(w='w')} AS n FROM d), "
    f"f AS (SELECT *, CASE WHEN m IS NOT NULL THEN make_date(TRY_CAST(my.y AS INT), m, 1) END AS first_m, CASE WHEN n IS NOT NULL THEN make_date(2024 - CASE WHEN n > 3 THEN 1 ELSE 0 END, n, 1) END AS first_n FROM e) "
    f"SELECT event_id, CASE WHEN t = '' OR t LIKE 'next %' THEN {AS_OF} WHEN len(ds) > 0 THEN list_min(ds) WHEN pair.a <> '' THEN make_date(TRY_CAST(least(pair.a, pair.b) AS INT), 1, 1) WHEN m IS NOT NULL THEN first_m WHEN contains(t, 'decade') THEN CAST({AS_OF} - 3653 AS DATE) WHEN y <> '' THEN make_date(TRY_CAST(y AS INT), 1, 1) WHEN w IS NOT NULL THEN first_n ELSE {AS_OF} END AS start, "
    f"CASE WHEN t = '' THEN CAST({AS_OF} + 6 AS DATE) WHEN t LIKE 'next %' THEN CAST({AS_OF} + TRY_CAST(regexp_extract(t, '\\d+') AS INT) - 1 AS DATE) WHEN len(ds) > 0 THEN list_max(ds) WHEN pair.a <> '' THEN make_date(TRY_CAST(greatest(pair.a, pair.b) AS INT), 12, 31) WHEN m IS NOT NULL THEN last_day(first_m) WHEN contains(t, 'decade') THEN {AS_OF} WHEN y <> '' THEN make_date(TRY_CAST(y AS INT), 12, 31) WHEN w IS NOT NULL THEN least(last_day(first_n), {AS_OF}) ELSE CAST({AS_OF} + 6 AS DATE) END AS stop, "
    "CASE WHEN t = '' THEN 'next few days' WHEN t LIKE 'next %' THEN t WHEN len(ds) > 0 THEN CASE WHEN list_min(ds) = list_max(ds) THEN strftime(list_min(ds), '%d %b %Y') ELSE strftime(list_min(ds), '%d %b') || ' to ' || strftime(list_max(ds), '%d %b %Y') END WHEN pair.a <> '' THEN least(pair.a, pair.b) || '-' || greatest(pair.a, pair.b) WHEN m IS NOT NULL THEN my_said WHEN contains(t, 'decade') THEN 'the last decade' WHEN y <> '' THEN y WHEN w IS NOT NULL THEN w || ' ' || CAST(year(first_n) AS VARCHAR) ELSE t END AS label, "
    "t = '' OR t LIKE 'next %' OR len(ds) > 0 OR pair.a <> '' OR m IS NOT NULL OR contains(t, 'decade') OR y <> '' OR w IS NOT NULL AS understood FROM f"
)


@query("resolve_said", WINDOWS)
def _(spark, d):
    said = table(spark, d, "events").selectExpr("event_id", f"{SAID.replace('VARCHAR', 'STRING').replace('//', 'DIV')} AS t")
    w = timex.window(F.col("t"), F.expr(AS_OF))
    return said.select("event_id", w.alias("w")).select("event_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "w.label", "w.understood")


@query("rows_for_grains", "SELECT event_id, grain, greatest(CAST(floor(n * rate) AS BIGINT), 1) AS n FROM (SELECT event_id, 1 + event_id % 4000 AS n FROM events) CROSS JOIN (VALUES ('hourly', 24.0::DOUBLE), ('daily', 1.0::DOUBLE), ('weekly', 1.0::DOUBLE / 7), ('monthly', 1.0::DOUBLE / 30.4::DOUBLE), ('yearly', 1.0::DOUBLE / 365.25::DOUBLE)) g(grain, rate)")
def _(spark, d):
    grains = ("hourly", "daily", "weekly", "monthly", "yearly")
    days = 1 + F.col("event_id") % 4000
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), timex.rows_for(days, g).cast("long").alias("n")) for g in grains])).alias("e")
    return table(spark, d, "events").select("event_id", each).select("event_id", "e.grain", "e.n")


# ---------------------------------------------------------------- statistics

PHRASES = tuple(dict.fromkeys([w for ws in asked.CUES.values() for w in ws] + [w for ws in asked.PROMOTES.values() for w in ws] + ["summarize", "minimal", "mostlyness", "weather"]))
KINDS = ("RAW", *asked.CUES)


def _says(words, text: str) -> str:
    return f"regexp_matches({text}, '(^|\\W)(" + "|".join(re.escape(w).replace("\\ ", " ") for w in words) + ")(\\W|$)')"


@query(
    "confirmed_statistic",
    f"WITH q AS (SELECT o_orderkey AS id, lower('Show ' || {pick_of(PHRASES, 'o_orderkey // 7')} || ' of it, please') AS t, {pick_of(KINDS, 'o_orderkey')} AS predicted FROM orders) SELECT id, CASE predicted WHEN 'RAW' THEN CASE "
    + " ".join(f"WHEN {_says(ws, 't')} THEN '{k}'" for k, ws in asked.PROMOTES.items()) + " ELSE 'RAW' END "
    + " ".join(f"WHEN '{k}' THEN CASE WHEN {_says(ws, 't')} THEN '{k}' ELSE 'RAW' END" for k, ws in asked.CUES.items()) + " END AS statistic FROM q",
)
def _(spark, d):
    said = table(spark, d, "orders").selectExpr("o_orderkey AS id", f"'Show ' || {pick_of(PHRASES, 'o_orderkey DIV 7')} || ' of it, please' AS t", f"{pick_of(KINDS, 'o_orderkey')} AS predicted")
    return said.select("id", asked.spoken_statistic(F.col("t"), F.col("predicted")).alias("statistic"))


# ---------------------------------------------------------------- activities

ACTIVITIES = tuple(A.GROUP)
EXTRAS = ("", "by scooter", "play badminton indoors", "wash the car", "dry the sarees at home", "a wedding on open ground", "go for a jog", "mow the lawn", "capital", "take a hat", "two wheeler or bus", "cricket in the open", "laundry on the terrace")
WANTED = f"p_name || ' ' || {pick_of(EXTRAS, 'p_partkey')}"
TYPE_OF = {t: k for k, ts in X.ENTITIES.items() for t in ts}


def _first(kind: str) -> str:
    """SQL: the longest term of a kind in t, then the one that comes first."""
    terms = sql_list(X.ENTITIES[kind])
    return f"list_sort(list_transform(list_filter({terms}, lambda w: regexp_matches(t, '\\b' || w || '\\b')), lambda w: struct_pack(n := -len(w), pos := instr(t, w), w := w)))[1].w"


def _fold(term: str) -> str:
    return f"CASE {term} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in A.SYNONYMS.items()) + f" ELSE {term} END"


def _said_word(words: dict[str, str]) -> str:
    ranked = sorted(words, key=len, reverse=True)
    return "CASE " + " ".join(f"WHEN regexp_matches(t, '\\b{w}\\b') THEN '{words[w]}'" for w in ranked) + " END"


@query(
    "sub_activities",
    f"WITH q AS (SELECT p_partkey, lower({WANTED}) AS t, {pick_of(ACTIVITIES, 'p_partkey // 13')} AS activity FROM part), e AS (SELECT *, {_first('transport')} AS ride, {_first('clothing')} AS wear, {_first('sport')} AS sport, {_first('event')} AS event FROM q), "
    "s AS (SELECT *, CASE WHEN activity NOT IN (" + ", ".join(f"'{a}'" for a in A.DEFAULTS) + ") THEN '' WHEN activity = 'DRYING' AND ride IS NOT NULL THEN 'vehicle' WHEN activity = 'DRYING' AND wear IS NOT NULL THEN 'laundry' "
    f"WHEN activity = 'OUTDOOR_ACTIVITY' AND sport IS NOT NULL THEN {_fold('sport')} WHEN activity = 'OUTDOOR_ACTIVITY' AND event IS NOT NULL THEN {_fold('event')} WHEN ride IS NOT NULL THEN {_fold('ride')} WHEN wear IS NOT NULL THEN {_fold('wear')} ELSE coalesce({_said_word(A.KEYWORDS)}, CASE activity "
    + " ".join(f"WHEN '{a}' THEN '{x}'" for a, x in A.DEFAULTS.items()) + " END) END AS sub FROM e) "
    f"SELECT p_partkey, CASE activity {' '.join(f"WHEN '{a}' THEN '{g}'" for a, g in A.GROUP.items())} END AS grp, sub, coalesce({_said_word(A.VENUES)}, CASE WHEN activity = 'OUTDOOR_ACTIVITY' AND list_contains({sql_list(A.INDOOR_SPORTS)}, sub) THEN 'indoor' ELSE 'outdoor' END) AS venue FROM s",
)
def _(spark, d):
    q = table(spark, d, "part").selectExpr("p_partkey", f"{WANTED} AS t", f"{pick_of(ACTIVITIES, 'p_partkey DIV 13')} AS activity")
    sub = A.sub_activity(F.col("activity"), X.entities(F.col("t")), F.col("t"))
    q = once_each(once_each(q, ["t", "activity"], sub=sub), ["t", "activity", "sub"], grp=A.group(F.col("activity")), venue=A.venue(F.col("activity"), F.col("sub"), F.col("t")))
    return q.select("p_partkey", "grp", "sub", "venue")


CUED = ("", "in detail", "just the number", "give me an overview, just the gist", "briefly", "walk me through it", "one line")
VARIABLES = tuple(VARIABLE_FIELDS)


def _wide(v: str) -> str:
    def table_of(fields):
        return f"CASE {v} " + " ".join(f"WHEN '{k}' THEN {sql_list(fs)}" for k, fs in fields.items()) + " END"

    return f"CASE width WHEN 'FULL' THEN {table_of(FULL_FIELDS)} WHEN 'MINIMAL' THEN {table_of(MINIMAL_FIELDS)} ELSE {table_of(VARIABLE_FIELDS)} END"


@query(
    "detail_fields",
    f"WITH q AS (SELECT p_partkey AS id, lower(p_name || ' ' || {pick_of(CUED, 'p_partkey')}) AS t, {pick_of(VARIABLES, 'p_partkey // 7')} AS a, {pick_of(VARIABLES, 'p_partkey // 11')} AS b, {pick_of(VARIABLES, 'p_partkey // 3')} AS c FROM part), "
    f"w AS (SELECT *, CASE WHEN len(list_filter({sql_list(A.FULL_CUES)}, lambda x: contains(t, x))) > 0 THEN 'FULL' WHEN len(list_filter({sql_list(A.MINIMAL_CUES)}, lambda x: contains(t, x))) > 0 THEN 'MINIMAL' ELSE 'NORMAL' END AS width FROM q), "
    f"f AS (SELECT id, width, list_concat(list_concat({_wide('a')}, {_wide('b')}), {_wide('c')}) AS fs FROM w) SELECT id, width, array_to_string(list_transform(list_filter(range(1, len(fs) + 1), lambda i: list_position(fs, fs[i]) = i), lambda i: fs[i])[1:CASE WHEN width = 'FULL' THEN 20 ELSE 8 END], ',') AS fields FROM f",
)
def _(spark, d):
    q = table(spark, d, "part").selectExpr("p_partkey AS id", f"p_name || ' ' || {pick_of(CUED, 'p_partkey')} AS t", *[f"{pick_of(VARIABLES, f'p_partkey DIV {k}')} AS {c}" for c, k in (("a", 7), ("b", 11), ("c", 3))])
    q = q.select("id", F.array("a", "b", "c").alias("variables"), A.detail(F.col("t")).alias("width"))
    return asked.fields_for(q, detail=F.col("width")).join(q.select("id", "width"), "id").select("id", "width", F.array_join("fields", ",").alias("fields"))
