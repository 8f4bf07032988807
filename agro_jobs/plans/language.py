"""Queries over words and spans: where they stand, what they nearly are, rows made from frames, gates, taggers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agro_jobs.functions import activity as A
from agro_jobs.functions import text as X
from agro_jobs.functions import timewords, timex
from agro_jobs.operators import convo, gates, generate, marks, ml, nearwords, noise, spans
from agro_jobs.plans.more import picked
from agro_jobs.plans.moving import BACK, OPERATION, TURN, _as_stream, _run
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import ansi, table, view
from agro_jobs.sources.shared import shared, spread
from agro_jobs.streaming import jobs

# ---------------------------------------------------------------- tokens and terms


def located_sql(source: str, keys: str, pattern: str) -> str:
    """CTEs `cut` and `located`: tokens of source's text with offsets."""
    return (
        f"cut AS (SELECT {keys}, unnest(w) AS token, unnest(g[1:len(w)]) AS gap, unnest(range(0, len(w))) AS pos FROM (SELECT {keys}, regexp_extract_all(text, '{pattern}') AS w, regexp_split_to_array(text, '{pattern}') AS g FROM {source})), "
        f"located AS (SELECT {keys}, CAST(pos AS INT) AS pos, token, gap, CAST(sum(len(gap) + len(token)) OVER (PARTITION BY {keys} ORDER BY pos) - len(token) AS INT) AS start, CAST(sum(len(gap) + len(token)) OVER (PARTITION BY {keys} ORDER BY pos) AS INT) AS stop FROM cut)"
    )


@query("token_offsets", f"WITH {located_sql('conversations', 'conv_id, turn', marks.TOKEN)} SELECT conv_id, turn, pos, token, start, stop FROM located")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return marks.located(rows, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "token", "start", F.col("end").alias("stop"))


#: The commonest words and pairs of words of the documents, as a vocabulary with terms that overlap.
TERMS = (
    "one AS (SELECT lower(token) AS term FROM located WHERE len(token) >= 4), two AS (SELECT lower(token) || ' ' || lower(lead(token) OVER w) AS term, lead(gap) OVER w = ' ' AS whole FROM located WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "counted AS (SELECT term, count(*) AS n FROM one GROUP BY 1), paired AS (SELECT term, count(*) AS n FROM two WHERE whole GROUP BY 1), "
    "ranked AS (SELECT * FROM (SELECT term, n FROM counted ORDER BY n DESC, term LIMIT 150) UNION ALL SELECT * FROM (SELECT term, n FROM paired ORDER BY n DESC, term LIMIT 150)), "
    "terms AS (SELECT term, 'kind ' || CAST(len(term) % 3 AS VARCHAR) AS type, row_number() OVER (ORDER BY n DESC, term) AS no FROM ranked)"
)
#: Longest first over the whole text: round after round, a match is taken once no earlier one that it overlaps is undecided, and out once such a one is taken.
GREEDY = (
    "m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(term) DESC, no, start) AS rk FROM (SELECT doc_id, start, stop, term, type, no FROM located JOIN terms ON lower(token) = term "
    "UNION ALL SELECT doc_id, start, stop2, term, type, no FROM (SELECT doc_id, start, lower(token) || ' ' || lower(lead(token) OVER w) AS pair, lead(stop) OVER w AS stop2, lead(gap) OVER w = ' ' AS whole FROM located WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) JOIN terms ON whole AND pair = term)), "
    "c AS (SELECT a.doc_id, a.rk, b.rk AS before FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.rk < a.rk AND a.start < b.stop AND b.start < a.stop), "
    "met AS (SELECT doc_id, rk FROM c UNION SELECT doc_id, before FROM c), g AS (SELECT 0 AS it, doc_id, rk, 0 AS s FROM met UNION ALL SELECT x.it + 1, x.doc_id, x.rk, CASE WHEN x.s <> 0 THEN x.s WHEN coalesce(max(CAST(p.s = 1 AS INT)), 0) = 1 THEN 2 WHEN coalesce(max(CAST(p.s = 0 AS INT)), 0) = 1 THEN 0 ELSE 1 END FROM g x LEFT JOIN c ON c.doc_id = x.doc_id AND c.rk = x.rk LEFT JOIN g p ON p.doc_id = c.doc_id AND p.rk = c.before WHERE EXISTS (SELECT 1 FROM g WHERE s = 0) GROUP BY x.it, x.doc_id, x.rk, x.s), "
    "kept AS (SELECT * FROM m ANTI JOIN met USING (doc_id, rk) UNION ALL SELECT m.* FROM m JOIN g USING (doc_id, rk) WHERE s = 1 AND it = (SELECT max(it) FROM g)), spans AS (SELECT doc_id, type, substr(text, start + 1, stop - start) AS span, min(rk) AS rk FROM kept JOIN documents USING (doc_id) GROUP BY ALL)"
)


def common_terms(docs, n=150):
    """term, type, no: the commonest words of at least four letters and the commonest pairs of words."""
    runs = marks.word_runs(docs, [], "text", 2).select((F.col("end") - F.col("start")).alias("kind"), F.lower("span").alias("term"))
    both = marks.commonest(runs.where((F.col("kind") == 2) | (F.char_length("term") >= 4)), n)  # a few hundred terms
    return both.select("term", F.concat(F.lit("kind "), (F.char_length("term") % 3).cast("string")).alias("type"), F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("no"))


@query("entity_spans", f"WITH RECURSIVE {located_sql('documents', 'doc_id', marks.WORD)}, {TERMS}, {GREEDY} SELECT doc_id, type, string_agg(span, '|' ORDER BY rk) AS spans, count(*) AS n FROM spans GROUP BY 1, 2")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = marks.entities(docs, common_terms(spread(docs)), ["doc_id"])
    return found.select("doc_id", "type", F.array_join("spans", "|").alias("spans"), F.size("spans").cast("long").alias("n"))


@query("misspelt_words")
def _(spark, d):
    def words(rows):
        return rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("word"))

    known = words(table(spark, d, "documents")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(60).select(F.col("word").alias("known"))
    return nearwords.misspelt_words(words(table(spark, d, "conversations")).distinct(), known)


# ---------------------------------------------------------------- rows from frames

FRAMES = (
    ("i1", "what is the {v} in {place} {time}?", "INFORMATION", "NONE"), ("i2", "{place} {v} {time}", "INFORMATION", "NONE"), ("i3", "will the {v} change for {place} {time}", "INFORMATION", "NONE"),
    ("c1", "compare {v} in {place} and {place2} {time}", "COMPARISON", "NONE"), ("c2", "{v} {time}: {place} or {place2}?", "COMPARISON", "NONE"),
    ("a1", "can i spray {material} on {crop} in {place} {time}", "ADVICE", "SPRAY"), ("a2", "is {time} fine for {material} at {place}", "ADVICE", "SPRAY"), ("a3", "my {crop} near {place}, should it wait {time}?", "ADVICE", "SPRAY"),
    ("t1", "is it fine to take the {transport} to {place} {time}?", "ADVICE", "TRAVEL"), ("t2", "{transport} from {place} to {place2} {time}", "ADVICE", "TRAVEL"), ("t3", "we leave {place} {time} with {material}, okay?", "ADVICE", "TRAVEL"),
    ("g1", "hello, anyone in {place}?", "GREETING", "NONE"), ("g2", "thanks a lot", "THANKS", "NONE"),
)
TIMES = ("today", "tomorrow", "next week", "3 pm", "yesterday", "last week")
WINDOW = {"today": "CURRENT", "3 pm": "CURRENT", "tomorrow": "FORECAST", "next week": "FORECAST", "yesterday": "HISTORICAL", "last week": "HISTORICAL"}
WORDS = {"v": ("weather", "rain", "temperature", "humidity", "wind"), "time": TIMES, "crop": X.ENTITIES["crop"][:6], "material": X.ENTITIES["material"][:6], "transport": X.ENTITIES["transport"][:6]}
ENTITY_SLOTS, NO_DATA, GROUPS = ("crop", "material", "transport"), ("GREETING", "THANKS"), {"NONE": "NONE", "SPRAY": "FARMING", "TRAVEL": "OUTDOOR"}


def phrased(spark, d):
    frames = spark.createDataFrame(FRAMES, "frame string, template string, intent string, activity string")
    places = table(spark, d, "nation").select(F.initcap("n_name").alias("place")).distinct()
    return generate.phrased(view(spark, d, "corpus").select("row_id"), frames, places, WORDS)


def _frames(frames, name="frames") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY frame) - 1 AS pos FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in f) + ")" for f in frames) + ") v(frame, template, intent, activity))"


def _word(slot: str, words) -> str:
    said = f"(CAST('0x' || left(md5('0:' || CAST(row_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR) || ':{slot}'), 8) AS BIGINT) % {len(words)})"
    return f"WHEN s = '{slot}' THEN ([{', '.join(repr(w) for w in words)}])[CAST({said} AS INT) + 1]"


NATIONS = "spots AS (SELECT place, row_number() OVER (ORDER BY place) - 1 AS pos FROM (SELECT DISTINCT upper(n_name[1]) || lower(substr(n_name, 2)) AS place FROM nation))"
MANY = "(SELECT count(*) FROM spots)"
#: Every row with its slots' values, one row a slot.
FILLED = (
    f"{ansi('corpus')}, {_frames(FRAMES)}, {NATIONS}, r AS (SELECT row_id, frame, template, intent, activity, a.place AS p1, b.place AS p2, regexp_split_to_array(template, '\\{{[a-z0-9_]+\\}}') AS lit, regexp_extract_all(template, '\\{{([a-z0-9_]+)\\}}', 1) AS slots FROM (SELECT row_id FROM corpus) corpus JOIN frames ON frames.pos = {picked(len(FRAMES), 'row_id', 0)} JOIN spots a ON a.pos = {picked(MANY, 'row_id', 1)} JOIN spots b ON b.pos = {picked(MANY, 'row_id', 2)}), "
    f"v AS (SELECT row_id, i, s, CASE WHEN s = 'place' THEN p1 WHEN s = 'place2' THEN p2 {' '.join(_word(k, w) for k, w in WORDS.items())} END AS span, lit FROM (SELECT row_id, p1, p2, lit, unnest(slots) AS s, unnest(range(1, len(slots) + 1)) AS i FROM r)), "
    "spot AS (SELECT row_id, i, s, span, CAST(list_sum(list_transform(lit[1:i], lambda x: len(x))) + coalesce(sum(len(span)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start, span || lit[i + 1] AS part FROM v), "
    "made AS (SELECT r.row_id, frame, intent, activity, any_value(r.lit)[1] || coalesce(string_agg(part, '' ORDER BY i), '') AS text, coalesce(string_agg(s || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + len(span) AS VARCHAR), ',' ORDER BY i), '') AS marks FROM r LEFT JOIN spot ON spot.row_id = r.row_id GROUP BY r.row_id, frame, intent, activity)"
)


@query("phrased_rows", f"WITH {FILLED} SELECT row_id, frame, intent, activity, text, marks FROM made")
def _(spark, d):
    said = F.transform("marks", lambda m: F.concat_ws(":", m["slot"], m["start"].cast("string"), m["end"].cast("string")))
    return phrased(spark, d).select("row_id", "frame", "intent", "activity", "text", F.array_join(said, ",").alias("marks"))


FOLLOW = (("f1", "what about {place}?", "REPLACE"), ("f2", "and {place}", "REPLACE"), ("f3", "what about {time}?", "MODIFY"), ("f4", "{time} then", "MODIFY"), ("f5", "is that sure?", "INHERIT"))
LATER = "CAST('0x' || left(md5('{seed}:' || key{more}), 8) AS BIGINT)"


@query(
    "told_chats",
    f"WITH {FILLED}, f AS (SELECT *, row_number() OVER (ORDER BY frame) - 1 AS pos FROM (VALUES {', '.join(str(x) for x in FOLLOW)}) v(frame, template, operation)), "
    "o AS (SELECT row_id AS chat_id, 0 AS turn, text, 'SET' AS operation, (SELECT min_by(span, i) FROM spot WHERE spot.row_id = made.row_id AND starts_with(s, 'place')) AS place, (SELECT min_by(span, i) FROM spot WHERE spot.row_id = made.row_id AND s = 'time') AS time FROM made), "
    f"t AS (SELECT row_id AS chat_id, unnest(range(1, CAST(2 + {picked(3, 'row_id', 50)} AS INT))) AS turn FROM corpus), k AS (SELECT *, CAST(chat_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS key FROM t), "
    f"l AS (SELECT chat_id, turn, template, operation, CASE WHEN operation = 'REPLACE' THEN spots.place END AS place, CASE WHEN operation = 'MODIFY' THEN ([{', '.join(repr(w) for w in TIMES)}])[CAST({LATER.format(seed=60, more=' || chr(58) || chr(48) || chr(58) || ' + repr('time'))} % {len(TIMES)} AS INT) + 1] END AS time "
    f"FROM k JOIN f ON f.pos = {LATER.format(seed=60, more='')} % {len(FOLLOW)} JOIN spots ON spots.pos = {LATER.format(seed=61, more='')} % {MANY}), "
    "u AS (SELECT chat_id, CAST(turn AS INT) AS turn, text, operation, place, time FROM o UNION ALL SELECT chat_id, CAST(turn AS INT), replace(replace(template, '{place}', coalesce(place, '')), '{time}', coalesce(time, '')), operation, place, time FROM l) "
    "SELECT *, last_value(place IGNORE NULLS) OVER w AS ctx_place, last_value(time IGNORE NULLS) OVER w AS ctx_time FROM u WINDOW w AS (PARTITION BY chat_id ORDER BY turn ROWS UNBOUNDED PRECEDING)",
)
def _(spark, d):
    follow = spark.createDataFrame(FOLLOW, "frame string, template string, operation string")
    places = table(spark, d, "nation").select(F.initcap("n_name").alias("place")).distinct()
    return generate.conversations(phrased(spark, d), follow, places, TIMES)


def corpus_rows(spark, d):
    """Phrased rows as a labelled corpus."""
    rows = phrased(spark, d)
    window = F.create_map(*[F.lit(x) for kv in WINDOW.items() for x in kv])
    times, none = generate.spans_of("marks", "time"), F.col("intent").isin(*NO_DATA)
    entities = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), generate.spans_of("marks", k).alias("v")) for k in ENTITY_SLOTS]), lambda e: F.size(e["v"]) > 0))
    return rows.select(
        "row_id", "text", F.when(F.col("row_id") % 10 < 7, "train").when(F.col("row_id") % 10 < 9, "test").otherwise("eval").alias("split"), "intent", F.when(none, "NONE").otherwise(window[F.get(times, F.lit(0))]).alias("window"), "activity",
        F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])[F.col("activity")].alias("action"), F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.coalesce(F.get(generate.spans_of("marks", "v"), F.lit(0)), F.lit("general")))).alias("variables"),
        generate.spans_of("marks", "place").alias("locations"), times.alias("times"), entities.alias("entities"), F.when(F.col("row_id") % 25 < 2, F.floor(F.col("row_id") / 25).cast("long")).alias("paraphrase"), "marks",
    )


@query("gate_report")
def _(spark, d):
    rows = corpus_rows(spark, d)
    cues = spark.createDataFrame([("SPRAY", "spray"), ("TRAVEL", "trip")], "activity string, cue string")
    return gates.report(rows, marks.vocabulary(spark, X.ENTITIES), cues, GROUPS, NO_DATA)


@query(
    "edge_cases",
    f"WITH {FILLED}, s AS (SELECT row_id, count(*) FILTER (starts_with(s, 'place')) AS places, count(*) FILTER (s = 'time') AS times, count(*) FILTER (s = 'time' AND span = '3 pm') AS clocks FROM spot GROUP BY 1), n AS (SELECT count(*) FILTER (places > 1) AS multi, count(*) FILTER (clocks > 0) AS clock, (SELECT count(*) FROM made) - count(*) FILTER (places + times > 0) AS none FROM s) "
    "SELECT edge, n, n >= 5 AS enough FROM (SELECT 'multi-location' AS edge, multi AS n FROM n UNION ALL SELECT 'clock time', clock FROM n UNION ALL SELECT 'no entities', none FROM n UNION ALL SELECT 'address form', 0 UNION ALL SELECT 'two time spans', 0)",
)
def _(spark, d):
    return gates.edge_cases(corpus_rows(spark, d))


@query(
    "cell_balance",
    f"WITH {FILLED}, cells AS (SELECT a.intent, b.activity, count(made.row_id) AS n FROM (SELECT unnest(['INFORMATION', 'COMPARISON', 'ADVICE']) AS intent) a CROSS JOIN (SELECT unnest(['NONE', 'SPRAY', 'TRAVEL']) AS activity) b LEFT JOIN made ON made.intent = a.intent AND made.activity = b.activity GROUP BY 1, 2) SELECT *, n > 0 AND n >= 0.8 * max(n) OVER () AS passed FROM cells",
)
def _(spark, d):
    return gates.cell_balance(corpus_rows(spark, d), "intent", ["INFORMATION", "COMPARISON", "ADVICE"], "activity", ["NONE", "SPRAY", "TRAVEL"])


@query(
    "vocabulary_use",
    f"WITH {FILLED}, vo AS (" + " UNION ALL ".join(f"SELECT '{k}' AS type, unnest([{', '.join(repr(t) for t in ts)}]) AS term" for k, ts in X.ENTITIES.items()) + "), n AS (SELECT type, term, sum(len(regexp_extract_all(lower(text), '\\b' || term || '\\b'))) AS n FROM vo CROSS JOIN made GROUP BY 1, 2) SELECT type, term, CAST(n AS BIGINT) AS n, n = 0 AS unused FROM n",
)
def _(spark, d):
    return gates.vocabulary_use(phrased(spark, d), marks.vocabulary(spark, X.ENTITIES), ["row_id"])


CUES = {"spray": "SPRAY", "take the": "TRAVEL", "leave": "TRAVEL", "wait": "SPRAY", "fine to take": "OUTDOOR_ACTIVITY"}


@query(
    "activity_cues",
    f"WITH {FILLED} SELECT row_id, CASE WHEN frame = 'a1' THEN activity WHEN contains(lower(text), 'fine to take') THEN 'OUTDOOR_ACTIVITY' WHEN contains(lower(text), 'take the') THEN 'TRAVEL' WHEN contains(lower(text), 'spray') THEN 'SPRAY' WHEN contains(lower(text), 'leave') THEN 'TRAVEL' WHEN contains(lower(text), 'wait') THEN 'SPRAY' END AS activity FROM made",
)
def _(spark, d):
    return phrased(spark, d).select("row_id", spans.activity_of(F.col("text"), CUES, F.when(F.col("frame") == "a1", F.col("activity"))).alias("activity"))


PAYLOAD = "'{\"intent\": \"' || CASE p_partkey % 3 WHEN 0 THEN 'ADVICE' WHEN 1 THEN 'NONSENSE' ELSE 'HISTORY' END || '\", \"variables\": [\"RAIN\", \"' || p_brand || '\"], \"places\": [\"' || p_name || '\", \"' || p_type || '\"]}'"


@query(
    "coerced_payloads",
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ADVICE' WHEN 1 THEN 'FORECAST' ELSE 'HISTORY' END AS intent, CASE WHEN p_brand = 'Brand#7' THEN 'RAIN,Brand#7' ELSE 'RAIN' END AS variables, array_to_string(list_filter([p_name, p_type], lambda x: contains(lower('rain at ' || upper(p_name)), lower(x))), ',') AS places FROM part",
)
def _(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{PAYLOAD} AS payload", "'rain at ' || upper(p_name) AS text")
    got = rows.select("p_partkey", spans.coerced(F.col("payload"), F.col("text"), ("FORECAST", "ADVICE", "HISTORY"), ("RAIN", "Brand#7")).alias("c"))
    return got.select("p_partkey", "c.intent", F.array_join("c.variables", ",").alias("variables"), F.array_join("c.places", ",").alias("places"))


def _at(n, seed: int) -> str:
    return f"(CAST('0x' || left(md5('{seed}:' || CAST(p_partkey AS VARCHAR)), 8) AS BIGINT) % {n})"


@query(
    "surface_forms",
    "WITH p AS (SELECT p_partkey, p_name, p_name || ', ' || p_type AS q, CASE WHEN p_partkey % 2 = 0 THEN ['C' || CAST(p_size AS VARCHAR), p_brand] ELSE [] END AS codes, CASE WHEN p_partkey % 3 > 0 THEN [p_name || 'x', substr(p_name, 2), reverse(p_name)] ELSE [] END AS typos FROM part), "
    f"f AS (SELECT *, CASE WHEN len(codes) > 0 AND {_at(100, 0)} < 8 THEN 'code' WHEN len(typos) > 0 AND {_at(100, 0)} < 32 THEN 'misspelt' WHEN {_at(100, 0)} < 52 THEN 'qualified' ELSE 'plain' END AS form FROM p), "
    f"w AS (SELECT *, CASE form WHEN 'code' THEN codes[CAST({_at('greatest(len(codes), 1)', 1)} AS INT) + 1] WHEN 'misspelt' THEN typos[CAST({_at('greatest(len(typos), 1)', 2)} AS INT) + 1] WHEN 'qualified' THEN q ELSE p_name END AS said FROM f) SELECT p_partkey, form, CASE WHEN {_at(100, 3)} < 25 AND form <> 'code' THEN lower(said) ELSE said END AS span FROM w",
)
def _(spark, d):
    none = "cast(array() AS ARRAY<STRING>)"
    p = table(spark, d, "part").selectExpr("p_partkey", "p_name", "p_name || ', ' || p_type AS q", f"CASE WHEN p_partkey % 2 = 0 THEN array('C' || CAST(p_size AS STRING), p_brand) ELSE {none} END AS codes", f"CASE WHEN p_partkey % 3 > 0 THEN array(p_name || 'x', substr(p_name, 2), reverse(p_name)) ELSE {none} END AS typos")
    said = generate.surface(F.col("p_name"), F.col("q"), F.col("codes"), F.col("typos"), F.col("p_partkey"))
    return p.select("p_partkey", said.alias("s")).select("p_partkey", "s.form", "s.span")


@query(
    "derived_labels",
    f"WITH {FILLED}, t AS (SELECT row_id, min_by(span, i) AS said FROM spot WHERE s = 'time' GROUP BY 1) SELECT row_id, CASE activity WHEN 'SPRAY' THEN 'AGRICULTURE' ELSE activity END AS action, CASE WHEN activity = 'TRAVEL' THEN coalesce(CASE (SELECT min_by(span, i) FROM spot WHERE spot.row_id = made.row_id AND s = 'transport') "
    + " ".join(f"WHEN '{t}' THEN '{A.SYNONYMS.get(t, t)}'" for t in WORDS["transport"])
    + " END, 'car') ELSE '' END AS sub_activity, said AS time, CASE said WHEN 'today' THEN 'TODAY' WHEN '3 pm' THEN 'CLOCK' WHEN 'tomorrow' THEN 'TOMORROW' WHEN 'next week' THEN 'WEEK' WHEN 'yesterday' THEN 'PAST' WHEN 'last week' THEN 'PAST' ELSE 'NONE' END AS bucket FROM made LEFT JOIN t USING (row_id)",
)
def _(spark, d):
    rows = corpus_rows(spark, d)
    said = F.get("times", F.lit(0))
    sub = A.sub_activity(F.col("activity"), F.col("entities"), F.col("text"))
    return rows.select("row_id", A.group(F.col("activity")).alias("action"), sub.alias("sub_activity"), said.alias("time"), timex.bucket(timewords.canonical(said, guess=False)).alias("bucket"))


NAMED = "[A-Z][a-z]{2,}(?: [a-z]+)?"


@query(
    "word_cut_by_share",
    f"WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{marks.TOKEN}')) AS word FROM documents) GROUP BY 1), h AS (SELECT word, count(*) AS inside FROM (SELECT unnest(regexp_extract_all(lower(span), '{marks.TOKEN}')) AS word FROM (SELECT unnest(regexp_extract_all(text, '{NAMED}')) AS span FROM documents)) GROUP BY 1), "
    f"m AS (SELECT count(*) AS names, coalesce(max(n), 0) AS commonest FROM w JOIN h USING (word) WHERE regexp_full_match(word, '\\p{{L}}+') AND word NOT IN ({', '.join(repr(x) for x in gates.GENERIC)}) AND inside >= 0.5 * n) SELECT CAST(coalesce(list_min(list_filter([{', '.join(map(str, gates.CUTS))}], lambda c: c > commonest)), {gates.CUTS[-1]}) AS INT) AS cut, names, commonest FROM m",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("text", F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)).alias("locations"))
    return gates.word_cut(docs)


@query("noisy_rows")
def _(spark, d):
    rows = corpus_rows(spark, d)
    spans = gates.spans()
    said = rows.select("row_id", "text", spans.alias("spans"), noise.noisy(F.col("text"), spans, F.col("row_id"), seed=500).alias("noisy"), F.get("times", F.lit(0)).alias("time"))
    return noise.misspelt_times(said, "time", "row_id", seed=900, rate=noise.TIMES)


# ---------------------------------------------------------------- heads and taggers

CLASSES = ("a", "b", "c", "d")
#: Scores and gold labels of every labelled document.
SCORED = ", ".join(f"CAST((doc_id * {37 + 6 * i} + {i * 29}) % 100 AS DOUBLE) / 100" for i in range(len(CLASSES)))
GOLD = "CASE WHEN quality = 1 AND toxic = 1 THEN ['a', 'b'] WHEN quality = 1 THEN ['a'] WHEN toxic = 1 THEN ['b', 'c'] ELSE ['d'] END"


@query(
    "multi_label_cuts",
    f"WITH s AS (SELECT [{SCORED}] AS p, {GOLD} AS gold FROM labels), x AS (SELECT c AS cut, gold, CASE WHEN len(list_filter(p, lambda q: q >= c)) > 0 THEN list_transform(list_filter(range(1, 5), lambda i: p[i] >= c), lambda i: (['a', 'b', 'c', 'd'])[i]) ELSE [(['a', 'b', 'c', 'd'])[list_position(p, list_max(p))]] END AS said FROM s CROSS JOIN (SELECT unnest([0.2, 0.25, 0.3, 0.35, 0.4, 0.5]::DOUBLE[]) AS c)) "
    "SELECT cut, tp, fp, fn, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT cut, CAST(sum(len(list_intersect(said, gold))) AS BIGINT) AS tp, CAST(sum(len(said) - len(list_intersect(said, gold))) AS BIGINT) AS fp, CAST(sum(len(gold) - len(list_intersect(said, gold))) AS BIGINT) AS fn FROM x GROUP BY 1)",
)
def _(spark, d):
    gold = GOLD.replace("[", "array(").replace("]", ")")
    return ml.calibrated(table(spark, d, "labels").selectExpr(f"array({SCORED}) AS scores", f"{gold} AS gold"), "gold", CLASSES)


@query(
    "term_weights",
    "WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9:]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM conversations), w AS (SELECT conv_id, turn, regexp_extract_all(t, '[a-z0-9]{2,}') AS w, list_filter(string_split(t, ' '), lambda x: x <> '') AS c FROM t), "
    "g AS (SELECT conv_id, turn, 'word' AS kind, unnest(w) AS term FROM w UNION ALL SELECT conv_id, turn, 'word', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w "
    "UNION ALL SELECT conv_id, turn, 'char', unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, len(p) - n + 2), lambda i: substr(p, i, n))))) FROM (SELECT conv_id, turn, ' ' || unnest(c) || ' ' AS p FROM w)), "
    "k AS (SELECT conv_id, turn, kind, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT kind, term, count(*) AS df FROM k GROUP BY ALL HAVING kind = 'word' OR count(*) >= 2), "
    "r AS (SELECT conv_id, turn, kind, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM conversations)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS raw FROM k JOIN d USING (kind, term)), "
    "z AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY conv_id, turn, kind)) AS weight FROM r) SELECT conv_id, turn, kind, count(*) AS n, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM z GROUP BY ALL",
)
def _(spark, d):
    weights = ml.term_weights(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return weights.groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


LANGS = ("the", "der", "que", "les")


@query("multi_label_heads")
def _(spark, d):
    said = F.split(X.clean_text(F.col("text")), " ")
    turns = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row_id"), "text", F.filter(F.array(*map(F.lit, LANGS)), lambda w: F.array_contains(said, w)).alias("labels"))
    ready = ml.tfidf(turns, 1 << 10)[1].select("row_id", "labels", "features")
    heads, cut = ml.multi_label(ready, "row_id", "labels", LANGS)
    return ml.label_scores(ready, heads).select("row_id", "labels", ml.chosen(F.col("scores"), LANGS, F.lit(cut)).alias("said"), F.lit(cut).alias("cut"))


@query("span_tagger")
def _(spark, d):
    rows = corpus_rows(spark, d)
    spans = F.transform(F.filter("marks", lambda m: m["slot"].startswith("place") | (m["slot"] == "time")), lambda m: F.struct(F.when(m["slot"] == "time", "TIME").otherwise("LOC").alias("slot"), m["start"].alias("start"), m["end"].alias("end")))
    rows = ml.written(rows.select("row_id", "text", spans.alias("marks")), "tagger")
    held = F.col("row_id") % 3 == 2
    tagger = ml.Tagger(least=40, metrics=WORDS["v"]).fit(rows.where(~held), "row_id")
    test = rows.where(held)
    return ml.with_written_times(ml.spans_of_tags(tagger.tag(test, "row_id"), test, "row_id"), test, "row_id")


# ---------------------------------------------------------------- chats that fall silent

#: Turns are ten minutes apart; in every third chat, the third one comes two days later.
IDLE_SQL = (
    f"WITH RECURSIVE {ansi('turns')}, s0 AS (SELECT chat_id, turn, intent, CASE WHEN (chat_id + turn) % 3 = 0 THEN 'P' || CAST((chat_id + turn) % 11 AS VARCHAR) END AS p, CASE WHEN (chat_id * 2 + turn) % 4 = 0 THEN 'T' || CAST(turn AS VARCHAR) END AS t, turn % 3 = 1 AS follow_up, (chat_id + turn) % 17 = 0 AS compares, turn % 2 = 1 AS silent, "
    f"CASE WHEN {BACK} THEN 'LOCATION' ELSE 'NONE' END AS reference, CASE WHEN turn >= 2 AND chat_id % 3 = 0 THEN 1 ELSE 0 END AS session FROM (SELECT *, regexp_replace(lower(text), '\\s+', ' ', 'g') AS said FROM turns)), s AS (SELECT *, row_number() OVER (PARTITION BY chat_id, session ORDER BY turn) AS k FROM s0), "
    "f AS (SELECT DISTINCT chat_id, session, 0::BIGINT AS k, 0::BIGINT AS turn, NULL::VARCHAR AS operation, NULL::VARCHAR AS intent, NULL::VARCHAR AS places, NULL::VARCHAR AS time FROM s UNION ALL "
    "SELECT chat_id, session, k, turn, op, CASE WHEN op IN ('MODIFY', 'REPLACE', 'INHERIT') AND old_intent IS NOT NULL AND silent THEN old_intent ELSE intent END, CASE WHEN p IS NOT NULL AND op IN ('SET', 'COMPARE', 'REPLACE') THEN p ELSE old_places END, "
    "CASE WHEN t IS NOT NULL AND op IN ('SET', 'COMPARE', 'MODIFY', 'INHERIT') THEN t WHEN op = 'SET' THEN NULL ELSE old_time END "
    f"FROM (SELECT s.*, f.intent AS old_intent, f.places AS old_places, f.time AS old_time, {OPERATION} AS op FROM f JOIN s ON s.chat_id = f.chat_id AND s.session = f.session AND s.k = f.k + 1)) SELECT chat_id, turn, operation, intent, places, time FROM f WHERE k > 0"
)


def timed_slots(spark, d):
    said_at = "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CASE WHEN turn >= 2 AND chat_id % 3 = 0 THEN 2 ELSE 0 END, 0, CAST(chat_id * 7 + turn * 10 AS INT), 0)"
    return view(spark, d, "turns").withColumn("reference", X.reference(F.col("text"))).selectExpr(*[f"{e} AS {c}" for c, e in TURN.items()], "reference", f"{said_at} AS ts")


@query("idle_chats", IDLE_SQL)
def _(spark, d):
    return convo.fold(timed_slots(spark, d), idle=86_400)


@query("stream_idle_chats", IDLE_SQL)
def _(spark, d):
    at, backend = shared(spark), "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(backend)
    spark.conf.set(backend, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for later in (False, True):  # two days of input: the second run goes on with the state of the first
            out = _run(jobs.conversation(_as_stream(timed_slots(spark, d).where((F.col("ts") >= "2024-01-02 12:00:00") == later), at), "1 day"), at)
        return out
    finally:
        spark.conf.set(backend, was)
