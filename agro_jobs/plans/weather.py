"""Queries over readings: quality, statistics, runs, verdicts, comparison and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from agro_jobs.functions import dims
from agro_jobs.operators import advice, compare, quality, rollup, runs, stats
from agro_jobs.plans.registry import query
from agro_jobs.plans.views import FIELDS, ansi, clean_readings, long_readings, long_sql, view, with_clean

BY = ["place_id"]
SOME = ("Rainfall", "Tmax", "Tmin", "RH", "SunSD")
ADDED = ("Rainfall", "SunSD")
COUNTS = ("Rainfall", "SunSD", "Lowcloud")
T = "CASE field WHEN 'Rainfall' THEN 0.2 WHEN 'SunSD' THEN 0.1 WHEN 'Lowcloud' THEN 0.5 END"
SUM = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"
VSUM = SUM.format("value")


def _r(c, n=6):
    return F.round(c, n)


# ---------------------------------------------------------------- quality


@query("clean_readings", with_clean("SELECT place_id, ts, event_id, Rainfall, Tmax, Tavg, RH FROM clean"))
def _(spark, d):
    return clean_readings(spark, d).select("place_id", "ts", "event_id", "Rainfall", "Tmax", "Tavg", "RH")


@query(
    "coverage",
    with_clean("SELECT place_id, field, count(*) AS n_rows, count(value) AS n_clean, CAST(count(value) AS DOUBLE) / count(*) AS share FROM long GROUP BY 1, 2", long_sql(*SOME)),
)
def _(spark, d):
    return quality.coverage(clean_readings(spark, d), SOME, BY)


DAYS = "greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 - count(DISTINCT CAST(ts AS DATE)), 0)"


@query("day_gaps", with_clean(f"SELECT place_id, count(DISTINCT CAST(ts AS DATE)) AS days, CAST({DAYS} AS BIGINT) AS gaps FROM clean GROUP BY 1"))
def _(spark, d):
    return quality.day_gaps(clean_readings(spark, d), BY)


QF = ("Rainfall", "Tmax", "Tavg", "RH")
SHARE = {f: f"CAST(count({f}) AS DOUBLE) / count(*)" for f in QF}


@query(
    "quality_status",
    with_clean(
        "SELECT place_id, n_rows, gaps, CASE WHEN n_usable = 0 OR tavg < 0.6 THEN 'SPARSE' WHEN least(a, b, tavg, dd) >= 0.9 AND gaps = 0 THEN 'OK' ELSE 'PARTIAL' END AS status, n_usable, "
        "NOT (n_usable = 0 OR tavg < 0.6) AS can_answer FROM (SELECT place_id, count(*) AS n_rows, CAST(" + DAYS + " AS BIGINT) AS gaps, "
        f"{SHARE['Rainfall']} AS a, {SHARE['Tmax']} AS b, {SHARE['Tavg']} AS tavg, {SHARE['RH']} AS dd, "
        + " + ".join(f"CAST({s} >= 0.6 AS INT)" for s in SHARE.values()) + " AS n_usable FROM clean GROUP BY 1)"
    ),
)
def _(spark, d):
    return quality.status(clean_readings(spark, d), QF, BY, required=("Tavg",)).select("place_id", "n_rows", "gaps", "status", F.size("usable").alias("n_usable"), "can_answer")


SERVED = ("Rainfall", "Tavg", "RH")


@query(
    "served_columns",
    with_clean(
        "SELECT place_id, day, CASE WHEN a + b + c = 0 THEN 'Rainfall,Tavg,RH' ELSE concat_ws(',', CASE WHEN a > 0 THEN 'Rainfall' END, CASE WHEN b > 0 THEN 'Tavg' END, CASE WHEN c > 0 THEN 'RH' END) END AS fields "
        "FROM (SELECT place_id, CAST(ts AS DATE) AS day, count(Rainfall) AS a, count(Tavg) AS b, count(RH) AS c FROM clean GROUP BY 1, 2)"
    ),
)
def _(spark, d):
    rows = clean_readings(spark, d).withColumn("day", F.to_date("ts"))
    return quality.served(rows, SERVED, ["place_id", "day"]).select("place_id", "day", F.concat_ws(",", "fields").alias("fields"))


# ---------------------------------------------------------------- statistics


def _stat(name: str, fields: tuple[str, ...], columns: dict[str, str], exprs: dict[str, str], where: str = "value IS NOT NULL") -> None:
    """Register one statistic: Spark columns of `stats.plain` and their SQL."""
    said = ", ".join(f"{e} AS {c}" for c, e in exprs.items())

    @query(name, with_clean(f"SELECT place_id, field, {said} FROM long WHERE {where} GROUP BY 1, 2", long_sql(*fields)))
    def _(spark, d):
        p = stats.plain(long_readings(spark, d, fields), BY)
        return p.select("place_id", "field", *[F.expr(e).alias(c) for c, e in columns.items()])


_stat("stat_sum", ADDED, {"total": "sum", "n": "n"}, {"total": VSUM, "n": "count(value)"})
_stat("stat_avg", SOME, {"average": "avg"}, {"average": f"{VSUM} / count(value)"})
_stat("stat_median", SOME, {"median": "round(median, 6)"}, {"median": "round(median(value), 6)"})
_stat("stat_max", SOME, {"high": "max", "at": "max_at"}, {"high": "max(value)", "at": "arg_min(ts, struct_pack(v := -value, t := ts))"})
_stat("stat_min", SOME, {"low": "min", "at": "min_at"}, {"low": "min(value)", "at": "arg_min(ts, struct_pack(v := value, t := ts))"})
_stat("stat_range", SOME, {"width": "range"}, {"width": "max(value) - min(value)"})
_stat("stat_stddev", SOME, {"stddev": "round(stddev, 6)", "steady": "stddev < 1"}, {"stddev": "CASE WHEN count(value) >= 2 THEN round(stddev_pop(value), 6) END", "steady": "CASE WHEN count(value) >= 2 THEN stddev_pop(value) END < 1"})
_stat("stat_change", SOME, {"change": "change"}, {"change": "CASE WHEN count(value) >= 2 THEN arg_max(value, ts) - arg_min(value, ts) END"})
_stat("stat_count", COUNTS, {"hits": "count", "n": "n"}, {"hits": f"count(*) FILTER (value >= {T})", "n": "count(value)"})
_stat("stat_frequency", COUNTS, {"percent": "frequency"}, {"percent": f"CAST(count(*) FILTER (value >= {T}) AS DOUBLE) / count(value) * 100"})
_stat("stat_intensity", COUNTS, {"mean_of_hits": "intensity"}, {"mean_of_hits": f"CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (value >= {T}) AS DOUBLE) / nullif(count(*) FILTER (value >= {T}), 0)"})
_stat("stat_peak_low_date", SOME, {"peak_date": "to_date(max_at)", "low_date": "to_date(min_at)"}, {"peak_date": "CAST(arg_min(ts, struct_pack(v := -value, t := ts)) AS DATE)", "low_date": "CAST(arg_min(ts, struct_pack(v := value, t := ts)) AS DATE)"})

POINT = "(CAST(floor(Wind_Direction / 22.5 + 0.5) AS BIGINT) % 16)"
NAMES = "[" + ", ".join(f"'{p}'" for p in dims.POINTS) + "]"


@query(
    "stat_mode",
    with_clean(
        f"SELECT place_id, arg_min(point, struct_pack(n := -n, s := seen)) AS point, max(n) AS n, CAST(max(n) AS DOUBLE) / sum(n) * 100 AS share FROM (SELECT place_id, {NAMES}[{POINT} + 1] AS point, count(*) AS n, min(ts) AS seen FROM clean WHERE Wind_Direction IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
    ),
)
def _(spark, d):
    return stats.mode(long_readings(spark, d, ("Wind_Direction",)), BY)


@query(
    "stat_distribution",
    with_clean(
        f"SELECT g.place_id, p.point, coalesce(c.n, 0) AS n, CAST(coalesce(c.n, 0) AS DOUBLE) / g.total * 100 AS share FROM (SELECT place_id, count(*) AS total FROM clean WHERE Wind_Direction IS NOT NULL GROUP BY 1) g CROSS JOIN (SELECT unnest({NAMES}) AS point) p "
        f"LEFT JOIN (SELECT place_id, {NAMES}[{POINT} + 1] AS point, count(*) AS n FROM clean WHERE Wind_Direction IS NOT NULL GROUP BY 1, 2) c ON c.place_id = g.place_id AND c.point = p.point"
    ),
)
def _(spark, d):
    return stats.distribution(long_readings(spark, d, ("Wind_Direction",)), BY)


@query(
    "stat_peak_low_period",
    with_clean(
        "SELECT place_id, field, arg_min(day, struct_pack(v := -total, t := day)) AS peak_day, max(total) AS peak_total, arg_min(day, struct_pack(v := total, t := day)) AS low_day, min(total) AS low_total "
        f"FROM (SELECT place_id, field, CAST(ts AS DATE) AS day, {VSUM} AS total FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2",
        long_sql(*ADDED),
    ),
)
def _(spark, d):
    return stats.periods(long_readings(spark, d, ADDED), BY)


@query("stat_cumulative", with_clean("SELECT place_id, field, ts, value, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY place_id, field ORDER BY ts ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM long WHERE value IS NOT NULL", long_sql(*ADDED)))
def _(spark, d):
    return stats.cumulative(long_readings(spark, d, ADDED), BY)


SPELLS = (
    f"hits AS (SELECT place_id, field, ts, value >= {T} AS hit FROM long WHERE value IS NOT NULL), "
    "marks AS (SELECT *, CAST(hit AND NOT coalesce(lag(hit) OVER (PARTITION BY place_id, field ORDER BY ts), false) AS INT) AS new FROM hits), "
    "runs AS (SELECT *, sum(new) OVER (PARTITION BY place_id, field ORDER BY ts) AS run FROM marks), "
    "spells AS (SELECT place_id, field, run, count(*) AS n, min(ts) AS start, max(ts) AS until FROM runs WHERE hit GROUP BY 1, 2, 3)"
)


@query("stat_run_count", with_clean("SELECT place_id, field, count(*) AS runs FROM spells GROUP BY 1, 2", long_sql(*COUNTS), SPELLS))
def _(spark, d):
    return stats.spell_summary(long_readings(spark, d, COUNTS), BY).select("place_id", "field", "runs")


@query("stat_longest_run", with_clean("SELECT place_id, field, max(n) AS longest, arg_min(start, struct_pack(n := -n, s := start)) AS start, arg_min(until, struct_pack(n := -n, s := start)) AS until FROM spells GROUP BY 1, 2", long_sql(*COUNTS), SPELLS))
def _(spark, d):
    return stats.spell_summary(long_readings(spark, d, COUNTS), BY).drop("runs")


@query(
    "stat_trend",
    with_clean(
        "SELECT place_id, field, z - a AS change, CASE WHEN z > a THEN 'rising' ELSE 'falling' END AS direction, peak_at, low_at FROM (SELECT place_id, field, count(value) AS n, arg_min(value, ts) AS a, arg_max(value, ts) AS z, "
        "arg_min(ts, struct_pack(v := -value, t := ts)) AS peak_at, arg_min(ts, struct_pack(v := value, t := ts)) AS low_at FROM long WHERE value IS NOT NULL GROUP BY 1, 2) WHERE n >= 3 AND abs(z - a) >= 1.5",
        long_sql(*SOME),
    ),
)
def _(spark, d):
    return stats.trend(long_readings(spark, d, SOME), BY)


@query(
    "stat_gated",
    with_clean(
        f"SELECT place_id, 'RAIN' AS variable, field, 'SUM' AS statistic, {VSUM} AS value FROM long WHERE field = 'Rainfall' AND value IS NOT NULL GROUP BY place_id, field UNION ALL "
        f"SELECT place_id, 'SUNSHINE', field, 'SUM', {VSUM} FROM long WHERE field = 'SunSD' AND value IS NOT NULL GROUP BY place_id, field UNION ALL "
        f"SELECT place_id, 'HUMIDITY', field, 'AVG', {VSUM} / count(value) FROM long WHERE field = 'RH' AND value IS NOT NULL GROUP BY place_id, field",
        long_sql("Rainfall", "RH", "SunSD", "Tmax"),
    ),
)
def _(spark, d):
    asked = spark.createDataFrame([("RAIN", "SUM"), ("SUNSHINE", "SUM"), ("HUMIDITY", "SUM"), ("HUMIDITY", "AVG"), ("TEMPERATURE", "COUNT")], "variable string, statistic string")
    return stats.gated(long_readings(spark, d, ("Rainfall", "RH", "SunSD", "Tmax")), BY, asked, dims.gates(spark))


# ---------------------------------------------------------------- runs

EPOCH = "(epoch_us({}) / 3600000000.0)"
GAPS = (
    f"gaps AS (SELECT place_id, coalesce(median(CASE WHEN g > 0 THEN g END), 1.0) AS spacing FROM (SELECT place_id, CAST(epoch_us(ts) AS DOUBLE) / 3600000000.0 - CAST(lag(epoch_us(ts)) OVER (PARTITION BY place_id ORDER BY ts) AS DOUBLE) / 3600000000.0 AS g FROM clean) GROUP BY 1)"
)


def islands_sql(name: str, condition: str) -> str:
    return (
        f"{name}_i AS (SELECT place_id, ts, coalesce({condition}, false) AS ok, sum(CAST(NOT coalesce({condition}, false) AS INT)) OVER (PARTITION BY place_id ORDER BY ts) AS run FROM clean), "
        f"{name} AS (SELECT i.place_id, count(*) AS readings, min(ts) AS start, max(ts) AS last, CAST(epoch_us(max(ts)) AS DOUBLE) / 3600000000.0 - CAST(epoch_us(min(ts)) AS DOUBLE) / 3600000000.0 + any_value(spacing) AS hours "
        f"FROM {name}_i i JOIN gaps USING (place_id) WHERE ok GROUP BY i.place_id, run)"
    )


@query("spacing", with_clean("SELECT place_id, round(spacing, 6) AS spacing FROM gaps", GAPS))
def _(spark, d):
    return runs.spacing(clean_readings(spark, d), BY).select("place_id", _r(F.col("spacing")).alias("spacing"))


@query("runs_dry", with_clean("SELECT place_id, start, last, readings, round(hours, 5) AS hours FROM dry", GAPS, islands_sql("dry", "Rainfall < 1.0")))
def _(spark, d):
    return runs.runs(clean_readings(spark, d), dims.DRY, BY).select("place_id", "start", "last", "readings", _r(F.col("hours"), 5).alias("hours"))


HELD = "held AS (SELECT c.place_id, c.n, spacing, count(d.start) AS n_runs, coalesce(max(d.hours), 0.0) AS best, coalesce(sum(d.hours), 0.0) AS total, max(d.readings) AS longest FROM (SELECT place_id, count(*) AS n FROM clean GROUP BY 1) c JOIN gaps USING (place_id) LEFT JOIN dry d ON d.place_id = c.place_id GROUP BY 1, 2, 3)"


@query("run_coverage", with_clean("SELECT place_id, n_runs, round(best, 5) AS best, round(total / (spacing * n), 5) AS share FROM held", GAPS, islands_sql("dry", "Rainfall < 1.0"), HELD))
def _(spark, d):
    return runs.held(clean_readings(spark, d), dims.DRY, BY, 24.0).select("place_id", "n_runs", _r(F.col("best"), 5).alias("best"), _r(F.col("share"), 5).alias("share"))


@query("run_fragmented", with_clean("SELECT place_id, coalesce(best < 48.0 AND total / (spacing * n) >= 0.25 AND longest < n, false) AS fragmented FROM held", GAPS, islands_sql("dry", "Rainfall < 1.0"), HELD))
def _(spark, d):
    return runs.held(clean_readings(spark, d), dims.DRY, BY, 48.0).select("place_id", "fragmented")


SETTLED = (
    "jobs AS (SELECT place_id, start, hours, CAST(epoch_us(start) AS DOUBLE) / 3600000000.0 AS a, CAST(epoch_us(start) AS DOUBLE) / 3600000000.0 + hours AS b FROM work WHERE hours >= 2), "
    "horizon AS (SELECT place_id, max(CAST(epoch_us(ts) AS DOUBLE) / 3600000000.0) + any_value(spacing) AS h FROM clean JOIN gaps USING (place_id) GROUP BY 1), "
    "roofs AS (SELECT place_id, CAST(epoch_us(start) AS DOUBLE) / 3600000000.0 AS ra, CAST(epoch_us(start) AS DOUBLE) / 3600000000.0 + hours AS rb FROM roof), "
    "ok AS (SELECT j.place_id, j.start, arg_min(rb - greatest(a, ra) < 6 AND rb >= h, ra) AS unconfirmed FROM jobs j JOIN roofs r ON j.place_id = r.place_id AND a < rb AND b > ra JOIN horizon z ON z.place_id = j.place_id WHERE least(b, rb) - greatest(a, ra) >= 2 AND (rb - greatest(a, ra) >= 6 OR rb >= h) GROUP BY 1, 2)"
)
SPRAY = "Rainfall < 0.2 AND Wind_Speed BETWEEN 1.0 AND 4.5"


@query("settle_join", with_clean("SELECT j.place_id, j.start, round(j.hours, 5) AS hours, o.start IS NOT NULL AS settled, coalesce(unconfirmed, false) AS unconfirmed FROM jobs j LEFT JOIN ok o ON o.place_id = j.place_id AND o.start = j.start", GAPS, islands_sql("work", SPRAY), islands_sql("roof", "Rainfall < 0.2"), SETTLED))
def _(spark, d):
    return runs.settled(clean_readings(spark, d), SPRAY, dims.NOT_DAMP, BY, 2.0, 4.0).withColumn("hours", _r(F.col("hours"), 5))


# ---------------------------------------------------------------- verdicts


def _timed_sql() -> str:
    parts = []
    for name, during, hours, settle in dims.TIMED:
        need = f"{name.lower()}_w"
        parts.append(islands_sql(need, during))
    return ", ".join(parts)


def _ladder(name: str, hours: float) -> str:
    w = f"{name.lower()}_w"
    return (
        f"SELECT c.place_id, '{name}' AS activity, CASE WHEN max(w.hours) >= {hours} THEN 'YES' WHEN count(w.start) > 0 THEN 'CAUTION' ELSE 'NO' END AS verdict, count(w.start) AS windows "
        f"FROM (SELECT DISTINCT place_id FROM clean) c LEFT JOIN {w} w ON w.place_id = c.place_id GROUP BY 1"
    )


SPRAY_SQL = (
    "SELECT c.place_id, 'SPRAY' AS activity, CASE WHEN max(CAST(s.settled AS INT)) = 1 THEN 'YES' WHEN max(w.hours) >= 2 THEN 'NO' WHEN count(w.start) > 0 THEN 'CAUTION' ELSE 'NO' END AS verdict, count(w.start) AS windows "
    "FROM (SELECT DISTINCT place_id FROM clean) c LEFT JOIN work w ON w.place_id = c.place_id LEFT JOIN (SELECT j.place_id, j.start, o.start IS NOT NULL AS settled FROM jobs j LEFT JOIN ok o ON o.place_id = j.place_id AND o.start = j.start) s ON s.place_id = w.place_id AND s.start = w.start GROUP BY 1"
)


@query(
    "advice_timed",
    with_clean(" UNION ALL ".join([SPRAY_SQL] + [_ladder(n, h) for n, _, h, s in dims.TIMED if not s]), GAPS, _timed_sql(), islands_sql("work", SPRAY), islands_sql("roof", "Rainfall < 0.2"), SETTLED),
)
def _(spark, d):
    return advice.timed(clean_readings(spark, d), BY).select("place_id", "activity", "verdict", F.col("n_runs").alias("windows"))


SUB = {kind: (during, hours) for _, kind, during, hours, _ in dims.SUB_TIMED}


@query(
    "advice_sub_timed",
    with_clean(" UNION ALL ".join(_ladder(n, h) for n, (_, h) in SUB.items()), GAPS, *[islands_sql(f"{n.lower()}_w", during) for n, (during, _) in SUB.items()]),
)
def _(spark, d):
    rows = clean_readings(spark, d)
    out = advice.sub_timed(rows, BY, "VEHICLE_WASHING").unionByName(advice.sub_timed(rows, BY, "SPORTS"))
    return out.select("place_id", "activity", "verdict", F.col("n_runs").alias("windows"))


@query("wet_spells", with_clean("SELECT place_id, wet, first_wet, round(clear_hours, 5) AS clear_hours FROM (SELECT place_id, count(*) AS wet, min(start) AS first_wet FROM soaked GROUP BY 1) FULL JOIN (SELECT place_id, max(hours) AS clear_hours FROM dry GROUP BY 1) USING (place_id)", GAPS, islands_sql("dry", "Rainfall < 1.0"), islands_sql("soaked", "NOT (Rainfall < 1.0)")))
def _(spark, d):
    return advice.wet_spells(clean_readings(spark, d), BY).withColumn("clear_hours", _r(F.col("clear_hours"), 5))


STATE = (
    f"agg AS (SELECT place_id, count(*) AS n, {SUM.format('Rainfall')} AS rain, {SUM.format('SunSD')} AS sun, {SUM.format('DayLength')} AS daylight, count(SunSD) AS n_sun, min(Tmin) AS low, min(Tavg) AS mid, round({SUM.format('Soilm10')} / count(Soilm10), 1) AS soil, round({SUM.format('Soilt10')} / count(Soilt10), 1) AS soilt, max(Rainfall) AS peak FROM clean GROUP BY 1), "
    "f AS (SELECT *, round(coalesce(sun / nullif(CASE WHEN coalesce(daylight, 0) > 0 THEN daylight ELSE n_sun END, 0), 0), 2) AS frac, round(coalesce(low, mid), 1) AS cold, round(coalesce(rain, 0), 1) AS total FROM agg), "
    "state AS (SELECT place_id, 'RAIN_PROTECTION' AS activity, CASE WHEN peak >= 1 THEN 'YES/spells of rain' ELSE 'NO/not much rain' END AS said FROM f UNION ALL SELECT place_id, 'SUN_PROTECTION', CASE WHEN frac >= 0.75 THEN 'YES/strong sun' WHEN frac >= 0.5 THEN 'YES/half the possible sunshine' ELSE 'NO/little sunshine' END FROM f UNION ALL "
    "SELECT place_id, 'CLOTHING', CASE WHEN cold IS NULL THEN 'UNKNOWN/no temperature reading' WHEN cold <= 15 THEN 'YES/something warm' WHEN cold <= 20 THEN 'CAUTION/a light layer' ELSE 'NO/not cold' END FROM f UNION ALL "
    "SELECT place_id, 'FERTILIZE', CASE WHEN total >= 25 THEN 'NO/will wash off' WHEN total >= 2 THEN 'YES/enough to carry it in' WHEN soil < 0.15 THEN 'CAUTION/dry ground' ELSE 'CAUTION/too little rain' END FROM f UNION ALL "
    "SELECT place_id, 'IRRIGATE', CASE WHEN total >= 10 THEN 'NO/rain is coming' WHEN soil >= 0.3 THEN 'NO/soil is wet' WHEN soil <= 0.15 THEN 'YES/soil is dry' ELSE 'CAUTION/borderline' END FROM f UNION ALL "
    "SELECT place_id, 'SOW', CASE WHEN soil >= 0.15 AND total >= 10 THEN 'YES/moist and rain to come' WHEN total < 5 AND (soil IS NULL OR soil < 0.15) THEN 'NO/too dry' WHEN soilt < 15 THEN 'CAUTION/ground is cold' ELSE 'CAUTION/borderline' END FROM f)"
)


@query("advice_state", with_clean("SELECT place_id, activity, split_part(said, '/', 1) AS verdict, split_part(said, '/', 2) AS reason FROM state", STATE))
def _(spark, d):
    return advice.state(clean_readings(spark, d), BY).select("place_id", "activity", "verdict", "reason")


#: Places of a day with an hour of readings each: thin enough for some to be undecidable.
DAILY = with_clean("SELECT 1", STATE).removesuffix(" SELECT 1").replace("SELECT place_id, ts, event_id,", "SELECT place_id * 100 + day(ts) AS place_id, ts, event_id,")
SHARES = "cover AS (SELECT place_id, " + ", ".join(f"CAST(count({f}) AS DOUBLE) / count(*) AS {f}" for f in ("Rainfall", "SunSD", "Tmin", "Tmax", "Soilm10")) + " FROM clean GROUP BY 1)"
NEEDED = "CASE activity WHEN 'SUN_PROTECTION' THEN ['SunSD'] WHEN 'CLOTHING' THEN ['Tmin', 'Tmax'] WHEN 'IRRIGATE' THEN ['Soilm10', 'Rainfall'] WHEN 'SOW' THEN ['Soilm10', 'Rainfall'] ELSE ['Rainfall'] END"


@query(
    "advice_judged",
    f"{DAILY}, {SHARES}, g AS (SELECT state.place_id, activity, said, {NEEDED} AS needs, map {{'Rainfall': Rainfall, 'SunSD': SunSD, 'Tmin': Tmin, 'Tmax': Tmax, 'Soilm10': Soilm10}} AS share FROM state JOIN cover USING (place_id)), "
    "j AS (SELECT *, list_filter(needs, lambda f: share[f] < 0.6) AS missing, list_min(list_transform(needs, lambda f: share[f])) AS worst FROM g) "
    "SELECT place_id, activity, CASE WHEN len(missing) > 0 THEN 'UNKNOWN' ELSE split_part(said, '/', 1) END AS verdict, CASE WHEN len(missing) > 0 THEN 'missing the readings this needs: ' || array_to_string(missing, ', ') WHEN worst < 0.9 THEN 'partial data: ' || CAST(CAST(round(worst * 100) AS INT) AS VARCHAR) || '% coverage on the thinnest reading' ELSE '' END AS caveat FROM j",
)
def _(spark, d):
    rows = clean_readings(spark, d).withColumn("place_id", F.col("place_id") * 100 + F.day("ts"))
    return advice.judged(advice.state(rows, BY), rows, BY).select("place_id", "activity", "verdict", "caveat")


# ---------------------------------------------------------------- comparison


@query("compare_places", with_clean(f"SELECT place_id, week, total, rank() OVER (PARTITION BY week ORDER BY total DESC, place_id) AS place_rank, max(total) OVER (PARTITION BY week) - min(total) OVER (PARTITION BY week) AS gap FROM (SELECT place_id, CAST(date_trunc('week', ts) AS DATE) AS week, {SUM.format('Rainfall')} AS total FROM clean GROUP BY 1, 2) WHERE total IS NOT NULL"))
def _(spark, d):
    rows = clean_readings(spark, d).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return compare.ranked(rows, "Rainfall", "place_id", ["week"], total=True).select("place_id", "week", F.col("figure").alias("total"), F.col("rank").alias("place_rank"), "gap")


PLACES = (1, 2, 3)


@query("compare_pivot", with_clean("SELECT day, " + ", ".join(f"arg_max(Tmax, struct_pack(t := ts, e := event_id)) FILTER (place_id = {p} AND Tmax IS NOT NULL) AS p{p}" for p in PLACES) + " FROM (SELECT *, CAST(ts AS DATE) AS day FROM clean) WHERE place_id IN (1, 2, 3) GROUP BY 1"))
def _(spark, d):
    return compare.table(clean_readings(spark, d).withColumn("day", F.to_date("ts")), "Tmax", "place_id", PLACES, "day")


NOTES = " UNION ALL ".join(
    f"SELECT place_id, '{f}' AS field, count(*) FILTER ({f} {'<=' if low else '>='} {t}) AS crossings, {'min' if low else 'max'}({f}) AS extreme, '{said}' AS phrase FROM clean GROUP BY 1 HAVING count(*) FILTER ({f} {'<=' if low else '>='} {t}) > 0"
    for f, t, said, low in dims.NOTABLE
    if f in FIELDS
)


@query("notes_threshold", with_clean(NOTES))
def _(spark, d):
    return compare.crossings(clean_readings(spark, d), BY)


@query(
    "notes_top4",
    with_clean(
        "SELECT place_id, kind, field, priority FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY priority, field) AS r FROM (SELECT place_id, 'THRESHOLD' AS kind, field, 2 AS priority FROM notes UNION ALL "
        "SELECT place_id, 'DRY_SPELL', 'Rainfall', 3 FROM clean GROUP BY 1 HAVING count(*) FILTER (Rainfall < 1) > 0 AND count(Rainfall) > 2 UNION ALL SELECT place_id, 'RANGE', field, 1 FROM long WHERE value IS NOT NULL GROUP BY place_id, field HAVING count(value) > 1)) WHERE r <= 4",
        f"notes AS ({NOTES})", long_sql("Tmax", "Tmin"),
    ),
)
def _(spark, d):
    return compare.notes(clean_readings(spark, d), BY, ranges=("Tmax", "Tmin")).select("place_id", "kind", "field", "priority")


@query("series_band", with_clean("SELECT place_id, CAST(ts AS DATE) AS day, min(Tmin) AS low, max(Tmax) AS high, (min(Tmin) + max(Tmax)) / 2 AS mid FROM clean GROUP BY 1, 2"))
def _(spark, d):
    return compare.band(clean_readings(spark, d), "Tmin", "Tmax", BY)


@query("series_heatmap", with_clean(f"SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, {SUM.format('Rainfall')} / count(Rainfall) AS mean, count(Rainfall) AS n FROM clean GROUP BY 1, 2 HAVING count(Rainfall) > 0"))
def _(spark, d):
    return compare.grid(clean_readings(spark, d), "Rainfall", [])


# ---------------------------------------------------------------- roll-ups


@query("rollup_grain", with_clean(" UNION ALL ".join(f"SELECT place_id, '{g}' AS grain, CAST(date_trunc('{g}', ts) AS DATE) AS period, {SUM.format('Rainfall')} AS Rainfall, max(Tmax) AS Tmax, min(Tmin) AS Tmin, {SUM.format('RH')} / count(RH) AS RH, count(*) AS n FROM clean GROUP BY 1, 3" for g in ("day", "week", "month", "year"))))
def _(spark, d):
    out = None
    for g in ("day", "week", "month", "year"):
        part = rollup.grain(clean_readings(spark, d), g, BY)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "rollup_admin",
    f"WITH {ansi('archive')} SELECT r_name AS state, n_name AS district, {SUM.format('Rainfall')} AS rain, {SUM.format('Rainfall')} / count(*) AS mean, CAST(grouping(r_name, n_name) AS INT) AS level FROM archive JOIN supplier ON s_suppkey = place_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def _(spark, d):
    from agro_jobs.plans.views import table

    chain = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("n_nationkey = s_nationkey")).join(table(spark, d, "region"), F.expr("r_regionkey = n_regionkey"))
    chain = chain.select(F.col("s_suppkey").alias("place_id"), F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    return rollup.areas(view(spark, d, "archive"), chain, "Rainfall", ["state", "district"])


MONTHLY = f"monthly AS (SELECT place_id, CAST(date_trunc('month', day) AS DATE) AS month, {SUM.format('Rainfall')} AS rain FROM archive GROUP BY 1, 2)"


@query("vs_last_year", f"WITH {ansi('archive')}, {MONTHLY} SELECT a.place_id, a.month, a.rain, b.rain AS before, a.rain - b.rain AS difference, a.rain / nullif(b.rain, 0) AS ratio FROM monthly a LEFT JOIN monthly b ON b.place_id = a.place_id AND a.month = b.month + INTERVAL 1 YEAR")
def _(spark, d):
    return rollup.against(view(spark, d, "archive"), "Rainfall", months=12)


@query("vs_previous_period", f"WITH {ansi('archive')}, {MONTHLY} SELECT a.place_id, a.month, a.rain, b.rain AS before, a.rain - b.rain AS difference, a.rain / nullif(b.rain, 0) AS ratio FROM monthly a LEFT JOIN monthly b ON b.place_id = a.place_id AND a.month = b.month + INTERVAL 1 MONTH")
def _(spark, d):
    return rollup.against(view(spark, d, "archive"), "Rainfall", months=1)


@query("vs_normal", f"WITH {ansi('archive')} SELECT place_id, CAST(date_trunc('month', day) AS DATE) AS month, {SUM.format('Rainfall')} / count(*) AS mean, {SUM.format('Normal_Rainfall')} / count(*) AS normal, {SUM.format('Rainfall')} / count(*) - {SUM.format('Normal_Rainfall')} / count(*) AS difference FROM archive GROUP BY 1, 2")
def _(spark, d):
    return rollup.against_normal(view(spark, d, "archive"), "Rainfall")


@query(
    "stitch_hourly_daily",
    with_clean(
        "SELECT c.place_id, ts, 'hourly' AS grain, Rainfall FROM clean c JOIN z USING (place_id) WHERE ts < edge UNION ALL SELECT c.place_id, CAST(CAST(ts AS DATE) AS TIMESTAMP), 'daily', " + SUM.format("Rainfall") + " FROM clean c JOIN z USING (place_id) WHERE ts >= edge GROUP BY 1, 2",
        "z AS (SELECT place_id, min(ts) + INTERVAL 24 HOUR AS edge FROM clean GROUP BY 1)",
    ),
)
def _(spark, d):
    return rollup.stitch(clean_readings(spark, d), "Rainfall", BY)


@query(
    "weekly_rain_report",
    with_clean(
        f"SELECT place_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n_rows, CAST(count(Rainfall) AS DOUBLE) / count(*) AS share, {SUM.format('Rainfall')} AS total, {SUM.format('Rainfall')} / count(Rainfall) AS average, max(Rainfall) AS peak, "
        "CASE WHEN CAST(count(Rainfall) AS DOUBLE) / count(*) < 0.6 THEN 'SPARSE' WHEN CAST(count(Rainfall) AS DOUBLE) / count(*) >= 0.9 AND " + DAYS + " = 0 THEN 'OK' ELSE 'PARTIAL' END AS status FROM clean GROUP BY 1, 2"
    ),
)
def _(spark, d):
    return rollup.weekly_report(clean_readings(spark, d), "Rainfall")
