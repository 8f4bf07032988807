"""Verdicts on activities: YES, NO, CAUTION or UNKNOWN per group and activity, in one pass over the readings each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.functions.dims import DRY, GOOD, NEEDS, NOT_DAMP, SUB_TIMED, TIMED, USABLE
from agro_jobs.operators import runs

EXACT = "decimal(18,4)"


def _total(c: str) -> F.Column:
    return F.sum(F.col(c).cast(EXACT)).cast("double")


def timed(rows: DataFrame, by: Sequence[str], specs: Sequence[tuple[str, str, float, float]] = TIMED) -> DataFrame:
    """by, activity, verdict, reason, n_runs, best (hours), share, start: activities that need a stretch of good weather.

    A run long enough, and settled where the activity needs it, is YES; long enough but
    unsettled NO; any shorter run CAUTION (fragmented or tight); none NO. Every reading is
    unfolded into what it means for each activity, so all of them share one pass.
    """
    by, keys, roof = list(by), [*by, "activity"], "shelter"
    gaps = runs.spacing(rows, by)
    means = [(name, during) for name, during, _, _ in specs] + [(roof, NOT_DAMP)]
    each = rows.select(*by, "ts", F.inline(F.array(*[F.struct(F.lit(name).alias("activity"), F.coalesce(F.expr(during), F.lit(False)).alias("suits")) for name, during in means])))
    spells = runs.runs(each, "suits", keys, gaps)
    doing, settle = (F.create_map(*[F.lit(x) for spec in specs for x in (spec[0], float(spec[k]))])[F.col("activity")] for k in (2, 3))
    size = rows.groupBy(*by).agg(F.count("*").alias("n")).join(gaps, by).withColumn("activity", F.explode(F.array(*[F.lit(s[0]) for s in specs])))
    held = runs.measured(size, spells, keys, doing)
    enough = spells.where(F.col("activity") != roof).withColumns({"doing": doing, "settle": settle}).where("hours >= doing").select(*keys, "start", "hours", "doing", "settle")
    jobs = runs.sheltered(enough.where("settle > 0"), spells.where(F.col("activity") == roof), runs.last_moment(rows, gaps, by), by).select(*keys, "start", "hours", "settled")
    good = enough.where("settle = 0").select(*keys, "start", "hours", F.lit(True).alias("settled")).unionByName(jobs)
    picked = good.groupBy(*keys).agg(F.min_by(F.when(F.col("settled"), F.col("start")), F.struct(~F.col("settled"), -F.col("hours"), F.col("start"))).alias("start"), F.lit(True).alias("long"))
    out = held.join(picked, keys, "left")
    fits, soaked = F.col("start").isNotNull(), F.coalesce("long", F.lit(False)) & F.col("start").isNull()
    verdict = F.when(fits, "YES").when(soaked, "NO").when(F.col("n_runs") > 0, "CAUTION").otherwise("NO")
    reason = F.when(fits, F.when(F.col("share") >= 0.99, "clear right through").otherwise("pick the window")).when(soaked, "rain follows too soon").when(F.col("fragmented"), "breaks up").when(F.col("n_runs") > 0, "tight").otherwise("no clear spell")
    return out.select(*keys, verdict.alias("verdict"), reason.alias("reason"), "n_runs", "best", "share", "start")


def sub_timed(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """`timed` for a kind of activity with a rule of its own (a vehicle to wash, a sport to play)."""
    return timed(rows, by, [(kind, during, hours, settle) for _, kind, during, hours, settle in SUB_TIMED if kind == name])


def state(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, activity, verdict, reason, total, soil, cold, fraction: activities that depend on what the period adds up to.

    Totals and means are judged to one decimal, the share of sunshine to two, as they are told.
    """
    daylight = _total("DayLength")
    agg = rows.groupBy(*by).agg(
        F.round(F.coalesce(_total("Rainfall"), F.lit(0.0)), 1).alias("total"), F.max("Rainfall").alias("peak"),
        F.round(F.coalesce(F.try_divide(_total("SunSD"), F.nullif(F.when(F.coalesce(daylight, F.lit(0.0)) > 0, daylight).otherwise(F.count("SunSD")), F.lit(0.0))), F.lit(0.0)), 2).alias("fraction"),
        F.round(F.coalesce(F.min("Tmin"), F.min("Tavg")), 1).alias("cold"),
        *[F.round(F.try_divide(_total(c), F.count(c)), 1).alias(name) for c, name in (("Soilm10", "soil"), ("Soilt10", "soil_t"))],
    )
    total, soil, cold, sun = F.col("total"), F.col("soil"), F.col("cold"), F.col("fraction")
    rules = {  # the first case that holds: condition, verdict, reason
        "RAIN_PROTECTION": [(F.col("peak") >= 1.0, "YES", "spells of rain"), (None, "NO", "not much rain")],
        "SUN_PROTECTION": [(sun >= 0.75, "YES", "strong sun"), (sun >= 0.5, "YES", "half the possible sunshine"), (None, "NO", "little sunshine")],
        "CLOTHING": [(cold.isNull(), "UNKNOWN", "no temperature reading"), (cold <= 15, "YES", "something warm"), (cold <= 20, "CAUTION", "a light layer"), (None, "NO", "not cold")],
        "FERTILIZE": [(total >= 25, "NO", "will wash off"), (total >= 2, "YES", "enough to carry it in"), (soil < 0.15, "CAUTION", "dry ground"), (None, "CAUTION", "too little rain")],
        "IRRIGATE": [(total >= 10, "NO", "rain is coming"), (soil >= 0.30, "NO", "soil is wet"), (soil <= 0.15, "YES", "soil is dry"), (None, "CAUTION", "borderline")],
        "SOW": [((soil >= 0.15) & (total >= 10), "YES", "moist and rain to come"), ((total < 5) & (soil.isNull() | (soil < 0.15)), "NO", "too dry"), (F.col("soil_t") < 15, "CAUTION", "ground is cold"), (None, "CAUTION", "borderline")],
    }

    def first(cases: list, k: int) -> F.Column:
        out = F.lit(cases[-1][k])
        for case in reversed(cases[:-1]):
            out = F.when(case[0], case[k]).otherwise(out)
        return out

    each = F.array(*[F.struct(F.lit(name).alias("activity"), first(cases, 1).alias("verdict"), first(cases, 2).alias("reason")) for name, cases in rules.items()])
    return agg.select(*by, "total", "soil", "cold", "fraction", F.inline(each))


def judged(verdicts: DataFrame, rows: DataFrame, by: Sequence[str], needs: dict[str, tuple[str, ...]] = NEEDS) -> DataFrame:
    """verdicts with caveat: UNKNOWN where the readings an activity needs are mostly missing, a caveat where some are.

    Coverage of all fields is taken in one pass; every activity judges the fields it needs. An activity
    nobody knows has no row.
    """
    fields = sorted({f for fs in needs.values() for f in fs})
    share = rows.groupBy(*by).agg(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.count(f).cast("double") / F.count("*") for f in fields])).alias("_share"))
    needed = F.create_map(*[x for name, fs in needs.items() for x in (F.lit(name), F.array(*map(F.lit, fs)))])
    out = verdicts.join(share, list(by)).withColumn("_needs", needed[F.col("activity")]).where(F.col("_needs").isNotNull())
    missing = F.filter("_needs", lambda f: F.col("_share")[f] < USABLE)
    worst = F.array_min(F.transform("_needs", lambda f: F.col("_share")[f]))
    thin = F.concat(F.format_string("%d", F.round(worst * 100).cast("int")), F.lit("% coverage on the thinnest reading"))
    lacking = F.size(missing) > 0
    said = F.when(lacking, F.concat(F.lit("missing the readings this needs: "), F.array_join(missing, ", "))).when(worst < GOOD, F.concat(F.lit("partial data: "), thin)).otherwise("")
    return out.withColumns({"verdict": F.when(lacking, "UNKNOWN").otherwise(F.col("verdict")), "caveat": said}).drop("_share", "_needs")


def wet_spells(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, wet, first_wet, clear_hours: what a rain-protection answer names."""
    wet = runs.runs(rows, f"NOT ({DRY})", by).groupBy(*by).agg(F.count("*").alias("wet"), F.min("start").alias("first_wet"))
    dry = runs.runs(rows, DRY, by).groupBy(*by).agg(F.max("hours").alias("clear_hours"))
    return wet.join(dry, list(by), "full")
