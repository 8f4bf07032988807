"""From what was asked to what is read: columns, statistics, defaults, and the shape of the answer."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agro_jobs.functions.dims import FIELD_CAP, FULL_CAP, FULL_FIELDS, MINIMAL_FIELDS, VARIABLE_FIELDS
from agro_jobs.operators.stats import bearing

EXACT = "decimal(18,4)"
ADDITIVE = ("Rainfall", "SunSD")
#: The words that support a statistic.
CUES = {
    "SUM": ("total", "cumulative", "sum", "add up", "overall", "how much", "altogether"), "AVG": ("average", "avg", "mean", "typical", "on average"),
    "MAX": ("peak", "highest", "max", "hottest", "strongest", "worst", "how high", "how hot", "warmest", "most"), "MIN": ("lowest", "minimum", "min", "coldest", "weakest", "how low", "least"),
    "TREND": ("start", "starts", "rise", "rising", "drop", "dropping", "fall", "falling", "change", "changing", "increase", "increasing", "decrease", "stop", "pick up", "when will", "what time"),
    "MEDIAN": ("median", "middle", "midpoint"), "RANGE": ("range", "spread", "vary", "varies", "variation", "lowest to highest", "low to high", "swing"),
    "STDDEV": ("steady", "consistent", "variable", "variability", "standard deviation", "how much does it move", "stable"), "CHANGE": ("change", "changed", "difference", "how much has", "moved", "start to end", "since"),
    "CUMULATIVE": ("running total", "accumulated", "accumulating", "building up", "so far", "cumulative", "adding up"), "COUNT": ("how many", "count", "number of", "how many days", "how many hours", "how many times"),
    "RUN_COUNT": ("how many spells", "spells", "bursts", "separate", "how many periods", "how many times"), "FREQUENCY": ("how often", "frequency", "frequently", "what share", "percentage of time", "share of the time", "how regular"),
    "INTENSITY": ("intensity", "how heavy", "how hard", "how intense", "when it comes"), "MODE": ("mostly", "dominant", "prevailing", "usually from", "mainly from", "most common direction", "where does it come from"),
    "DISTRIBUTION": ("breakdown", "spread across", "rose", "distribution", "by direction", "each direction"),
    "PEAK_DATE": ("hottest", "wettest", "windiest", "sunniest", "muggiest", "warmest", "highest", "peak", "worst", "most", "at its peak", "at its highest", "largest day", "longest day", "biggest"),
    "LOW_DATE": ("coldest", "driest", "calmest", "coolest", "quietest", "least", "lowest", "at its lowest", "cloudiest"),
    "PEAK_PERIOD": ("which stretch", "heaviest", "wettest period", "wettest stretch", "at its heaviest", "worst period"), "LOW_PERIOD": ("which stretch", "driest", "lightest", "driest period", "quietest period", "calmest period"),
    "LONGEST_RUN": ("unbroken", "stretch", "spell", "spells", "run of", "in a row", "back to back", "consecutive", "continuous", "how long is"),
}
#: The words that name a statistic where none was predicted, in this order.
PROMOTES = {
    "SUM": ("total", "cumulative", "sum", "add up", "altogether"), "AVG": ("average", "avg", "mean", "on average"),
    "PEAK_DATE": ("largest day", "longest day", "biggest day", "hottest day", "wettest day", "windiest day", "sunniest day", "warmest day"), "LOW_DATE": ("shortest day", "coldest day", "driest day", "calmest day", "coolest day"),
}
#: Words that name one column of a variable.
NAMED = (("day length", "DayLength"), ("daylight", "DayLength"), ("direction", "Wind_Direction"), ("gust", "Wind_max"), ("maximum humidity", "RH_max"), ("minimum humidity", "RH_min"))
#: The column a statistic of a variable reads, where it isn't the middle one.
COLUMN_FOR = {("TEMPERATURE", "MAX"): "Tmax", ("TEMPERATURE", "MIN"): "Tmin", ("HUMIDITY", "MAX"): "RH_max", ("HUMIDITY", "MIN"): "RH_min", ("WIND", "MAX"): "Wind_max"}
MIDDLE = {"TEMPERATURE": "Tavg", "RAIN": "Rainfall", "HUMIDITY": "RH", "WIND": "Wind_Speed", "CLOUD": "Lowcloud", "SUNSHINE": "SunSD", "UV": "SunSD", "SOIL_MOISTURE": "Soilm10", "SOIL_TEMPERATURE": "Soilt10"}
#: Default windows of an activity that named no period.
DEFAULT_WINDOW = {"RAIN_PROTECTION": "today", "SUN_PROTECTION": "today", "CLOTHING": "today", "OUTDOOR_ACTIVITY": "today", "TRAVEL": "today", "DRYING": "today", "SPRAY": "next 2 days", "FERTILIZE": "next 3 days", "IRRIGATE": "next 3 days", "HARVEST": "next 5 days", "SOW": "next 7 days"}


def variable_fields(spark: SparkSession) -> DataFrame:
    """variable, field, pos."""
    return spark.createDataFrame([(v, f, i) for v, fs in VARIABLE_FIELDS.items() for i, f in enumerate(fs)], "variable string, field string, pos int")


def fields_for(asked: DataFrame, most: int = FIELD_CAP, detail: Column | None = None) -> DataFrame:
    """id, fields: the columns of an array of variables in asked order, once each, at most so many; Tavg where none is known.

    detail is NORMAL unless it is given; FULL has wider columns and a cap of its own, as what it leaves out can't be told from what is missing.
    """
    def table(fields: dict[str, tuple[str, ...]]) -> Column:
        return F.create_map(*[x for v, fs in fields.items() for x in (F.lit(v), F.array(*map(F.lit, fs)))])

    width = F.lit("NORMAL") if detail is None else F.coalesce(detail, F.lit("NORMAL"))
    dims = {"FULL": table(FULL_FIELDS), "MINIMAL": table(MINIMAL_FIELDS), "NORMAL": table(VARIABLE_FIELDS)}
    listed = F.transform("variables", lambda v: F.coalesce(F.when(width == "FULL", dims["FULL"][v]).when(width == "MINIMAL", dims["MINIMAL"][v]).otherwise(dims["NORMAL"][v]), F.array().cast("array<string>")))
    got = F.slice(F.array_distinct(F.flatten(listed)), F.lit(1), F.when(width == "FULL", F.lit(max(most, FULL_CAP))).otherwise(F.lit(most)))
    return asked.select("id", F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("Tavg"))).alias("fields"))


def unservable(fields: Column, source: Sequence[str]) -> Column:
    return F.array_sort(F.array_except(fields, F.array(*map(F.lit, source))))


def pairs(asked: DataFrame, gates: DataFrame, most: int = 6) -> DataFrame:
    """id, variable, statistic, pos: every variable with every statistic that suits it, in asked order, at most so many."""
    cross = asked.select("id", F.posexplode("variables").alias("v", "variable"), "statistics").select("id", "v", "variable", F.posexplode("statistics").alias("s", "statistic"))
    ok = cross.join(F.broadcast(gates.select("variable", "statistic").distinct()), ["variable", "statistic"], "left_semi")
    pos = F.row_number().over(Window.partitionBy("id").orderBy("v", "s"))
    return ok.select("id", "variable", "statistic", pos.alias("pos")).where(F.col("pos") <= most)


def variable_of(field: Column) -> Column:
    """The variable a column belongs to; the last one that lists it."""
    out = F.lit(None).cast("string")
    for v, fs in VARIABLE_FIELDS.items():
        if v != "GENERAL":
            out = F.when(field.isin(*fs), v).otherwise(out)
    return out


def spoken_statistic(text: Column, predicted: Column) -> Column:
    """The statistic that the words support: a predicted one needs a word for it, else it is RAW; RAW gives way only to a word that can mean nothing else."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def says(words: Sequence[str]) -> Column:
        return low.rlike(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)")

    named = F.lit("RAW")
    for kind, words in reversed(PROMOTES.items()):
        named = F.when(says(words), kind).otherwise(named)
    kept = F.lit("RAW")
    for kind, words in CUES.items():
        kept = F.when((predicted == kind) & says(words), kind).otherwise(kept)
    return F.when(F.coalesce(predicted, F.lit("RAW")) == "RAW", named).otherwise(kept)


def column_named(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, c in reversed(NAMED):
        out = F.when(F.lower(text).contains(word), c).otherwise(out)
    return out


def with_defaults(asked: DataFrame) -> DataFrame:
    """asked with window, statistic filled in: spoken before profile before default."""
    by_activity = F.create_map(*[F.lit(x) for kv in DEFAULT_WINDOW.items() for x in kv])
    past = F.when((F.col("intent") == "HISTORY") & (F.col("days") > 7), F.when(F.col("variable").isin("RAIN", "SUNSHINE"), "SUM").otherwise("AVG"))
    return asked.withColumns({"window": F.coalesce("window", by_activity[F.col("activity")], F.lit("next 7 days")), "statistic": F.coalesce("statistic", past, F.lit("RAW"))})


def formatted(field: str, c: Column) -> Column:
    """A reading as a table cell."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), r"0+$", ""), r"\.$", "")
    if field == "Wind_Direction":
        plain = F.concat(F.format_string("%.0f° ", c), bearing(c))
    if field == "Lowcloud":
        plain = F.concat(F.format_string("%.0f", c * 100), F.lit("%"))
    return F.when(c.isNull(), "-").otherwise(plain)


NEXT_HOURS, NEXT_DAYS = 12, 7  # fixed values: rows where no time is understood


def selected(rows: DataFrame, windows: DataFrame, by: str, most: int = NEXT_DAYS, as_of: Column | None = None) -> DataFrame:
    """Rows inside each group's window (start, end dates); the first rows where that leaves none and no exact day was asked for.

    With as_of, a window that does not look back loses the rows before it (unless nothing is left then). windows may carry
    `understood`: where that is false the first hours or days are taken (hours, if any of a group's first 24 rows is off midnight).
    """
    day = F.to_date("ts")
    both = rows.join(windows, by)
    if "understood" not in windows.columns:
        both = both.withColumn("understood", F.lit(True))
    w = Window.partitionBy(by)
    both = both.withColumns({"r": F.row_number().over(w.orderBy("ts")), "known": F.coalesce("understood", F.lit(False))})
    # What is over, where the window looks ahead and something is still to come.
    late = F.lit(False) if as_of is None else (F.col("start") >= as_of) & (day < as_of) & F.max(day >= as_of).over(w)
    both = both.withColumns({"hourly": F.max((F.col("r") <= 24) & (F.date_format("ts", "HH") != "00")).over(w), "late": late & F.col("known")})
    both = both.withColumn("inside", day.between(F.col("start"), F.col("end")) & ~F.col("late"))
    both = both.withColumns({"any": F.max("inside").over(w), "left": F.sum((~F.col("late")).cast("int")).over(w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))})
    floor = F.when(F.col("hourly"), NEXT_HOURS).otherwise(NEXT_DAYS)
    known = F.col("inside") | (~F.col("any") & (F.col("start") != F.col("end")) & ~F.col("late") & (F.col("left") <= most))
    return both.where(F.when(F.col("known"), known).otherwise(F.col("r") <= floor)).select(*rows.columns)


def headline(rows: DataFrame, by: Sequence[str], field: str, statistic: str) -> DataFrame:
    """by, figure: the total if one was asked for and the field adds up, else the mean."""
    total = F.sum(F.col(field).cast(EXACT)).cast("double")
    return rows.groupBy(*by).agg((total if statistic == "SUM" and field in ADDITIVE else total / F.nullif(F.count(field), F.lit(0))).alias("figure"))


def digest(rows: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """by, field, low, high, mean."""
    long = rows.unpivot([*by, "ts"], list(fields), "field", "value").where("value IS NOT NULL")
    return long.groupBy(*by, "field").agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("value").cast(EXACT)).cast("double") / F.count("*")).alias("mean"))


def shape(fields: Column, statistic: Column, hourly: Column, places: Column, days: Column) -> Column:
    """Which picture fits."""
    n = F.size(fields)
    rose = F.array_contains(fields, "Wind_Direction") & statistic.isin("MODE", "DISTRIBUTION")
    band = F.array_contains(fields, "Tmin") & F.array_contains(fields, "Tmax")
    return (
        F.when(rose, "rose").when(statistic == "CUMULATIVE", "running").when(hourly & (days >= 2) & (n == 1), "grid").when(places > 1, "lines").when(band & (places == 1), "band")
        .when(F.array_contains(fields, "Rainfall") & (n > 1), "combo").when(F.array_contains(fields, "Rainfall"), "bars").otherwise("line")
    )


def disagreements(answers: DataFrame, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """question, field: where models that answered differ; lists are compared as sets, case ignored."""
    def of(f: str) -> Column:
        return F.array_sort(F.transform(f, F.lower)).cast("string") if f in lists else F.col(f).cast("string")

    per = answers.groupBy("question").agg(F.count("*").alias("models"), *[F.countDistinct(of(f)).alias(f) for f in fields])
    return per.where("models >= 2").unpivot(["question"], list(fields), "field", "kinds").where("kinds > 1").select("question", "field")


def table_rows(rows: DataFrame, by: Sequence[str], fields: Sequence[str], hourly: bool) -> DataFrame:
    """by, time and a cell for every field, as a table shows them."""
    return rows.select(*by, F.date_format("ts", "dd MMM HH:mm" if hourly else "dd MMM").alias("time"), *[formatted(f, F.col(f)).alias(f) for f in fields])


def summary(rows: DataFrame, by: Sequence[str], field: str, name: str, unit: str) -> DataFrame:
    """by, said: one sentence on a series; of rain how often and how much at once, of anything else its range and mean."""
    v = F.col(field)
    agg = rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), (F.sum(v.cast(EXACT)).cast("double") / F.count(v)).alias("mean"), F.count_if(v >= 1.0).alias("wet"))

    def one(c: str) -> Column:
        return F.format_string("%.1f", F.bround(c, 1))

    wet = F.when(F.col("wet") == 0, F.concat(F.lit("little to no rain, at most "), one("high"), F.lit(f"{unit} in a reading"))).otherwise(
        F.concat(F.lit("rain on "), F.col("wet").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" readings, up to "), one("high"), F.lit(f"{unit} in one"))
    )
    ranged = F.concat(F.lit(f"{name} "), one("low"), F.lit("-"), one("high"), F.lit(f"{unit} (avg "), one("mean"), F.lit(f"{unit})"))
    single = F.concat(F.lit(f"{name} "), one("high"), F.lit(unit))
    said = F.when(F.col("n") == 0, f"no {name} values").when(F.col("n") == 1, single).otherwise(wet if field == "Rainfall" else ranged)
    return agg.select(*by, said.alias("said"))


def reduced(long: DataFrame, by: Sequence[str], asked: DataFrame, gates: DataFrame) -> DataFrame:
    """by, id, pos, variable, field, statistic, value: all that a question asks for, in its order, each on its own column.

    asked: id, variables, statistics (arrays), text. A column that the text names is read; else the
    statistic chooses among the variable's: the high one for a maximum, the low one for a minimum,
    the middle or only one otherwise. What means nothing has no row.
    """
    from agro_jobs.operators.stats import gated

    each = pairs(asked, gates).join(asked.select("id", column_named(F.col("text")).alias("named")), "id")
    suits = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s"), F.lit(f).alias("f")) for (v, s), f in sorted(COLUMN_FOR.items())])
    chosen = F.get(F.filter(suits, lambda x: (x.v == F.col("variable")) & (x.s == F.col("statistic"))), F.lit(0)).f
    plain = F.create_map(*[F.lit(x) for kv in MIDDLE.items() for x in kv])[F.col("variable")]
    each = each.withColumn("field", F.coalesce("named", chosen, plain)).drop("named")
    wanted = each.select("variable", "statistic").distinct()
    values = gated(long, by, wanted, gates)
    return values.join(each, ["variable", "statistic", "field"]).select(*by, "id", "pos", "variable", "field", "statistic", "value")
