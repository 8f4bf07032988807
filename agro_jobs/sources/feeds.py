"""Readers and writers: forecast envelopes, archives, labelled CSV, gazetteer dumps, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agro_jobs.functions.dims import FIELDS

READING = "Date_time STRING, " + ", ".join(f"{f} DOUBLE" for f in FIELDS)
#: Archive columns and the readings they become.
ARCHIVE = {"rainfall_mm": "Rainfall", "temp_max_c": "Tmax", "temp_min_c": "Tmin", "humidity_pct": "RH", "wind_ms": "Wind_Speed", "day_length_hrs": "DayLength"}
NORMALS = {f"normal_{k}": f"Normal_{v}" for k, v in ARCHIVE.items()}
CITIES = "id BIGINT, name STRING, ascii STRING, alternates STRING, lat DOUBLE, lon DOUBLE, class STRING, code STRING, country STRING, cc2 STRING, admin1 STRING, admin2 STRING, admin3 STRING, admin4 STRING, population BIGINT, elevation STRING, dem STRING, zone STRING, modified STRING"
OTHER_NAMES = "other_id BIGINT, id BIGINT, lang STRING, name STRING, preferred STRING, short STRING, colloquial STRING, historic STRING, since STRING, until STRING"
COUNTRIES = "iso STRING, iso3 STRING, number STRING, fips STRING, country STRING, capital STRING, area STRING, population STRING, continent STRING, tld STRING, currency STRING, currency_name STRING, phone STRING, postal STRING, postal_regex STRING, languages STRING, id STRING, neighbours STRING, equivalent STRING"


def forecast(spark: SparkSession, path: str, envelope: str = "Forecast data") -> DataFrame:
    """Readings under an envelope key of JSON files, with ts and the file they came from."""
    raw = spark.read.schema(f"`{envelope}` ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in READING.split(', ')) }>>").json(path)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), F.inline(envelope))
    return rows.withColumn("ts", F.col("Date_time").try_cast("timestamp_ntz")).drop("Date_time")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """The hourly feed, whose sunshine comes in seconds."""
    return forecast(spark, path).withColumn("SunSD", F.round(F.col("SunSD") / 3600, 4))


def archive(rows: DataFrame) -> DataFrame:
    """Archive rows as readings: names mapped, day-first dates parsed (what fails stays in `rejected`), the mean temperature derived."""
    names = {k: v for k, v in (ARCHIVE | NORMALS).items() if k in rows.columns}
    out = rows.withColumnsRenamed(names).withColumn("ts", F.try_to_timestamp("date", F.lit("dd-MM-yyyy")).cast("timestamp_ntz"))
    out = out.withColumn("rejected", F.when(F.col("ts").isNull(), F.col("date"))).drop("date")
    return out.withColumn("Tavg", (F.col("Tmax") + F.col("Tmin")) / 2) if {"Tmax", "Tmin"} <= set(out.columns) else out


def archive_bulk(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """place_id and archive rows of payloads in either shape: {id: [rows]} or [{location_id, data: [rows]}]."""
    row = "STRUCT<date: STRING, " + ", ".join(f"{k}: DOUBLE" for k in ARCHIVE) + ">"
    mapped = F.from_json(column, f"MAP<STRING, ARRAY<{row}>>")
    listed = F.from_json(column, f"ARRAY<STRUCT<location_id: STRING, data: ARRAY<{row}>>>")
    is_map = F.trim(column).startswith("{")
    a = payloads.where(is_map).select(F.explode(mapped).alias("place_id", "data"))
    b = payloads.where(~is_map).select(F.inline(listed)).withColumnRenamed("location_id", "place_id")
    return archive(a.unionByName(b).select("place_id", F.inline("data")))


LOOKBACK_DAYS = 60  # fixed value: how far back the feed of recent days reaches


def served_window(archive: DataFrame, lookback: DataFrame, windows: DataFrame, as_of: Column, days: int = LOOKBACK_DAYS) -> tuple[DataFrame, DataFrame]:
    """Rows of past windows (place_id, start, end) from the archive, else from the recent days, and what each window got.

    The recent days may stand in for a place's archive only where the window starts at most `days` back; they do so for
    the whole window, and fell_back_from says so. The second table is place_id, status: archive, lookback, or error for an
    older window that the archive has nothing for.
    """
    def inside(rows: DataFrame) -> DataFrame:
        return rows.join(windows, "place_id").where(F.to_date("ts").between(F.col("start"), F.col("end")))

    first = inside(archive)
    held = first.select("place_id").distinct().withColumn("held", F.lit(True))
    asked = windows.join(held, "place_id", "left")
    near = F.col("start") >= F.date_sub(as_of, days)
    status = asked.select("place_id", F.when(F.col("held"), "archive").when(near, "lookback").otherwise("error").alias("status"))
    second = inside(lookback).join(status.where("status = 'lookback'").select("place_id"), "place_id", "left_semi")
    said = first.withColumn("fell_back_from", F.lit(None).cast("string")).unionByName(second.withColumn("fell_back_from", F.lit("archive")), allowMissingColumns=True)
    return said.drop("start", "end"), status


def preferred(sources: Sequence[tuple[str, DataFrame]], by: Sequence[str] = ("place_id", "ts")) -> DataFrame:
    """The best source's row per place and time; fell_back_from names the best source where it had none."""
    out = None
    for k, (name, rows) in enumerate(sources):
        part = rows.withColumns({"source": F.lit(name), "_p": F.lit(k)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_p")
    best = out.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.withColumn("fell_back_from", F.when(F.col("_p") > 0, F.lit(sources[0][0]))).drop("_p", "_r")


def with_daily(hours: DataFrame, days: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Hourly rows beside their own day's row, its fields prefixed."""
    d = days.select("place_id", F.to_date("ts").alias("day"), *[F.col(f).alias(f"day_{f}") for f in fields])
    return hours.withColumn("day", F.to_date("ts")).join(d, ["place_id", "day"], "left")


def labelled_csv(spark: SparkSession, path: str, schema: str, arrays: Sequence[str]) -> DataFrame:
    """Labelled text with JSON arrays in cells; an empty aggregation is RAW."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumns({c: F.from_json(c, "array<string>") for c in arrays})
    return rows.withColumn("aggregation", F.coalesce(F.nullif("aggregation", F.lit("")), F.lit("RAW"))) if "aggregation" in rows.columns else rows


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed rows without a header: rows with fewer than six cells or bad JSON go, spans not in the text go."""
    rows = spark.read.schema("text STRING, activity STRING, action STRING, aggregation STRING, location STRING, time STRING, lang STRING").option("escape", '"').csv(path)
    rows = rows.where("time IS NOT NULL").withColumns({c: F.from_json(c, "array<string>") for c in ("location", "time")}).where("location IS NOT NULL AND time IS NOT NULL")
    return rows.withColumns({c: F.expr(f"filter({c}, s -> contains(text, s))") for c in ("location", "time")})


def packed_csv(spark: SparkSession, path: str, schema: str, split: str | None = None, source: str | None = None, lang: str | None = None) -> DataFrame:
    """Packed training rows: pipes become arrays, JSON becomes arrays; split, source and language are filtered in the scan where given."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    for column, wanted in (("split", split), ("source", source), ("lang", lang)):
        rows = rows.where(F.col(column) == wanted) if wanted is not None else rows
    packed = {"variables": F.split("variables", r"\|")} if "variables" in rows.columns else {}
    return rows.withColumns(packed | {c: F.from_json(c, "array<string>") for c in ("locations", "times") if c in rows.columns})


def _dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)


def cities(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated gazetteer dump."""
    return _dump(spark, path, CITIES)


def other_names(spark: SparkSession, path: str) -> DataFrame:
    """The dump of names in other languages, codes and abbreviations."""
    return _dump(spark, path, OTHER_NAMES)


def countries(spark: SparkSession, path: str) -> DataFrame:
    """The dump of countries, whose heading is a comment."""
    return _dump(spark, path, COUNTRIES)


def vocabulary(spark: SparkSession, path: str, key: str) -> DataFrame:
    """said, meant: one map of a JSON vocabulary file, lower-cased, spaces collapsed."""
    m = spark.read.schema(f"{key} MAP<STRING, STRING>").option("multiLine", True).json(path)
    rows = m.select(F.explode(key).alias("said", "meant"))
    return rows.withColumn("said", F.trim(F.regexp_replace(F.lower("said"), r"\s+", " ")))


def log(spark: SparkSession, url: str, table: str, upper: int, parts: int = 8) -> DataFrame:
    """A log table over JDBC, read in parallel by id."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=0, upperBound=upper, numPartitions=parts).load()


def write_rows(rows: DataFrame, path: str, columns: Sequence[str], keep: Sequence[str] = ()) -> int:
    """CSV with fixed columns, never over what is there nor over a path in `keep`; returns the rows written."""
    from pyspark.sql import Observation

    if any(path.rstrip("/").endswith(k) for k in keep):
        raise ValueError(f"{path} is written by hand")
    seen = Observation()
    rows.select(*columns).observe(seen, F.count("*").alias("n")).write.mode("errorifexists").option("header", True).csv(path)
    return seen.get["n"]
