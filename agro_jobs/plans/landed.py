"""Round trips through landed files: written from the tables, read by the readers of `sources.feeds`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agro_jobs.plans.registry import query
from agro_jobs.plans.views import ansi, table, view
from agro_jobs.sources import feeds
from agro_jobs.sources.shared import shared


def _envelopes(spark, d, key: str = "Forecast data", sun: str = "SunSD") -> str:
    """JSON files as a feed lands them: a day of a place in each line."""
    at = shared(spark)
    reading = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Date_time"), "Rainfall", "Tmax", F.expr(sun).alias("SunSD"))
    days = view(spark, d, "readings").groupBy("place_id", F.to_date("ts").alias("day")).agg(F.collect_list(reading).alias(key))
    days.select(f"`{key}`").write.json(at)
    return at


@query("read_forecast", f"WITH {ansi('readings')} SELECT ts, Rainfall, Tmax, SunSD FROM readings")
def _(spark, d):
    return feeds.forecast(spark, _envelopes(spark, d)).select("ts", "Rainfall", "Tmax", "SunSD")


@query("read_lookback", f"WITH {ansi('readings')} SELECT ts, Rainfall FROM readings")
def _(spark, d):
    return feeds.forecast(spark, _envelopes(spark, d, "historical_data"), "historical_data").select("ts", "Rainfall")


@query("read_hourly", f"WITH {ansi('readings')} SELECT ts, round(SunSD * 3000 / 3600, 4) AS SunSD FROM readings")
def _(spark, d):
    return feeds.hourly(spark, _envelopes(spark, d, sun="SunSD * 3000")).select("ts", "SunSD")


@query(
    "read_archive",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS ts, CASE WHEN l_orderkey % 97 = 0 THEN 'unknown' END AS rejected, l_quantity AS Rainfall, (l_tax * 100 + l_discount * 100) / 2 AS Tavg, l_quantity + 1 AS Normal_Rainfall FROM lineitem",
)
def _(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 97 = 0 THEN 'unknown' ELSE date_format(l_shipdate, 'dd-MM-yyyy') END AS date", "l_quantity AS rainfall_mm", "l_tax * 100 AS temp_max_c", "l_discount * 100 AS temp_min_c", "l_quantity + 1 AS normal_rainfall_mm"
    )
    return feeds.archive(rows).select("l_orderkey", "l_linenumber", "ts", "rejected", "Rainfall", "Tavg", "Normal_Rainfall")


@query("read_archive_bulk", "SELECT CAST(s_suppkey AS VARCHAR) AS place_id, CAST(CAST(DATE '2024-02-01' + CAST(k AS INT) AS DATE) AS TIMESTAMP) AS ts, CAST(s_suppkey * 10 + k AS DOUBLE) AS Rainfall FROM supplier CROSS JOIN (SELECT unnest(range(0, 3)) AS k)")
def _(spark, d):
    row = "named_struct('date', date_format(date_add(DATE '2024-02-01', k), 'dd-MM-yyyy'), 'rainfall_mm', CAST(s_suppkey * 10 + k AS DOUBLE))"
    data = f"transform(sequence(0, 2), k -> {row})"
    both = f"CASE WHEN s_suppkey % 2 = 0 THEN to_json(map(CAST(s_suppkey AS STRING), {data})) ELSE to_json(array(named_struct('location_id', CAST(s_suppkey AS STRING), 'data', {data}))) END AS payload"
    return feeds.archive_bulk(table(spark, d, "supplier").selectExpr(both)).select("place_id", "ts", "Rainfall")


def _csv(rows: DataFrame, header: bool = True) -> str:
    at = shared(rows.sparkSession)
    rows.write.option("header", header).option("escape", '"').csv(at)
    return at


@query("read_labelled_csv", "SELECT 'say \"' || p_name || '\", then' AS text, p_brand || ',' || p_type AS locations, CASE WHEN p_partkey % 3 = 0 THEN 'RAW' ELSE 'SUM' END AS aggregation FROM part")
def _(spark, d):
    rows = table(spark, d, "part").selectExpr("'say \"' || p_name || '\", then' AS text", "to_json(array(p_brand, p_type)) AS location", "CASE WHEN p_partkey % 3 > 0 THEN 'SUM' END AS aggregation")
    return feeds.labelled_csv(spark, _csv(rows), "text STRING, location STRING, aggregation STRING", ["location"]).select("text", F.array_join("location", ",").alias("locations"), "aggregation")


@query("read_seeds", "SELECT p_name || ' in ' || p_brand AS text, p_brand AS places FROM part WHERE p_partkey % 5 > 1")
def _(spark, d):
    rows = table(spark, d, "part").selectExpr("p_name || ' in ' || p_brand AS text", "'SPRAY' AS activity", "'ADVICE' AS action", "'RAW' AS aggregation", "CASE WHEN p_partkey % 5 = 0 THEN '[broken' ELSE to_json(array(p_brand, 'nowhere at all')) END AS location", "CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE '[]' END AS time", "'en' AS lang")
    return feeds.seeds(spark, _csv(rows, False)).select("text", F.array_join("location", ",").alias("places"))


@query("read_packed", "SELECT doc_id AS row_id, source, 'RAIN,WIND' AS variables, lang AS places FROM documents WHERE doc_id % 10 < 7 AND lang = 'en' AND source IN (SELECT min(source) FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.selectExpr("doc_id AS row_id", "CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split", "source", "lang", "'RAIN|WIND' AS variables", "to_json(array(lang)) AS locations")
    first = docs.agg(F.min("source")).first()[0]
    got = feeds.packed_csv(spark, _csv(rows), "row_id LONG, split STRING, source STRING, lang STRING, variables STRING, locations STRING", split="train", source=first, lang="en")
    return got.select("row_id", "source", F.array_join("variables", ",").alias("variables"), F.array_join("locations", ",").alias("places"))


@query("write_labelled", "SELECT p_name AS text, p_brand AS intent, count(*) OVER () AS n FROM part")
def _(spark, d):
    at = shared(spark)
    n = feeds.write_rows(table(spark, d, "part").selectExpr("p_type AS more", "p_brand AS intent", "p_name AS text"), at, ["text", "intent"], keep=["by_hand.csv"])
    return spark.read.schema("text STRING, intent STRING").option("header", True).csv(at).withColumn("n", F.lit(n).cast("long"))


def _tsv(rows: DataFrame, columns: list[str]) -> str:
    """Tab-separated lines with a comment line in every file."""
    at = shared(rows.sparkSession)
    lines = rows.select(F.concat_ws("\t", *[F.coalesce(F.expr(c).cast("string"), F.lit("")) for c in columns]).alias("line"))
    lines.unionByName(rows.sparkSession.createDataFrame([("# a comment\twith a tab",)], "line string")).write.text(at)
    return at


@query("read_cities", "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS country, c_custkey * 7919 % 100003 AS population FROM customer")
def _(spark, d):
    columns = ["c_custkey", "c_name", "c_name", "'a,\"b'", "1.5", "2.5", "'P'", "'PPL'", "c_nationkey", *["''"] * 5, "c_custkey * 7919 % 100003", *["''"] * 4]
    return feeds.cities(spark, _tsv(table(spark, d, "customer"), columns)).select("id", "name", "country", "population")


@query("read_other_names", "SELECT p_partkey AS other_id, p_size AS id, CASE WHEN p_partkey % 2 = 0 THEN 'abbr' ELSE 'en' END AS lang, p_name AS name FROM part")
def _(spark, d):
    columns = ["p_partkey", "p_size", "CASE WHEN p_partkey % 2 = 0 THEN 'abbr' ELSE 'en' END", "p_name", *["''"] * 6]
    return feeds.other_names(spark, _tsv(table(spark, d, "part"), columns)).select("other_id", F.col("id").cast("int").alias("id"), "lang", "name")


@query("read_countries", "SELECT left(n_name, 2) AS iso, n_name AS country FROM nation")
def _(spark, d):
    columns = ["left(n_name, 2)", "'X'", "'1'", "''", "n_name", *["''"] * 14]
    return feeds.countries(spark, _tsv(table(spark, d, "nation"), columns)).select("iso", "country")


@query("read_vocabulary", "SELECT lower(n_name) || ' of old' AS said, r_name AS meant FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    at = shared(spark)
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("n_name", F.lit("   Of  old ")).alias("said"), "r_name")
    pairs.agg(F.map_from_entries(F.collect_list(F.struct("said", "r_name"))).alias("aliases")).write.json(at)  # a vocabulary is one small file
    return feeds.vocabulary(spark, at, "aliases")
