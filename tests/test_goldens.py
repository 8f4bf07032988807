"""Small hand-made cases for rules that a whole-table comparison would not pin down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from agro_jobs.functions import clean, dims, text, timex
from agro_jobs.operators import advice, audit, convo, places, quality, runs, spans, stats
from agro_jobs.sources import feeds

DAY = dt.datetime(2025, 8, 1)
RAIN = [0, 3.2, 5.1, 0, 0, 12.4, 8.0, 0, 0.1, 2.2]


def series(spark, values, field="Rainfall", step=24):
    rows = [(1, DAY + dt.timedelta(hours=step * i), float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"place_id long, ts timestamp_ntz, {field} double")


def long(spark, values, field="Rainfall"):
    return series(spark, values, field).unpivot(["place_id", "ts"], [field], "field", "value")


def test_missing_words_sentinels_and_odd_numbers(spark):
    said = ["", " NA ", "n/a", "-", "nan", "-999", "9999", "1.5", "1e2", "1.0d", "inf", None, "abc", "+.5"]
    got = spark.createDataFrame([(s,) for s in said], "v string").select(clean.number_text(F.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [None] * 7 + [1.5, 100.0] + [None] * 4 + [0.5]


def test_ten_rain_days(spark):
    r = stats.plain(long(spark, RAIN), ["place_id"]).first()
    assert (r["sum"], r["n"], r["max"], r["count"]) == (31.0, 10, 12.4, 5)
    assert r["max_at"] == DAY + dt.timedelta(days=5)
    assert r["min_at"] == DAY
    assert abs(r["intensity"] - 30.9 / 5) < 1e-9
    s = stats.spell_summary(long(spark, RAIN), ["place_id"]).first()
    assert (s["runs"], s["longest"], s["start"]) == (3, 2, DAY + dt.timedelta(days=1))


def test_sentinel_never_wins(spark):
    rows = clean.cleaned(series(spark, [*RAIN, -999]), ["Rainfall"]).unpivot(["place_id", "ts"], ["Rainfall"], "field", "value")
    assert stats.plain(rows, ["place_id"]).first()["min"] == 0


def test_bearings(spark):
    rows = long(spark, [10, 20, 350, 95, 100, 15, 200, 5], "Wind_Direction")
    m = stats.mode(rows, ["place_id"]).first()
    assert (m["point"], m["n"]) == ("N", 3)
    assert stats.distribution(rows, ["place_id"]).count() == 16


def test_gates_refuse(spark):
    assert not dims.supports("HUMIDITY", "SUM")
    assert not dims.supports("GENERAL", "AVG")
    assert dims.supports("RAIN", "LONGEST_RUN")
    assert dims.gates(spark).where("field = 'DayLength' AND statistic = 'SUM'").count() == 0


def test_missing_breaks_a_run_but_not_a_spell(spark):
    got = runs.runs(series(spark, [0, 0, None, 0, 5], step=1), dims.DRY, ["place_id"]).orderBy("start").collect()
    assert [(r["readings"], r["hours"]) for r in got] == [(2, 2.0), (1, 1.0)]
    assert stats.spell_summary(long(spark, [1, 1, None, 1, 0]), ["place_id"]).first()["longest"] == 3


def test_quality_ladder(spark):
    def status(values):
        return quality.status(series(spark, values), ["Rainfall"], ["place_id"]).first()["status"]

    assert status([1] * 10) == "OK"
    assert status([1] * 7 + [None] * 3) == "PARTIAL"
    assert status([1] * 5 + [None] * 5) == "SPARSE"


def test_spray_needs_dry_hours_after(spark):
    rows = [(1, DAY + dt.timedelta(hours=i), float(r), 2.0, 20.0, 50.0) for i, r in enumerate([0, 0, 0, 5, 5, 5, 5, 5])]
    df = spark.createDataFrame(rows, "place_id long, ts timestamp_ntz, Rainfall double, Wind_Speed double, Tmax double, RH double")
    got = {r["activity"]: r["verdict"] for r in advice.timed(df, ["place_id"]).collect()}
    assert got["SPRAY"] == "NO"
    assert got["TRAVEL"] == "YES"
    assert got["HARVEST"] == "CAUTION"


def test_dates_as_written(spark):
    said = ["11/06/2026 and 2026-06-11", "11 / 06 / 2026", "11th June 2026", "june 11, 2026", "32 jan 2026", "11 jan", None]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(timex.dates_in(F.col("t")).alias("d")).collect()
    june = dt.date(2026, 6, 11)
    assert [r.d for r in got] == [[june]] * 4 + [[]] * 3


def test_windows_and_tense(spark):
    as_of = F.lit("2026-03-10").cast("date")
    said = ["march 2022", "what may we get", "in may", "from 2010 to 2015", "next 3 days", "gibberish"]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(timex.window(F.col("t"), as_of).alias("w"), timex.tense(F.col("t"), as_of).alias("x")).collect()
    spans = [(str(r.w["start"]), str(r.w["end"]), r.w["understood"]) for r in got]
    assert spans[0] == ("2022-03-01", "2022-03-31", True)
    assert spans[1][2] is False
    assert spans[2] == ("2025-05-01", "2025-05-31", True)
    assert spans[3] == ("2010-01-01", "2015-12-31", True)
    assert spans[4] == ("2026-03-10", "2026-03-12", True)
    assert spans[5][2] is False
    assert got[0].x == "HISTORICAL"


def test_entities_longest_first(spark):
    df = spark.createDataFrame([("white clothes and Bengal gram with neem oil",)], "t string")
    got = df.select(text.entities(F.col("t")).alias("e")).first().e
    assert got == {"clothing": ["white clothes"], "crop": ["Bengal gram"], "material": ["neem oil"]}


def test_audit_rules(spark):
    cases = [
        ("about 2 mm", "1.93 mm", True), ("2.4 mm", "1.93", False), ("12.5mm", "12.5", True), ("3mm", "12.5 and 9.9", False)]
    df = spark.createDataFrame(cases, "said string, given string, ok boolean")
    assert df.where(audit.grounded(F.col("said"), F.col("given")) != F.col("ok")).count() == 0
    df = spark.createDataFrame([("a b c d e f g h i", "x a b c d e f g h y", True), ("a b c", "a b c d", False), ("A, b - c", "a b c", True)], "said string, given string, ok boolean")
    assert df.where(audit.echoed(F.col("said"), F.col("given")) != F.col("ok")).count() == 0


def test_fold_of_a_chat(spark):
    rows = [
        (1, 0, "FORECAST", "Guntur", "tomorrow", "NONE", False, False, False),
        (1, 1, "ADVICE", "Vizag", None, "NONE", True, False, True),
        (1, 2, "ADVICE", None, "friday", "LOCATION", False, False, True),
        (1, 3, "HISTORY", "A|B", None, "NONE", False, True, False),
    ]
    df = spark.createDataFrame(rows, "chat_id long, turn long, intent string, places string, time string, reference string, follow_up boolean, compares boolean, silent boolean")
    got = convo.fold(df).orderBy("turn").collect()
    assert [r.operation for r in got] == ["SET", "REPLACE", "MODIFY", "COMPARE"]
    assert [r.intent for r in got] == ["FORECAST", "FORECAST", "FORECAST", "HISTORY"]
    assert [r.places for r in got] == ["Guntur", "Vizag", "Vizag", "A|B"]
    assert got[2].time == "friday"


def test_seat_is_not_ambiguous(spark):
    hits = spark.createDataFrame(
        [(1, "guntur", 10, "Guntur", "village", "A", "Guntur"), (1, "guntur", 11, "Guntur", "village", "B", "Other"), (2, "angara", 20, "Angara", "village", "A", "X"), (2, "angara", 21, "Angara", "village", "B", "Y")],
        "span_id long, head string, id long, name string, level string, state string, district string",
    )
    got = {r.span_id: r.ambiguous for r in places.ambiguous(places.ranked(hits, F.col("head"))).collect()}
    assert got == {1: False, 2: True}


def test_codes_and_archive(spark):
    df = spark.createDataFrame([(["inABC", "gnt", "x", "toolong1", "GNT"],)], "c array<string>")
    assert df.select(places.clean_codes(F.col("c")).alias("c")).first().c == ["ABC", "GNT"]
    rows = spark.createDataFrame([("01-08-2025", 1.0, 30.0, 20.0), ("bad", 1.0, None, 20.0)], "date string, rainfall_mm double, temp_max_c double, temp_min_c double")
    got = feeds.archive(rows).collect()
    assert (got[0].Tavg, got[0].rejected, got[1].rejected) == (25.0, None, "bad")


def test_bulk_payload_shapes(spark):
    df = spark.createDataFrame([('{"7": [{"date": "01-08-2025", "rainfall_mm": 2}]}',), ('[{"location_id": "8", "data": [{"date": "02-08-2025", "rainfall_mm": 3}]}]',)], "payload string")
    assert sorted((r.place_id, r.Rainfall) for r in feeds.archive_bulk(df).collect()) == [("7", 2.0), ("8", 3.0)]


def test_forecast_files_and_writes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Forecast data": [{"Date_time": "2025-08-01T00:00:00", "Rainfall": 2.5, "SunSD": 1800}]}')
    r = feeds.hourly(spark, f"file://{tmp_path}/a.json").first()
    assert (r.Rainfall, r.SunSD, r.ts) == (2.5, 0.5, DAY)
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    assert feeds.write_rows(rows, f"file://{tmp_path}/out", ["text"]) == 1


def test_spans_and_labels(spark):
    df = spark.createDataFrame([("Guntur, Andhra Pradesh", '{"intent": "X", "variables": ["RAIN", "Y"], "places": ["guntur", "Vizag"]}'), ("a, b, c, d", None)], "s string, j string")
    rows = df.select(spans.split_span(F.col("s")).alias("p"), spans.coerced(F.col("j"), F.col("s"), ("FORECAST", "ADVICE"), ("RAIN", "WIND")).alias("c")).collect()
    assert [r.p for r in rows] == [["Guntur, Andhra Pradesh"], ["a", "b", "c", "d"]]
    assert (rows[0].c.intent, rows[0].c.variables, rows[0].c.places) == ("FORECAST", ["RAIN"], ["guntur"])
    now = F.lit("2026-03-10 06:00:00").cast("timestamp")
    got = spark.range(1).select(spans.from_duration(F.lit(3), "DAY", F.lit("the last 3 days"), now).alias("b"), spans.run_label(now, F.lit(2.0)).alias("l")).first()
    assert (str(got.b.start), str(got.b.end), got.l) == ("2026-03-07 06:00:00", "2026-03-10 06:00:00", "10 Mar 06:00 to 08:00")
    cue = spark.range(1).select(spans.activity_of(F.lit("should I spray cotton"), {"spray": "SPRAY", "spray cotton": "SPRAY", "cot": "SOW"}, F.lit(None)).alias("a")).first()
    assert cue.a == "SPRAY"
    assert spans.vocabulary_report(spark).where("shared > 0").count() == 0
