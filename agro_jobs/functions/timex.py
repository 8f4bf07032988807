"""Time wording as column functions. `as_of` is always given; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agro_jobs.functions.text import bound

SEP, ORD, YEAR = r"\s*[/.-]\s*", r"(?:\s*(?:st|nd|rd|th))?", r"(?:19|20)\d{2}"
#: The four written forms of a date; a year is required.
WRITTEN = (
    rf"\d{{1,2}}{SEP}\d{{1,2}}{SEP}{YEAR}|{YEAR}{SEP}\d{{1,2}}{SEP}\d{{1,2}}|\d{{1,2}}{ORD}\s+[a-z]{{3,9}}\.?,?\s+{YEAR}|[a-z]{{3,9}}\.?\s+\d{{1,2}}{ORD},?\s+{YEAR}"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Fixed value: the month of every spelling people use.
MONTH_OF = {w: i + 1 for names in (MONTH_NAMES, MONTHS) for i, w in enumerate(names)} | {"sept": 9}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
PAST = ("last", "past", "yesterday", "previous", "ago", "history")
#: In this order, the first that occurs decides.
BUCKETS = (
    ("day after tomorrow", "DAY_AFTER"), ("tomorrow", "TOMORROW"), ("tonight", "TONIGHT"), ("weekend", "WEEKEND"), ("morning", "MORNING"), ("afternoon", "AFTERNOON"), ("evening", "EVENING"),
    ("hour", "NOW"), ("moment", "NOW"), ("currently", "NOW"), ("now", "NOW"), ("noon", "TODAY"), ("today", "TODAY"), ("week", "WEEK"), ("month", "MONTH"),
)


def _date(written: Column) -> Column:
    """One written date: day first, unless the year is."""
    w = F.lower(written)
    numbers = F.transform(F.regexp_extract_all(w, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    month_word = F.regexp_extract(w, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", 1)
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), month_word).cast("int")
    year_first = w.rlike(rf"^{YEAR}{SEP}")
    y = F.when(year_first, F.get(numbers, F.lit(0))).otherwise(F.element_at(numbers, -1))
    m = F.when(month_word != "", by_name).otherwise(F.get(numbers, F.lit(1)))
    d = F.when(year_first, F.get(numbers, F.lit(2))).otherwise(F.get(numbers, F.lit(0)))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def dates_in(text: Column) -> Column:
    """All dates of a text, in order, once each; what is no date is dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WRITTEN})"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, _date)))


def one_date_in(text: Column) -> Column:
    found = dates_in(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def month_days(c: Column) -> Column:
    return F.day(F.last_day(c))


def bucket(canonical: Column) -> Column:
    """The coarse kind of a canonical expression."""
    t = F.lower(F.trim(F.coalesce(canonical, F.lit(""))))
    out = F.lit("NONE")
    for needle, name in reversed(BUCKETS):
        out = F.when(t.contains(needle), name).otherwise(out)
    out = F.when(t.isin(*WEEKDAYS), "WEEKDAY").otherwise(out)
    out = F.when(t.contains(":"), "CLOCK").otherwise(out)
    out = F.when(t.rlike("|".join(PAST)), "PAST").otherwise(out)
    out = F.when(t.rlike(rf"{WRITTEN}|\b{YEAR}\b"), "DATE").otherwise(out)
    return F.when(t == "", "NONE").otherwise(out)


def tense(canonical: Column, as_of: Column) -> Column:
    """CURRENT, TOMORROW, FORECAST or HISTORICAL."""
    b, first = bucket(canonical), F.get(dates_in(canonical), F.lit(0))
    year = F.regexp_extract(F.coalesce(canonical, F.lit("")), rf"\b({YEAR})\b", 1).try_cast("int")
    dated = F.when(first.isNotNull(), F.when(first < as_of, "HISTORICAL").otherwise("FORECAST")).when(year < F.year(as_of), "HISTORICAL").otherwise("FORECAST")
    return F.when(b == "DATE", dated).when(b == "PAST", "HISTORICAL").when(b == "TOMORROW", "TOMORROW").when(b.isin("NOW", "TODAY", "TONIGHT", "MORNING", "AFTERNOON", "EVENING", "CLOCK"), "CURRENT").otherwise("FORECAST")


def window(canonical: Column, as_of: Column) -> Column:
    """STRUCT<start DATE, end DATE, label, understood>: the days an expression covers; nothing said is the next seven days.

    What is not understood gets those days too, with its own wording as the label.
    """
    said = F.lower(F.trim(F.coalesce(canonical, F.lit(""))))
    number = F.create_map(*[F.lit(x) for kv in MONTH_OF.items() for x in kv])
    # "may" and "march" are months only after a preposition; of a text's month words the first that may be one counts.
    taken = {w: said.rlike(rf"\b(?:last|in|of|during|for)\s+{w}\b") for w in ("may", "march")}
    words = F.filter(F.regexp_extract_all(said, F.lit("([a-z]+)"), F.lit(1)), lambda w: number[w].isNotNull() & F.when(w == "may", taken["may"]).when(w == "march", taken["march"]).otherwise(True))
    word = F.get(words, F.lit(0))
    pair = [F.regexp_extract(said, rf"({YEAR})\s*(?:to|-|and|until)\s*({YEAR})", k).try_cast("int") for k in (1, 2)]
    dated, month_word = rf"([a-z]+)\s+({YEAR})", F.regexp_extract(said, rf"([a-z]+)\s+({YEAR})", 1)
    read = F.struct(
        said.alias("t"), dates_in(said).alias("found"), F.least(*pair).alias("first"), F.greatest(*pair).alias("last"), F.regexp_extract(said, rf"\b({YEAR})\b", 1).try_cast("int").alias("year"),
        number[month_word].alias("month"), F.regexp_extract(said, dated, 2).try_cast("int").alias("of"), F.regexp_extract(said, dated, 0).alias("month_said"), word.alias("word"), number[word].alias("bare"),
    )
    return bound(read, lambda r: _ladder(r, as_of))


def _told(start: Column, end: Column) -> Column:
    return F.when(start == end, F.date_format(start, "dd MMM yyyy")).otherwise(F.concat(F.date_format(start, "dd MMM"), F.lit(" to "), F.date_format(end, "dd MMM yyyy")))


def _ladder(r: Column, as_of: Column) -> Column:
    """`window` of a text whose dates, years and months are known; the first case that holds decides."""
    t, found = r["t"], r["found"]

    def span(a: Column, b: Column, label: Column, understood: bool = True) -> Column:
        return F.struct(a.alias("start"), b.alias("end"), label.alias("label"), F.lit(understood).alias("understood"))

    def day(year: Column, month: Column | int, of: int) -> Column:
        return F.make_date(year, F.lit(month) if isinstance(month, int) else month, F.lit(of))

    n = F.regexp_extract(t, r"^next (\d+) days$", 1).try_cast("int")
    week, low, high = F.date_add(as_of, 6), F.array_min(found), F.array_max(found)
    whole, recent = day(r["of"], r["month"], 1), day(F.year(as_of) - (r["bare"] > F.month(as_of)).cast("int"), r["bare"], 1)
    return (
        F.when(t == "", span(as_of, week, F.lit("next few days")))
        .when(t == "today", span(as_of, as_of, F.lit("today")))
        .when(n.isNotNull(), span(as_of, F.date_add(as_of, n - 1), t))
        .when(F.size(found) >= 1, span(low, high, _told(low, high)))
        .when(r["first"].isNotNull(), span(day(r["first"], 1, 1), day(r["last"], 12, 31), F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))))
        .when(r["month"].isNotNull(), span(whole, F.last_day(whole), r["month_said"]))
        .when(t.contains("decade"), span(F.date_sub(as_of, 3653), as_of, F.lit("the last decade")))
        .when(r["year"].isNotNull(), span(day(r["year"], 1, 1), day(r["year"], 12, 31), r["year"].cast("string")))
        .when(r["word"].isNotNull(), span(recent, F.least(F.last_day(recent), as_of), F.concat_ws(" ", r["word"], F.year(recent).cast("string"))))
        .otherwise(span(as_of, week, t, False))
    )


def span_days(w: Column) -> Column:
    return F.greatest(F.datediff(w["end"], w["start"]) + 1, F.lit(1))


def grains(days: Column) -> Column:
    """The grains worth offering for a span of so many days."""

    def of(*names: str) -> Column:
        return F.array(*map(F.lit, names))

    return F.when(days <= 10, of("hourly", "daily")).when(days <= 31, of("daily")).when(days <= 366, of("daily", "weekly", "monthly")).when(days <= 3653, of("monthly", "yearly")).otherwise(of("yearly"))


def rows_for(days: Column, grain: str) -> Column:
    rate = {"hourly": 24.0, "daily": 1.0, "weekly": 1 / 7, "monthly": 1 / 30.4, "yearly": 1 / 365.25}[grain]
    return F.greatest(F.floor(days * F.lit(rate)), F.lit(1))


def mentions_time(text: Column) -> Column:
    words = "|".join([n for n, _ in BUCKETS] + list(WEEKDAYS) + list(PAST) + list(MONTH_NAMES))
    return F.lower(text).rlike(rf"\b(?:{words})|\d{{1,2}}\s*(?:am|pm|:)|\b{YEAR}\b")
