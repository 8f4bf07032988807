"""How people write times: canonical forms, clock times, windows by the hour, and time spans of a text."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agro_jobs.functions import timex
from agro_jobs.functions.text import bound

#: Units that "whole", "entire", "full" or "complete" (and "the ...") name a window of.
WHOLE = {"day": "today", "week": "this week", "month": "this month", "weekend": "this weekend", "night": "tonight", "morning": "this morning", "afternoon": "this afternoon", "evening": "this evening", "year": "this month"}
#: Words for the past that name no period.
PAST_WORDS = ("history", "historical", "historic", "history data", "historical data", "past data", "past records", "previous records", "past readings", "old data", "records", "past history", "history of", "in history")
#: Other wordings and what they mean.
SAID = {
    "all day": "today", "all day long": "today", "all week": "this week", "all night": "tonight", "all month": "this month", "the rest of the day": "today", "rest of the day": "today", "rest of the week": "this week",
    "remainder of the day": "today", "throughout the day": "today", "through the day": "today", "over the day": "today", "for the day": "today", "the day": "today", "the week": "this week", "the night": "tonight",
    "rn": "now", "right now": "now", "atm": "now", "immediately": "now", "2day": "today", "todya": "today", "later today": "today", "2nite": "tonight", "tonite": "tonight", "tmrw": "tomorrow", "tmr": "tomorrow",
    "2moro": "tomorrow", "tomorow": "tomorrow", "tommorow": "tomorrow", "tommorrow": "tomorrow", "tomarrow": "tomorrow", "nxt week": "next week", "coming week": "next week", "coming weekend": "next weekend",
    "the weekend": "this weekend", "weekend": "this weekend", "day after tomorow": "day after tomorrow", "day after": "day after tomorrow", "overnight": "tonight", "mid night": "midnight",
    "abhi": "now", "aaj": "today", "ee roju": "today", "repu": "tomorrow", "raat": "tonight",
}
#: The canonical forms.
CANONICAL = (
    "now", "today", "tonight", "tomorrow", "yesterday", "day after tomorrow", "this morning", "this afternoon", "this evening", "early morning", "midnight", "tomorrow morning", "tomorrow afternoon", "tomorrow evening",
    "tomorrow night", "this week", "next week", "last week", "this weekend", "next weekend", "this month", "next month", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
)
ALIASES = {f"{the}{how} {unit}": meant for the in ("", "the ") for how in ("whole", "entire", "full", "complete") for unit, meant in WHOLE.items()} | dict.fromkeys(PAST_WORDS, "last 7 days") | SAID
KNOWN = {**dict(zip(CANONICAL, CANONICAL, strict=True)), **ALIASES}
#: Words that say which side of now a length of time lies on, and nouns for the past, longest first.
QUALIFIERS = ("last", "past", "previous", "prior", "next", "coming", "this", "these", "recent", "upcoming", "following")
HISTORY = ("historical data", "historical records", "past records", "previous records", "history data", "past data", "history", "historical")
NEAR = 0.82


def clock24(label: Column) -> Column:
    """'6:45 pm' is 18:45; null where it is no time of the day."""
    form = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"
    t = F.lower(F.trim(label))
    hour, minute, half = F.regexp_extract(t, form, 1).try_cast("int"), F.coalesce(F.regexp_extract(t, form, 2).try_cast("int"), F.lit(0)), F.regexp_extract(t, form, 3)
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


@F.pandas_udf(T.StringType())
def _nearest(texts: pd.Series) -> pd.Series:
    vocabulary = sorted(KNOWN)

    def near(text: str | None) -> str | None:
        close = difflib.get_close_matches(text, vocabulary, 1, NEAR) if text else []
        return KNOWN[close[0]] if close else text

    return texts.map(near)


def _plain(span: Column) -> Column:
    t = F.btrim(F.trim(F.regexp_replace(F.lower(F.coalesce(span, F.lit(""))), r"\s+", " ")), F.lit(" ,.?!"))
    return F.regexp_replace(t, r"^(on|at|in|by|during|for|from|around|till|until)(\s+|$)", "")


def canonical(span: Column, guess: bool = True) -> Column:
    """One form for a span however it is written; with `guess`, what is unknown takes the nearest known form."""
    table = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])

    def of(t: Column) -> Column:
        ends = F.split(t, r"\s+to\s+", 2)
        start, stop = clock24(F.get(ends, F.lit(0))), clock24(F.get(ends, F.lit(1)))
        n, unit = (F.regexp_extract(t, r"^(?:next\s+|in\s+)?(\d+)\s*(day|hour|hr|minute|min|week|month)s?$", k) for k in (1, 2))
        unit = F.when(unit == "hr", "hour").when(unit == "min", "minute").otherwise(unit)
        return (
            F.when(t == "", "").when(start.isNotNull() & stop.isNotNull(), F.concat(start, F.lit("-"), stop)).when(clock24(t).isNotNull(), clock24(t))
            .when(n != "", F.concat(F.lit("next "), n, F.lit(" "), unit, F.lit("s"))).otherwise(table[t])
        )

    known = bound(_plain(span), of)
    return F.coalesce(known, _nearest(_plain(span)) if guess else _plain(span))


def moments(said: Column, now: Column) -> Column:
    """STRUCT<start TIMESTAMP, end TIMESTAMP, label, granularity, understood>: the window of a canonical form, to the hour where it names hours.

    A range of hours that is over, and a time of the day that has passed, mean tomorrow's.
    """
    t, now = F.lower(F.trim(F.coalesce(said, F.lit("")))), now.cast("timestamp_ntz")
    today, day = F.to_date(now), r"^([\d-]{10}t[\d:]{5})\s+to\s+([\d-]{10}t[\d:]{5})$"

    def at(date: Column, hour: Column, minute: Column) -> Column:
        return F.timestamp_add("MINUTE", (hour * 60 + minute).cast("int"), date.cast("timestamp_ntz"))

    def span(start: Column, end: Column, label: Column, granularity: str, understood: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), label.alias("label"), F.lit(granularity).alias("granularity"), understood.alias("understood"))

    yes = F.lit(True)
    first, last = (F.upper(F.regexp_extract(t, day, k)).try_cast("timestamp_ntz") for k in (1, 2))
    hours = F.transform(F.regexp_extract_all(t, F.lit(r"(\d{1,2}):\d{2}"), F.lit(1)), lambda x: x.cast("int"))
    minutes = F.transform(F.regexp_extract_all(t, F.lit(r"\d{1,2}:(\d{2})"), F.lit(1)), lambda x: x.cast("int"))
    h0, h1, m0 = F.get(hours, F.lit(0)), F.get(hours, F.lit(1)), F.get(minutes, F.lit(0))
    ranged = F.date_add(today, (h1 < F.hour(now)).cast("int"))
    point = at(today, h0, m0)
    point = F.when(point < now, F.timestamp_add("DAY", F.lit(1), point)).otherwise(point)
    return bound(timex.window(t, today), lambda days: (
        F.when(first.isNotNull() & last.isNotNull(), span(first, last, F.concat(F.date_format(first, "dd MMM HH:mm"), F.lit(" to "), F.date_format(last, "HH:mm")), "hourly", yes))
        .when(t.rlike(r"^\d{1,2}:\d{2}-\d{1,2}:\d{2}$"), span(at(ranged, h0, F.lit(0)), at(ranged, F.least(h1, F.lit(23)), F.lit(59)), t, "hourly", yes))
        .when(t.rlike(r"^\d{1,2}:\d{2}$"), span(point, F.timestamp_add("HOUR", F.lit(1), point), t, "hourly", yes))
        .when(t == "early morning", span(at(today, F.lit(4), F.lit(0)), at(today, F.lit(7), F.lit(59)), t, "hourly", yes))
        .otherwise(span(days["start"].cast("timestamp_ntz"), days["end"].cast("timestamp_ntz"), days["label"], "daily", days["understood"]))
    ))


def time_spans(text: Column) -> Column:
    """Clock times, ranges of them and lengths of time, as written; the clock's first."""
    clock = r"(\b\d{1,2}(?::\d{2})?\s*(?:am|pm)(?:\s*to\s*\d{1,2}(?::\d{2})?\s*(?:am|pm))?\b)"
    length = r"(\b(?:next\s+)?\d+\s*(?:days?|hours?|hrs?|minutes?|mins?|weeks?|months?)\b)"
    return F.concat(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)), lambda s: F.trim(s)) for p in (clock, length)])


def with_qualifier(text: Column, span: Column) -> Column:
    """The span with "last", "the next" and the like before it, where the text has one."""
    quoted = F.concat(F.lit(rf"(?i)((?:the\s+)?(?:{'|'.join(QUALIFIERS)})\s+\Q"), span, F.lit(r"\E)"))
    found = F.call_function("regexp_extract", text, quoted, F.lit(0))
    return F.when(found != "", F.trim(found)).otherwise(span)


def history_noun(text: Column) -> Column:
    """The word for the past in a text, as written; null where there is none."""
    out = F.lit(None).cast("string")
    for word in reversed(HISTORY):
        found = F.regexp_extract(text, rf"(?i)\b({word})\b", 1)
        out = F.when(found != "", found).otherwise(out)
    return out


def joined_spans(text: Column, spans: Column) -> Column:
    """Spans of a text in order, joined where only a few letters or a dash lie between: a range that was cut in two."""

    def add(done: Column, nxt: Column) -> Column:
        cur = F.element_at(done, -1)
        start = F.instr(F.lower(text), F.lower(cur))
        after = F.substr(text, start + F.length(cur))
        gap = F.instr(F.lower(after), F.lower(nxt))
        between = F.trim(F.lower(F.substr(after, F.lit(1), gap - 1)))
        joins = (start > 0) & (gap > 0) & (F.length(between) <= 12) & ((between == "-") | between.rlike("^[a-z ]*$"))
        whole = F.trim(F.concat(cur, F.substr(after, F.lit(1), gap - 1 + F.length(nxt))))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))).otherwise(F.concat(done, F.array(nxt)))

    first = F.slice(spans, 1, 1)
    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.slice(spans, 2, F.size(spans)), first, add))
