"""Auditing generated answers against the figures and the verdict they were given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agro_jobs.functions.text import bound

#: Phrases that talk about the machinery, reverse a verdict, or hedge.
SCAFFOLDING = ("the data show", "the data indicate", "according to", "based on the reading", "based on the data", "as an ai", "i cannot provide", "here is the", "here's the", "in summary", "to summarize", "the provided", "the system", "the conclusion", "retrieved", "the readings show", "the figures show", "the evidence")
REVERSALS = {
    "NO": ("ideal", "good time", "good window", "go ahead", "safe to", "you can ", "perfect", "fine to", "no problem", "should be fine", "suitable"),
    "YES": ("not a good", "avoid", "hold off", "do not", "don't ", "wait until", "unsuitable", "not ideal", "not safe", "postpone"),
}
HEDGES = ("but", "though", "however", "only", "watch", "keep an eye", "if ", "tight", "not enough", "might", "may ", "risk", "short", "careful", "unless")
WEATHER_WORDS = ("rain", "sun", "temperature", "degree", "°", "mm", "hot", "cold", "warm", "wind", "humid", "storm", "cloud", "snow", "shower", "forecast", "likely")
RUN = 8


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(w.replace(".", r"\.") for w in words))


def figures(c: Column) -> Column:
    """Every number of a text, as written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))


def grounded(said: Column, given: Column) -> Column:
    """Each figure of the reply is a given one, or one rounded to the reply's own precision."""
    allowed = figures(given)

    def fits(n: Column) -> Column:
        decimals = F.length(F.element_at(F.split(n, r"\."), -1)) * n.contains(".").cast("int")
        return F.exists(allowed, lambda g: F.abs(n.cast("double") - g.cast("double")) <= 0.5 * F.pow(F.lit(10.0), -decimals))

    return F.forall(F.array_except(figures(said), allowed), fits)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9.]+)"), F.lit(1))


def grams(w: Column, n: int = RUN) -> Column:
    """The hashes of all distinct runs of n words. The words are bound once, not found anew for every run."""
    def runs(x: Column) -> Column:
        return F.when(F.size(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.xxhash64(F.slice(x, i, n))))).otherwise(F.array().cast("array<bigint>"))

    return bound(w, runs)


def echoed(said: Column, source: Column) -> Column:
    """The same words, or a run of eight in common."""
    a, b = words(said), words(source)
    return (F.size(a) > 0) & ((a == b) | F.arrays_overlap(grams(a), grams(b)))


def scaffolded(said: Column) -> Column:
    return _any(said, SCAFFOLDING)


def reverses(said: Column, verdict: Column) -> Column:
    """The opposite of the verdict, or no condition at all on a CAUTION."""
    return F.when(verdict == "CAUTION", ~_any(said, HEDGES)).when(verdict == "NO", _any(said, REVERSALS["NO"])).when(verdict == "YES", _any(said, REVERSALS["YES"])).otherwise(F.lit(False))


def invented(said: Column, given: Column) -> Column:
    """Weather or figures in a reply that its input did not have."""
    low, had = F.lower(said), F.lower(given)
    new = F.exists(F.array(*map(F.lit, WEATHER_WORDS)), lambda w: low.contains(w) & ~had.contains(w))
    return new | (F.size(F.array_except(figures(said), figures(given))) > 0)


def reason(said: Column, source: Column, given: Column, verdict: Column) -> Column:
    """Why a reply must not be shown, the first that holds; null where it may."""
    return (
        F.when(F.coalesce(said, F.lit("")) == "", "empty").when(echoed(said, source), "echo").when(scaffolded(said), "scaffolding").when(~grounded(said, given), "figures").when(reverses(said, verdict), "verdict")
    )


def first_sentence(said: Column) -> Column:
    m = F.regexp_extract(F.trim(said), r"(?s)^(.*?[?.!])", 1)
    return F.when(m != "", F.trim(m)).otherwise(F.trim(said))


def cleaned(said: Column, most: int = 600) -> Column:
    """Without thinking blocks and fences, at a bounded length."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(said, r"(?s)<think>.*?</think>", ""), "```[a-z]*", "")), 1, most)
