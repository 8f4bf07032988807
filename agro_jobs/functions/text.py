"""Text as column functions: classifier text, tokens, vocabulary terms, skeletons, references."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The closed vocabulary of things an activity involves.
ENTITIES = {
    "sport": ("cricket", "football", "soccer", "tennis", "badminton", "volleyball", "hockey", "kabaddi", "basketball", "golf", "kho kho", "throwball", "athletics", "marathon"),
    "transport": ("bike", "bicycle", "cycle", "motorcycle", "motorbike", "scooter", "scooty", "car", "bus", "train", "auto", "autorickshaw", "rickshaw", "tractor", "two wheeler", "lorry", "truck", "jeep", "boat", "flight"),
    "crop": ("paddy", "rice", "cotton", "wheat", "maize", "corn", "groundnut", "peanut", "sugarcane", "chilli", "chili", "tomato", "onion", "potato", "soybean", "soyabean", "mustard", "bajra", "jowar", "ragi", "millet", "turmeric", "banana", "mango", "grapes", "pulses", "gram", "bengal gram", "red gram", "black gram", "castor", "sunflower", "sesame", "tobacco", "coconut", "coffee", "tea", "brinjal", "okra", "cabbage", "cauliflower", "watermelon", "papaya", "guava", "pomegranate"),
    "material": ("pesticide", "insecticide", "fungicide", "herbicide", "weedicide", "urea", "dap", "npk", "potash", "fertilizer", "fertiliser", "manure", "compost", "micronutrients", "zinc", "gypsum", "vermicompost", "neem oil", "sulphur"),
    "clothing": ("jacket", "sweater", "raincoat", "umbrella", "woollens", "sweatshirt", "hoodie", "blanket", "blankets", "bedsheet", "bedsheets", "saree", "sarees", "shoes", "white clothes", "woollen clothes", "heavy clothes", "winter clothes", "shawl"),
    "event": ("wedding", "marriage", "function", "party", "picnic", "festival", "procession", "outdoor shoot", "photo shoot", "farmers market", "exhibition", "rally", "fair", "housewarming", "get together", "reunion", "concert"),
}
#: Words and what they are rewritten to.
LEXICON = {
    "summerize": "summarize", "sumarize": "summarize", "summarise": "summarize", "summarize": "summarize", "summry": "summary", "sumary": "summary", "summerise": "summarize", "sumup": "sum up",
    "u": "you", "ur": "your", "r": "are", "pls": "please", "plz": "please", "thx": "thanks", "da": "the", "dis": "this", "n": "and", "abt": "about", "bcz": "because", "coz": "because", "wud": "would", "shud": "should", "cud": "could", "wat": "what", "wats": "whats", "hw": "how", "y": "why", "k": "ok",
    "wthr": "weather", "wether": "weather", "weathr": "weather", "wheather": "weather", "temp": "temperature", "tempature": "temperature", "temprature": "temperature", "tempreture": "temperature", "temparature": "temperature", "humidty": "humidity", "humdity": "humidity", "humididty": "humidity",
    "forcast": "forecast", "forecaste": "forecast", "forcaste": "forecast", "rian": "rain", "rainfal": "rainfall", "precipitaion": "precipitation", "sunshien": "sunshine", "sunlite": "sunlight", "cloudness": "cloudiness", "wnd": "wind", "windspeed": "wind speed", "dewpoit": "dew point", "moistur": "moisture", "moisure": "moisture", "mositure": "moisture",
    "tmrw": "tomorrow", "tmr": "tomorrow", "tomm": "tomorrow", "tomo": "tomorrow", "2moro": "tomorrow", "2morrow": "tomorrow", "tomorow": "tomorrow", "tommorow": "tomorrow", "tommorrow": "tomorrow", "tomarrow": "tomorrow", "2day": "today", "2nite": "tonight", "tonite": "tonight", "rn": "right now", "nxt": "next", "yest": "yesterday", "wk": "week", "mrng": "morning", "evng": "evening", "aftrnoon": "afternoon", "nite": "night",
}
CONTRACTIONS = {
    "what's": "what is", "whats": "what is", "whatis": "what is", "hows": "how is", "how's": "how is", "it's": "it is", "isn't": "is not", "won't": "will not", "don't": "do not", "doesn't": "does not", "can't": "can not", "i'm": "i am",
    "there's": "there is", "let's": "let us", "we're": "we are", "you're": "you are", "gonna": "going to", "wanna": "want to", "gimme": "give me",
}
#: Marks that are written in plain ones.
PLAIN_MARKS = {"\u2019": "'", "\u2018": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " ", "\u00b0": " degrees "}
#: Phrases that point back at the turn before.
PLACE_BACK = ("there", "that place", "same place", "that city", "that town", "same location", "that village", "the same", "over there", "same spot", "that area")
DATE_BACK = ("same day", "that day", "same date", "then", "that time")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once: inside f it is a variable, not an expression to be repeated for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def clean_text(c: Column) -> Column:
    """What a classifier reads: lower case, letters, digits and colons, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9:]+", " "), " +", " "))


def tokens(c: Column) -> Column:
    """Words, numbers with their separators, and single marks."""
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z]+(?:'[a-z]+)?|\d+(?:[:.]\d+)*|[^\sA-Za-z0-9])"), F.lit(1))


def _alternation() -> str:
    terms = sorted((t for ts in ENTITIES.values() for t in ts), key=lambda t: (-len(t), t))
    return r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b"


def entities(c: Column) -> Column:
    """MAP<type, spans>: vocabulary terms as written, each span once, longer ones first.

    At every place the longest term is taken, from left to right; `marks.entities` takes the longest of the whole text first.
    """
    kind = F.create_map(*[F.lit(x) for k, ts in ENTITIES.items() for t in ts for x in (t, k)])
    found = F.regexp_extract_all(c, F.lit(_alternation()), F.lit(1))
    typed = F.transform(found, lambda s: F.struct(kind[F.lower(s)].alias("type"), s.alias("span")))
    types = F.array(*map(F.lit, ENTITIES))
    def spans(t: Column) -> Column:
        once = F.array_distinct(F.transform(F.filter(typed, lambda x: x["type"] == t), lambda x: x["span"]))
        ranked = F.array_sort(F.transform(once, lambda s, i: F.struct((-F.char_length(s)).alias("size"), i.alias("i"), s.alias("span"))))
        return F.transform(ranked, lambda x: x["span"])

    per = F.transform(types, lambda t: F.struct(t, spans(t)))
    return F.map_from_entries(F.filter(per, lambda e: F.size(e["col2"]) > 0))


def skeleton(text: Column, spans: Column) -> Column:
    """The template of a text: its spans, the longest first, become @."""
    longest = F.array_sort(spans, lambda a, b: F.length(b) - F.length(a))
    cut = F.aggregate(longest, text, lambda t, s: F.replace(t, s, F.lit("@")))
    return F.trim(F.regexp_replace(F.lower(cut), r"\s+", " "))


def reference(c: Column) -> Column:
    """LOCATION, DATE or NONE: what of the turn before a text points at."""
    t = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when(t.rlike("|".join(PLACE_BACK)), "LOCATION").when(t.rlike("|".join(DATE_BACK)), "DATE").otherwise("NONE")


#: Fixed value: how a fragment that leans on the turn before begins.
LEANS = r"(?i)^\s*(and|but|ok|okay|so)?\s*(what|how)?\s*(about|abt)\b|^\s*(and|what about)\b"
#: Words that ask to compare or to be warned.
ACTIONS = ("compare", "vs", "versus", "against", "difference", "between", "alert", "warn", "notify", "remind", "ping", "watch", "tell")


def follow_up(c: Column) -> Column:
    return F.trim(c).rlike(LEANS)


def mentions_any(c: Column, words: Sequence[str]) -> Column:
    """Whether a text has one of the words, whatever stands around them."""
    said = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(" ,.?!")))
    return F.arrays_overlap(said, F.array(*map(F.lit, words)))


def normalized(c: Column) -> Column:
    """STRUCT<text, changes>: plain marks, shorthand and contractions spelled out, letters repeated more than twice squeezed, spaces set anew; with each word changed and what it became."""
    def table(words: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])

    t, short, long = F.coalesce(c, F.lit("")), table(LEXICON), table(CONTRACTIONS)
    for mark, plain in PLAIN_MARKS.items():
        t = F.replace(t, F.lit(mark), F.lit(plain))

    def rewritten(w: Column) -> Column:
        low = F.lower(w)
        squeezed = F.regexp_replace(low, r"([a-z])\1{2,}", "$1$1")
        loud = w.rlike("^[^a-z]*[A-Z][^a-z]*$") & (F.length(w) > 1)
        spelt = F.when(loud, F.upper(short[squeezed])).otherwise(short[squeezed])
        new = F.coalesce(long[low], F.when(squeezed != low, F.coalesce(spelt, squeezed)).otherwise(spelt))
        return F.struct(w.alias("said"), new.alias("new"))

    words = F.transform(F.regexp_extract_all(t, F.lit(r"([A-Za-z]+(?:'[A-Za-z]+)?|\d+(?::\d+)?|[^\sA-Za-z\d])"), F.lit(1)), rewritten)

    def told(ws: Column) -> Column:
        text = F.array_join(F.transform(ws, lambda w: F.coalesce(w.new, w.said)), " ")
        changes = F.transform(F.filter(ws, lambda w: w.new.isNotNull()), lambda w: F.concat(w.said, F.lit(">"), w.new))
        return F.struct(F.regexp_replace(text, " ([,.?!:;'])", "$1").alias("text"), changes.alias("changes"))

    return bound(words, told)


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Accents and case folded away."""
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii").str.lower().str.strip()


@F.pandas_udf(T.StringType())
def misspelt(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """One keyboard slip in a word of at least four letters, chosen by the seed: the same for the same input."""
    out = []
    for text, seed in zip(texts, seeds, strict=True):
        words = [m for m in re.finditer(r"[A-Za-z]{4,}", text or "")]
        if not words:
            out.append(text)
            continue
        m = words[seed % len(words)]
        w, i = m.group(), 1 + seed // 7 % (len(m.group()) - 2)
        slip = (w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[seed // 3 % 3]
        out.append(text[: m.start()] + slip + text[m.end() :])
    return pd.Series(out)
