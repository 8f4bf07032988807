"""Noise as people type it, drawn by hashes of the row's key; annotated spans stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agro_jobs.functions.text import bound
from agro_jobs.functions.timewords import canonical
from agro_jobs.operators.generate import pick
from agro_jobs.sources.shared import written

#: Percent of rows with a slip, with loose grammar, of times that are misspelt; and of two slips where there are three words.
TYPOS, GRAMMAR, TIMES, TWO = 34, 18, 20, 35
#: Words people leave out, and words they add.
DROPPABLE = ("the", "a", "an", "is", "are", "will", "be", "do", "does", "of", "about", "any", "there", "me", "to", "it", "in", "for", "and")
FILLERS = ("pls", "plz", "kindly", "asap", "sir", "bro", "urgent", "quickly")
ENDINGS = ("", "", "??", "?!", "..", " ?")
OPENER = r"(?i)^(what is|whats|what's|how is|can you tell me|i want to know)\s+"
#: The keys around a key.
NEIGHBOURS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko", "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk",
    "n": "bhjm", "o": "iplk", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}


def slip(word: Column, *key: Column, seed: int = 0) -> Column:
    """One slip of the keyboard inside a word of at least three letters: a letter lost, two swapped, one doubled, or a neighbouring key."""
    near = F.create_map(*[F.lit(x) for kv in NEIGHBOURS.items() for x in kv])

    def of(w: Column) -> Column:
        i = (pick(F.char_length(w) - 2, *key, seed=seed) + 1).cast("int")
        u = pick(F.lit(100), *key, seed=seed + 1)
        head, letter, rest = F.substring(w, F.lit(1), i), F.substring(w, i + 1, F.lit(1)), F.substring(w, i + 2, F.char_length(w))
        keys = near[F.lower(letter)]
        other = F.substring(keys, (pick(F.char_length(keys), *key, seed=seed + 2) + 1).cast("int"), F.lit(1))
        swapped = F.concat(head, F.substring(rest, 1, 1), letter, F.substring(rest, F.lit(2), F.char_length(w)))
        return F.when(u < 28, F.concat(head, rest)).when(u < 50, swapped).when(u < 66, F.concat(head, letter, letter, rest)).otherwise(F.concat(head, F.coalesce(other, letter), rest))

    return F.when(F.char_length(word) >= 3, bound(word, of)).otherwise(word)


def free_words(text: Column, spans: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, word>>: matches of the pattern that touch no span's first occurrence; start counts from 0."""
    kept = F.filter(F.transform(spans, lambda s: F.struct(F.call_function("locate", s, text).alias("at"), F.char_length(s).alias("size"))), lambda p: p["at"] > 0)
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("word"))
    none = F.array().cast("array<struct<start:int,word:string>>")

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        found = F.when(p["word"].isNotNull(), F.concat(acc["found"], F.array(F.struct(start.alias("start"), p["word"].alias("word"))))).otherwise(acc["found"])
        return F.struct((start + F.coalesce(F.char_length(p["word"]), F.lit(0))).alias("at"), found.alias("found"))

    def outside(found: Column, protected: Column) -> Column:
        return F.filter(found, lambda w: ~F.exists(protected, lambda p: (w["start"] < p["at"] - 1 + p["size"]) & (p["at"] - 1 < w["start"] + F.char_length(w["word"]))))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]
    return bound(F.struct(found.alias("found"), kept.alias("kept")), lambda x: outside(x["found"], x["kept"]))


def _replaced(text: Column, at: Column, new: Column) -> Column:
    """text with the word `at` (start, word) replaced."""
    return F.concat(F.substring(text, F.lit(1), at["start"]), new, F.substring(text, at["start"] + F.char_length(at["word"]) + 1, F.char_length(text)))


def _clean(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" ,"))


def loose_grammar(text: Column, spans: Column, *key: Column, seed: int = 0) -> Column:
    """A small word left out, other marks at the end, a filler before or after, or no opening words."""
    u = pick(F.lit(100), *key, seed=seed)

    def lose(ws: Column) -> Column:
        return F.when(F.size(ws) > 0, _replaced(text, F.get(ws, pick(F.size(ws), *key, seed=seed + 1).cast("int")), F.lit(""))).otherwise(text)

    small = F.filter(free_words(text, spans, r"\b[a-zA-Z]+\b"), lambda w: F.lower(w["word"]).isin(*DROPPABLE))
    bare = F.rtrim(text, F.lit("?. "))
    ending = F.get(F.array(*map(F.lit, ENDINGS)), pick(F.lit(len(ENDINGS)), *key, seed=seed + 2).cast("int"))
    filler = F.get(F.array(*map(F.lit, FILLERS)), pick(F.lit(len(FILLERS)), *key, seed=seed + 3).cast("int"))
    before = pick(F.lit(100), *key, seed=seed + 4) < 40
    filled = F.when(before, F.concat(filler, F.lit(" "), text)).otherwise(F.concat(bare, F.lit(" "), filler))
    return _clean(F.when(u < 45, bound(small, lose)).when(u < 70, F.concat(bare, ending)).when(u < 88, filled).otherwise(F.regexp_replace(text, OPENER, "")))


def typos(text: Column, spans: Column, *key: Column, seed: int = 0) -> Column:
    """One slip, or two, in words of at least five letters outside the spans."""
    def hit(ws: Column) -> Column:
        n = F.size(ws)
        two = (n > 2) & (pick(F.lit(100), *key, seed=seed) < TWO)
        i = pick(n, *key, seed=seed + 1)
        j = F.pmod(i + 1 + pick(F.greatest(n - 1, F.lit(1)), *key, seed=seed + 2), n)
        late, early = F.get(ws, F.when(two, F.greatest(i, j)).otherwise(i).cast("int")), F.get(ws, F.least(i, j).cast("int"))
        # From the right, so that the first word stays where it is.
        once = _replaced(text, late, slip(late["word"], *key, seed=seed + 3))
        return F.when(n == 0, text).when(two, _replaced(once, early, slip(early["word"], *key, seed=seed + 6))).otherwise(once)

    return bound(free_words(text, spans, r"[A-Za-z]{5,}"), hit)


def noisy(text: Column, spans: Column, *key: Column, seed: int = 0) -> Column:
    """text with loose grammar and slips at their rates; spans that end in a letter or digit stay verbatim."""
    loose = F.when(pick(F.lit(100), *key, seed=seed) < GRAMMAR, loose_grammar(text, spans, *key, seed=seed + 10)).otherwise(text)
    return bound(loose, lambda t: F.when(pick(F.lit(100), *key, seed=seed + 1) < TYPOS, typos(t, spans, *key, seed=seed + 20)).otherwise(t))


def misspelt_times(rows: DataFrame, span: str, key: str, seed: int = 0, rate: int = 100) -> DataFrame:
    """rows with typed: in a share of them the span with a slip in a word of at least four letters, if what is written still means the same time; else the span as it was.

    What a span means is worked out once for each spelling, not for each row.
    """
    k = F.col(key)

    def slipped(parts: Column) -> Column:
        long = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.char_length(F.get(parts, i)) >= 4)

        def of(spots: Column) -> Column:
            at = F.get(spots, pick(F.greatest(F.size(spots), F.lit(1)), k, seed=seed).cast("int"))
            return F.array_join(F.transform(parts, lambda w, i: F.when(i == at, slip(w, k, seed=seed + 1)).otherwise(w)), " ")

        return bound(long, of)

    drawn = F.when(pick(F.lit(100), k, seed=seed + 5) < rate, bound(F.split(F.trim(span), r"\s+"), slipped)).otherwise(F.col(span))
    tried = written(rows.withColumn("_typed", drawn), "typed")
    said = tried.select(F.col(span).alias("_s")).union(tried.select("_typed")).where("_s IS NOT NULL").distinct()
    means = written(said.select("_s", canonical(F.col("_s")).alias("_m")), "meanings")
    out = tried.join(means.select(F.col("_s").alias(span), F.col("_m").alias("_a")), span, "left").join(means.select(F.col("_s").alias("_typed"), F.col("_m").alias("_b")), "_typed", "left")
    return out.select(*rows.columns, F.when(F.col("_a") == F.col("_b"), F.col("_typed")).otherwise(F.col(span)).alias("typed"))


FEWEST, MOST, TRIES = 3, 8, 6  # fixed values: misspellings of a name, and draws for each one wanted


def misspellings(name: Column, *key: Column, seed: int = 0) -> Column:
    """ARRAY<STRING>: three to eight different slips of one name, each in one word of at least four letters; none for names without such a word."""
    words = free_words(name, F.array().cast("array<string>"), "[A-Za-z]{4,}")
    wanted = (pick(F.lit(MOST - FEWEST + 1), *key, seed=seed) + FEWEST).cast("int")

    def tried(ws: Column) -> Column:
        def one(i: Column) -> Column:
            at = F.get(ws, pick(F.greatest(F.size(ws), F.lit(1)), *key, i, seed=seed + 1).cast("int"))
            return _replaced(name, at, slip(at["word"], *key, i, seed=seed + 2))

        return F.when(F.size(ws) > 0, F.transform(F.sequence(F.lit(1), wanted * TRIES), one)).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_remove(F.array_distinct(bound(words, tried)), name), F.lit(1), wanted)
