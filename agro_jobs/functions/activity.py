"""What an activity comes down to: its group, its particular form, where it happens, and how much detail is asked for."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The group of every activity.
GROUP = {
    "NONE": "NONE", "OUTDOOR_ACTIVITY": "OUTDOOR_ACTIVITY", "TRAVEL": "TRAVEL", "RAIN_PROTECTION": "CLOTHING", "SUN_PROTECTION": "CLOTHING", "CLOTHING": "CLOTHING", "DRYING": "HOUSEHOLD",
    "SOW": "AGRICULTURE", "IRRIGATE": "AGRICULTURE", "FERTILIZE": "AGRICULTURE", "SPRAY": "AGRICULTURE", "HARVEST": "AGRICULTURE",
}
#: Words that name a form of an activity, words that mean the same thing, and the form where nothing is named.
KEYWORDS = {
    "concrete": "construction", "masons": "construction", "construction": "construction", "gardening": "gardening", "garden": "gardening", "lawn": "gardening", "prune": "gardening",
    "jog": "run", "jogging": "run", "workout": "run", "running": "run", "walk": "walk", "stroll": "walk", "sunscreen": "sunscreen", "sunblock": "sunscreen", "shade": "shade", "cap": "shade", "hat": "shade",
    "laundry": "laundry", "washing": "laundry",
}
SYNONYMS = {
    "bicycle": "bike", "cycle": "bike", "motorcycle": "bike", "motorbike": "bike", "scooter": "bike", "scooty": "bike", "two wheeler": "bike",
    "jeep": "car", "lorry": "car", "truck": "car", "auto": "car", "autorickshaw": "car", "rickshaw": "car",
}
DEFAULTS = {"TRAVEL": "car", "OUTDOOR_ACTIVITY": "", "DRYING": "laundry", "RAIN_PROTECTION": "umbrella", "SUN_PROTECTION": "sunscreen", "CLOTHING": "jacket"}
#: Sports under a roof, and words that say where.
INDOOR_SPORTS = ("badminton", "table tennis", "squash", "chess", "carrom", "billiards", "snooker", "bowling", "gym", "yoga", "swimming pool", "basketball court", "boxing", "wrestling")
VENUES = {
    "indoor": "indoor", "indoors": "indoor", "inside": "indoor", "covered": "indoor", "under a roof": "indoor", "at home": "indoor",
    "outdoor": "outdoor", "outdoors": "outdoor", "outside": "outdoor", "open ground": "outdoor", "in the open": "outdoor", "terrace": "outdoor", "ground": "outdoor", "field": "outdoor",
}
#: Cues for all there is and for as little as can be.
FULL_CUES = (
    "in detail", "detailed", "full", "everything", "all the", "complete", "in depth", "expand", "elaborate", "more detail", "breakdown", "comprehensive", "every reading", "all readings", "whole picture",
    "summarise", "summarize", "summary of", "sum up", "rundown", "overview", "brief me", "run through", "walk me through", "tell me about the",
)
MINIMAL_CUES = ("just the", "only the", "one number", "quick", "briefly", "in short", "short answer", "tl;dr", "summary only", "one line")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _longest(text: Column, words: dict[str, str]) -> Column:
    """What the longest of the words that the text has stands for; of equal length, the one listed first."""
    ranked = sorted(words, key=len, reverse=True)
    said = F.array(*[F.when(F.lower(text).rlike(rf"\b{re.escape(w)}\b"), F.lit(words[w])) for w in ranked])
    return F.get(F.array_compact(said), F.lit(0))


def group(activity: Column) -> Column:
    return F.coalesce(_map(GROUP)[activity], F.lit("NONE"))


def sub_activity(activity: Column, entities: Column, text: Column) -> Column:
    """The particular form of an activity, from its entities (MAP<type, spans>), else its text, else its default; none for activities without forms."""
    def first(kind: str) -> Column:
        term = F.lower(F.get(F.try_element_at(entities, F.lit(kind)), F.lit(0)))
        return F.coalesce(_map(SYNONYMS)[term], term)

    ride, wear = first("transport"), first("clothing")
    drying = F.when(activity == "DRYING", F.when(ride.isNotNull(), "vehicle").when(wear.isNotNull(), "laundry"))
    outdoor = F.when(activity == "OUTDOOR_ACTIVITY", F.coalesce(first("sport"), first("event")))
    default = _map(DEFAULTS)[activity]
    return F.when(default.isNull(), "").otherwise(F.coalesce(drying, outdoor, ride, wear, _longest(F.coalesce(text, F.lit("")), KEYWORDS), default))


def venue(activity: Column, sub: Column, text: Column) -> Column:
    """indoor or outdoor: as the text says, else by the sport."""
    by_sport = F.when((activity == "OUTDOOR_ACTIVITY") & F.lower(sub).isin(*INDOOR_SPORTS), "indoor").otherwise("outdoor")
    return F.coalesce(_longest(F.coalesce(text, F.lit("")), VENUES), by_sport)


def detail(text: Column) -> Column:
    """FULL, MINIMAL or NORMAL: the first kind of cue that the text has anywhere."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def has(cues: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(t, c))

    return F.when(has(FULL_CUES), "FULL").when(has(MINIMAL_CUES), "MINIMAL").otherwise("NORMAL")
