"""Fixed vocabularies and limits, and the tiny dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The measurements, the sentinels for a missing one, and the share of clean values a field needs.
FIELDS = ("Rainfall", "Tmin", "Tmax", "Tavg", "RH", "RH_max", "RH_min", "DPT", "Wind_Speed", "Wind_max", "Wind_Direction", "SunSD", "DayLength", "Lowcloud", "Soilm10", "Soilm40", "Soilt10")
SENTINELS = (-999.0, -9999.0, 999.0, 9999.0)
USABLE, GOOD = 0.60, 0.90

#: What may be asked of what.
NEVER_TOTALS = ("DayLength", "Wind_Direction", "RH", "RH_max", "RH_min", "DPT", "Soilm10", "Soilm40", "Soilt10", "Tmin", "Tmax", "Tavg")
ACCUMULATES, COUNTABLE_VARIABLES, CIRCULAR = ("RAIN", "SUNSHINE"), ("RAIN", "SUNSHINE", "CLOUD"), "Wind_Direction"
THRESHOLDS = {"Rainfall": 0.2, "SunSD": 0.1, "Lowcloud": 0.5}
COUNTED = ("COUNT", "RUN_COUNT", "FREQUENCY", "INTENSITY", "LONGEST_RUN", "PEAK_PERIOD", "LOW_PERIOD")
TOTALLED, BUCKETED = ("SUM", "CUMULATIVE"), ("MODE", "DISTRIBUTION")
PLAIN = ("AVG", "MEDIAN", "MAX", "MIN", "RANGE", "STDDEV", "CHANGE", "PEAK_DATE", "LOW_DATE", "TREND")
VARIABLE_FIELDS = {
    "GENERAL": ("Tavg", "Rainfall", "RH"),
    "TEMPERATURE": ("Tmin", "Tmax", "Tavg"),
    "RAIN": ("Rainfall",),
    "HUMIDITY": ("RH", "RH_max", "RH_min"),
    "WIND": ("Wind_Speed", "Wind_max", "Wind_Direction"),
    "CLOUD": ("Lowcloud",),
    "SUNSHINE": ("SunSD", "DayLength"),
    "UV": ("SunSD", "DayLength", "Lowcloud"),
    "SOIL_MOISTURE": ("Soilm10", "Soilm40"),
    "SOIL_TEMPERATURE": ("Soilt10",),
}
#: The columns of a variable where more or less than usual is asked for.
MINIMAL_FIELDS = {"GENERAL": ("Tavg",), "TEMPERATURE": ("Tavg",), "RAIN": ("Rainfall",), "HUMIDITY": ("RH",), "WIND": ("Wind_Speed",), "CLOUD": ("Lowcloud",), "SUNSHINE": ("SunSD",), "UV": ("SunSD",), "SOIL_MOISTURE": ("Soilm10",), "SOIL_TEMPERATURE": ("Soilt10",)}
FULL_FIELDS = {
    "GENERAL": ("Tmin", "Tmax", "Tavg", "Rainfall", "RH", "RH_min", "RH_max", "DPT", "Wind_Speed", "Wind_max", "Wind_Direction", "SunSD", "DayLength", "Lowcloud", "Soilm10", "Soilm40", "Soilt10"),
    "TEMPERATURE": ("Tmin", "Tmax", "Tavg", "DPT"), "RAIN": ("Rainfall", "RH", "Lowcloud"), "HUMIDITY": ("RH", "RH_max", "RH_min", "DPT"), "WIND": ("Wind_Speed", "Wind_max", "Wind_Direction"), "CLOUD": ("Lowcloud", "SunSD"),
    "SUNSHINE": ("SunSD", "DayLength", "Lowcloud"), "UV": ("SunSD", "DayLength", "Lowcloud"), "SOIL_MOISTURE": ("Soilm10", "Soilm40", "Rainfall"), "SOIL_TEMPERATURE": ("Soilt10", "Tavg"),
}
FIELD_CAP, FULL_CAP = 8, 20  # fixed values: columns of an answer, and of one that asks for everything
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")

#: Limits worth a remark (field, limit, phrase, low side counts).
NOTABLE = (
    ("Rainfall", 10.0, "heavy rain", False),
    ("Tmax", 40.0, "heat above 40°C", False),
    ("Tmin", 10.0, "cold below 10°C", True),
    ("Wind_Speed", 11.0, "strong wind above ~40 kmph", False),
    ("Wind_max", 14.0, "gusts above ~50 kmph", False),
    ("RH", 90.0, "very humid air", False),
)

#: Activities done during a stretch of good weather (name, condition, hours needed, dry hours after).
TIMED = (
    ("SPRAY", "Rainfall < 0.2 AND Wind_Speed BETWEEN 1.0 AND 4.5", 2.0, 4.0),
    ("DRYING", "Rainfall < 0.2 AND RH < 85.0", 4.0, 0.0),
    ("OUTDOOR_ACTIVITY", "Rainfall < 1.0 AND Tmax < 38.0", 2.0, 0.0),
    ("TRAVEL", "Rainfall < 1.0 AND Wind_Speed < 14.0", 1.0, 0.0),
    ("HARVEST", "Rainfall < 1.0", 72.0, 0.0),
)
SUB_TIMED = (("DRYING", "VEHICLE_WASHING", "Rainfall < 0.2", 2.0, 0.0), ("OUTDOOR_ACTIVITY", "SPORTS", "Rainfall < 1.0 AND Tmax < 38.0 AND coalesce(SunSD > 0, hour(ts) BETWEEN 6 AND 18)", 2.0, 0.0))
#: The readings a verdict can't do without.
NEEDS = {
    "RAIN_PROTECTION": ("Rainfall",), "SUN_PROTECTION": ("SunSD",), "CLOTHING": ("Tmin", "Tmax"), "FERTILIZE": ("Rainfall",), "IRRIGATE": ("Soilm10", "Rainfall"), "SOW": ("Soilm10", "Rainfall"),
    "SPRAY": ("Rainfall", "Wind_Speed"), "DRYING": ("Rainfall", "RH"), "OUTDOOR_ACTIVITY": ("Rainfall", "Tmax"), "TRAVEL": ("Rainfall", "Wind_Speed"), "HARVEST": ("Rainfall", "RH"),
}
NOT_DAMP, DRY = "Rainfall < 0.2", "Rainfall < 1.0"


def supports(variable: str, statistic: str) -> bool:
    """Whether the statistic means anything for the variable."""
    if statistic == "RAW":
        return True
    if variable == "GENERAL":
        return False
    if statistic in TOTALLED:
        return variable in ACCUMULATES
    if statistic in BUCKETED:
        return variable == "WIND"
    return statistic not in COUNTED or variable in COUNTABLE_VARIABLES


def gates(spark: SparkSession) -> DataFrame:
    """variable, field, statistic: the combinations that may be answered; joined, so that a refusal is a missing row."""
    rows = [
        (v, f, s)
        for v, fields in VARIABLE_FIELDS.items()
        for f in fields
        for s in (*PLAIN, *COUNTED, *TOTALLED, *BUCKETED)
        if supports(v, s) and not (s in TOTALLED and f in NEVER_TOTALS) and (f != CIRCULAR or s in ("MODE", "DISTRIBUTION", "COUNT"))
    ]
    return spark.createDataFrame(rows, "variable string, field string, statistic string")
