"""Missing readings: NULL, blank words, text that is no number, NaN and sentinels are all the same."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agro_jobs.functions.dims import SENTINELS

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """A clean double of a double column."""
    return F.when(c.isNull() | F.isnan(c) | c.isin(*SENTINELS), None).otherwise(c)


def number_text(c: Column) -> Column:
    """A clean double of a text column; only plain decimal notation counts as a number."""
    s = F.trim(c)
    return number(F.when(s.rlike(NUMBER), s.try_cast("double")))


def cleaned(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """rows with every field clean; text columns are parsed."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({f: (number_text if kinds[f] == "string" else number)(F.col(f)) for f in fields if f in kinds})


def long_form(rows: DataFrame, fields: Iterable[str], keys: Iterable[str]) -> DataFrame:
    """keys, field, value: one row per reading and field, missing values kept as NULL."""
    return rows.unpivot(list(keys), list(fields), "field", "value")
