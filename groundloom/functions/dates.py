"""Acquisition dates, seasons and their encodings, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two month-to-season maps (meteorological, phenological) and the middle month of a named season.
METEOROLOGICAL = {12: "winter", 1: "winter", 2: "winter", 3: "spring", 4: "spring", 5: "spring", 6: "summer", 7: "summer", 8: "summer", 9: "autumn", 10: "autumn", 11: "autumn"}
PHENOLOGICAL = {12: "leaf_off", 1: "leaf_off", 2: "leaf_off", 3: "leaf_off", 4: "transition", 5: "leaf_on", 6: "leaf_on", 7: "leaf_on", 8: "leaf_on", 9: "leaf_on", 10: "transition", 11: "leaf_off"}
SEASON_MONTH = {"winter": 1, "spring": 4, "summer": 7, "autumn": 10, "fall": 10}
RANK = {"leaf_off": 0, "transition": 1, "leaf_on": 2}
SUMMER = (6, 7, 8)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def parse_date(text: Column) -> Column:
    """Four spellings, then a named season with a year (its middle, day 15), then any date; else null."""
    exact = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in FORMATS]
    year = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    low = F.lower(text)
    named = F.lit(None).cast("int")
    for word, month in reversed(SEASON_MONTH.items()):
        named = F.when(low.contains(word), month).otherwise(named)
    season = F.when(year.isNotNull() & named.isNotNull(), F.make_date(year, named, F.lit(15)))
    return F.coalesce(*exact, season, text.try_cast("date"))


def is_summer(date: Column) -> Column:
    return F.coalesce(F.month(date).isin(*SUMMER), F.lit(False))


def month_of(text: Column) -> Column:
    """Month of a date written with or without - or /; null where there is none."""
    bare = F.regexp_replace(text, "[-/]", "")
    quick = F.when(bare.rlike(r"^\d{6}"), F.substring(bare, 5, 2).cast("int"))
    return F.coalesce(F.when(quick.between(1, 12), quick), F.month(text.try_cast("date")))


def phenological_season(month: Column) -> Column:
    """Unknown months count as leaf_off."""
    return F.coalesce(_lookup(PHENOLOGICAL, month), F.lit("leaf_off"))


def meteorological_season(month: Column) -> Column:
    return _lookup(METEOROLOGICAL, month)


def days_in_year(date: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def date_encoding(date: Column) -> Column:
    """struct(sin, cos) of the day of the year, in [0, 1]; (0.5, 0.5) without a date."""
    turn = 2 * math.pi * F.dayofyear(date) / days_in_year(date)
    half = lambda c: F.coalesce((c + 1) / 2, F.lit(0.5))
    return F.struct(half(F.sin(turn)).alias("sin"), half(F.cos(turn)).alias("cos"))


def month_name(text: Column) -> Column:
    """5, 5.0, Month_05 and May give May; else Unknown. An empty text stays empty."""
    names = F.array(F.lit(""), *map(F.lit, MONTHS))
    number = F.coalesce(F.regexp_extract(text, r"^[Mm]onth_0*(\d+)$", 1).try_cast("int"), F.trim(text).try_cast("double").cast("int"))
    return F.when(F.array_contains(names, text), text).otherwise(F.coalesce(F.when(number.between(1, 12), F.get(names, number)), F.lit("Unknown")))


def months_of(dates: Column) -> Column:
    found = F.array_sort(F.array_distinct(F.transform(dates, lambda d: F.month(d))))
    return F.coalesce(found, F.array().cast("array<int>"))


def first_summer(dates: Column) -> Column:
    return F.array_min(F.filter(dates, is_summer))


def seasonal_pattern(dates: Column) -> Column:
    """Whether other dates lie before or after the first summer date: both, before, after or none; null without a summer date."""
    first = first_summer(dates)
    other = F.filter(dates, lambda d: ~is_summer(d))
    before, after = F.exists(other, lambda d: d < first), F.exists(other, lambda d: d > first)
    label = F.when(before & after, "both").when(before, "before").when(after, "after").otherwise("none")
    return F.when(first.isNotNull(), label)


def season_contrast(a: Column, b: Column) -> Column:
    return F.abs(_lookup(RANK, a) - _lookup(RANK, b))


def coverage_date(text: Column) -> Column:
    """A date as a number between 20000000 and 20301231, else 0."""
    n = text.try_cast("int")
    return F.when(n.between(20000000, 20301231), n).otherwise(0)
