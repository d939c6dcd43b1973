"""Partial dates: a year, and a month and a day where they can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first


def first_year(text: Column) -> Column:
    """The first four ASCII digits in a row, if they make a year of 1000 to 3000; later digits are not tried."""
    year = F.nullif(F.regexp_extract(text, "[0-9]{4}", 0), F.lit("")).try_cast("int")
    return F.when(year.between(1000, 3000), year)


def date_part(text: Column, start: int, least: int, most: int) -> Column:
    """Two UTF-8 bytes from byte ``start`` on as a number within bounds: two digits, or a plus and one digit."""
    part = F.substring(F.encode(text, "UTF-8"), start + 1, 2).cast("string")
    number = F.when(part.rlike("^([0-9]{2}|[+][0-9])$"), part.try_cast("int"))
    return F.when(number.between(least, most), number)


def partial_date(text: Column) -> Column:
    """``struct<year, month, day>``, null without a year. Month and day stand at fixed places and are read independently."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    # one element that goes through two steps: the trimmed text and the year are each computed once
    read = F.transform(F.array(trimmed), lambda t: F.struct(t.alias("t"), first_year(t).alias("year")))
    dates = F.transform(read, lambda r: F.when(r["year"].isNotNull(), F.struct(r["year"].alias("year"), date_part(r["t"], 5, 1, 12).alias("month"), date_part(r["t"], 8, 1, 31).alias("day"))))
    return first(dates)


def tei_date(date: Column) -> Column:
    """The ``when`` attribute if there is one, even if empty, else the text."""
    return partial_date(F.coalesce(date["when"], date["text"]))


def first_date(dates: Column) -> Column:
    """The first of the dates that can be read."""
    return first(F.filter(F.transform(dates, tei_date), lambda d: d.isNotNull()))


def first_year_of(dates: Column) -> Column:
    """The year of :func:`first_date`, without its month and day: a date can be read if its year can."""
    return first(F.array_compact(F.transform(dates, lambda d: first_year(F.coalesce(d["when"], d["text"])))))
