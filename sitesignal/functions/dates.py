"""Periods, quarters and lenient date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = {"W": "WEEK", "M": "MM", "Q": "QUARTER", "Y": "YEAR"}
MONTHS = {"M": 1, "Q": 3, "Y": 12}


def period_start(d: Column, freq: str) -> Column:
    """First day of the week (Monday), month, quarter or year."""
    return F.trunc(d, UNIT[freq])


def period_next(start: Column, freq: str) -> Column:
    return F.date_add(start, 7) if freq == "W" else F.add_months(start, MONTHS[freq])


def period_end(start: Column, freq: str) -> Column:
    """Last day of the period that starts at start."""
    return F.date_sub(period_next(start, freq), 1)


def grid(lo: Column, hi: Column, freq: str) -> Column:
    """Array of all period starts from lo to hi."""
    step = F.expr("interval 7 days") if freq == "W" else F.expr(f"interval {MONTHS[freq]} months")
    return F.sequence(lo, hi, step)


def month_label(c: Column) -> Column:
    """'2024-07'."""
    return F.date_format(c, "yyyy-MM")


def half_label(d: Column) -> Column:
    """2025H1"""
    return F.concat(F.year(d).cast("string"), F.lit("H"), F.when(F.month(d) > 6, F.lit("2")).otherwise(F.lit("1")))


def quarter_label(d: Column) -> Column:
    """2019Q3"""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_start(label: Column) -> Column:
    """2019Q3 or 2019-Q3 -> 2019-07-01; null for anything else."""
    s = F.regexp_replace(F.upper(F.trim(label)), "-", "")
    year, quarter = (F.regexp_extract(s, r"^(\d{4})Q([1-4])$", k).try_cast("int") for k in (1, 2))
    return F.make_date(year, (quarter - 1) * 3 + 1, F.lit(1))


def months_between_inclusive(start: Column, end: Column) -> Column:
    """Calendar months touched from start to end."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1


def iso_date(c: Column) -> Column:
    """Date in the first ten characters: the local calendar date of a timestamp text; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def us_date(c: Column) -> Column:
    """MM/dd/yyyy, null if it is none."""
    return F.try_to_date(c, "MM/dd/yyyy")


def iso_timestamp(c: Column) -> Column:
    """ISO timestamp text; without an offset it is taken as UTC (the session's zone); null if it is none."""
    return F.try_to_timestamp(c)
