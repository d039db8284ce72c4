"""Completeness and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.functions.dates import period_start
from sitesignal.functions.text import status_group

KEYS = ("asn_region", "asn_year", "asn_type")


def distinct_with_null(c: str) -> Column:
    """Distinct values of a column, null counted as one."""
    return F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))


def status_groups(cases: DataFrame) -> list[str]:
    """The groups that occur, sorted: a handful of codes."""
    return sorted(r[0] for r in cases.select(status_group(F.col("status_code"))).distinct().collect())


def completeness(cases: DataFrame, groups: Sequence[str]) -> DataFrame:
    """For each region, year and series: cases, distinct numbers, lowest and highest number, their ratio to three
    digits, and a count for each status group.

    Numbers are issued in sequence, so the highest is what was issued at least. groups: the status groups to count, as
    a pivot's value list; everything is one aggregation.
    """
    group = status_group(F.col("status_code"))
    counts = [F.count_if(group == g).alias(f"n_{g.lower()}") for g in groups]
    ratio = F.round(F.col("n_distinct_seq") / F.nullif(F.col("max_seq"), F.lit(0)), 3)
    base = cases.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_cases"), distinct_with_null("asn_sequence").alias("n_distinct_seq"),
        F.min("asn_sequence").alias("min_seq"), F.max("asn_sequence").alias("max_seq"), *counts,
    )
    return base.withColumn("completeness", ratio)


def completeness_matrix(complete: DataFrame, asn_type: str, years: Sequence[int]) -> DataFrame:
    """Regions by years for one series."""
    wide = complete.where(F.col("asn_type") == asn_type).groupBy("asn_region").pivot("asn_year", list(years))
    return wide.agg(F.first("completeness"))


def completeness_by_year(complete: DataFrame, types: Sequence[str]) -> DataFrame:
    """Years by series: cases_<type> and completeness_<type>, over all regions."""

    def of(t: str) -> list[Column]:
        held, issued = (F.sum(F.when(F.col("asn_type") == t, F.col(c))) for c in ("n_distinct_seq", "max_seq"))
        return [F.sum(F.when(F.col("asn_type") == t, F.col("n_cases"))).alias(f"cases_{t}"), F.round(held / F.nullif(issued, F.lit(0)), 3).alias(f"completeness_{t}")]

    return complete.groupBy("asn_year").agg(*[c for t in types for c in of(t)])


def weekly_counts(cases: DataFrame, by: str | Column | None = "asn_region", day: str = "date_entered") -> DataFrame:
    """Cases in each week (from Monday), by something or not."""
    keys = [period_start(F.col(day), "W").alias("week")]
    if by is not None:
        keys.append(F.col(by) if isinstance(by, str) else by)
    return cases.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def status_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("asn_type", "status_code").agg(F.count(F.lit(1)).alias("n"))
