"""The windows of dates in which cases are asked for, and which of them are still to do."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.operators.state import WINDOW_KEY, pending

# The series and regions that exist, which series spills over into the year before, and the states.
CASE_TYPES = ("OE", "NRA")
SPILL_TYPES = ("NRA",)
REGIONS = ("AAL", "ACE", "AEA", "AGL", "ANE", "ANM", "ASO", "ASW", "AWP", "WTE", "WTW")
STATES = tuple(
    "AK AL AR AZ CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY "
    "OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY PR VI GU AS MP".split()
)


@dataclass(frozen=True)
class Window:
    """Days start to end, both included, of one series and case-number year (by default that of the days)."""

    case_type: str
    region: str | None
    start: date
    end: date
    state: str | None = None
    asn_year: int | None = None

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError(f"empty window {self.start} to {self.end}")
        if self.start.year != self.end.year:
            raise ValueError(f"window {self.start} to {self.end} crosses a year")

    @property
    def year(self) -> int:
        return self.start.year if self.asn_year is None else self.asn_year

    @property
    def key(self) -> tuple[str, int, str, date, date]:
        return self.case_type, self.year, self.region or "ALL", self.start, self.end

    def query(self) -> dict[str, str]:
        """Request parameters. The service reads the end as an exclusive midnight, so the day after is asked for."""
        out = {"dateEnteredStart": self.start.isoformat(), "dateEnteredEnd": (self.end + timedelta(days=1)).isoformat()}
        return out | {k: v for k, v in (("region", self.region), ("state", self.state)) if v}

    def halves(self) -> tuple[Window, Window]:
        middle = self.start + timedelta(days=(self.end - self.start).days // 2)
        return replace(self, end=middle), replace(self, start=middle + timedelta(days=1))


def months(start: Column, end: Column) -> Column:
    """Array of (start, end) of calendar months, clipped to the days from start to end."""
    firsts = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(firsts, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))


def month_windows(spans: DataFrame) -> DataFrame:
    """spans (start, end and more) with one row for each month instead."""
    rest = [c for c in spans.columns if c not in ("start", "end")]
    return spans.where("start <= end").select(*rest, F.explode(months(F.col("start"), F.col("end"))).alias("m")).select(*rest, "m.*")


def _crossed(spans: DataFrame, types: Sequence[str], regions: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(t).alias("case_type"), F.lit(r).alias("region")) for t in types for r in regions])
    return spans.withColumn("c", F.explode(cells)).select("c.*", *spans.columns)


def plan(spark: SparkSession, years: Sequence[int], today: date, types: Sequence[str] = CASE_TYPES, regions: Sequence[str] = REGIONS, since: date | None = None) -> DataFrame:
    """WINDOW_KEY rows: months by series and region, and a window over the whole year before for series that spill over.

    Years after today's are passed over, days after today cut off; since: only days from then on.
    """
    rows = [(y, max(date(y, 1, 1), since or date(y, 1, 1)), min(date(y, 12, 31), today)) for y in years if y <= today.year]
    spans = spark.createDataFrame(rows, "year int, start date, end date")
    spill = spark.createDataFrame([(y, date(y - 1, 1, 1), date(y - 1, 12, 31)) for y in years if y <= today.year], "year int, start date, end date")
    spilling = [t for t in types if t in SPILL_TYPES]
    out = _crossed(month_windows(spans), types, regions)
    if spilling:
        out = out.unionByName(_crossed(spill, spilling, regions))
    return out.select(*WINDOW_KEY)


def backfill(spark: SparkSession, first: int, last: int, today: date, done: DataFrame | None = None, **which) -> DataFrame:
    """Windows of all years that the log doesn't have, newest year first."""
    todo = plan(spark, range(first, last + 1), today, **which)
    if done is not None:
        todo = pending(todo, done)
    return todo.orderBy(F.desc("year"), "start", "case_type", "region")


def incremental(spark: SparkSession, days: int, today: date, **which) -> DataFrame:
    """Windows of the last days, whether pulled before or not, so that changes of status come in."""
    since = today - timedelta(days=days)
    inside = plan(spark, range(since.year, today.year + 1), today, since=since, **which)
    spilled = F.year("start") != F.col("year")
    return inside.where(~spilled | (F.col("year") == today.year))


def as_windows(rows: DataFrame) -> list[Window]:
    """Windows for the fetcher: a pull plan, some thousands at most."""
    return [Window(r["case_type"], r["region"], r["start"], r["end"], asn_year=r["year"]) for r in rows.collect()]
