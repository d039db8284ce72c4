import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitesignal.functions import dates, stats, text


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


NAMES = {
    "Acme Towers, LLC": "ACME TOWERS LLC", "Acme Towers (CK-MD)": "ACME TOWERS", "Tall Co - CS": "TALL CO", "Crown Castle USA.NB": "CROWN CASTLE USA",
    "Poles LLC-REGULATORY": "POLES LLC", "T-Mobile USA MR": "T MOBILE USA", "Towers_MJ": "TOWERS", "AT&T Mobility": "ATT MOBILITY", "Bob's  Poles ": "BOBS POLES",
    "A (x) (y) - z": "A", "...": None, "": None, None: None, "Crown Castle USA MR - NB (X)": "CROWN CASTLE USA",
}


def test_normalize_name(spark):
    assert apply(spark, text.normalize_name, list(NAMES)) == list(NAMES.values())


def test_stripping_has_come_to_rest(spark):
    names = [*[n for n in NAMES if n], "X (A) (B) (C) - D_EF ~ G", "LLC - A - B - C - D", "USA AB CD EF", "A_BC_DE_FG (H)"]
    upper = [n.upper() for n in names]
    assert apply(spark, text.strip_codes, upper) == apply(spark, lambda c: text._strip_codes(text.strip_codes(c)), upper)
    many = "ACME TOWERS LLC" + "".join(f" - A{k}" for k in range(12))
    assert apply(spark, text.strip_codes, [many, None, ""]) == ["ACME TOWERS LLC", None, ""]


def test_base_name(spark):
    names = {"TARPON TOWERS II LLC": "TARPON TOWERS", "SOME CO DBA OTHER": "SOME", "LLC": "LLC", "CORP 12A": "CORP", "ACME XI LP": "ACME"}
    assert apply(spark, text.base_name, list(names)) == list(names.values())


def test_numbers(spark):
    numbers = {"1252613": "1252613", "A1252613": "1252613", "01252613": "1252613", "1252613.0": "1252613", "": None, "none": None, None: None, "000": None}
    assert apply(spark, text.normalize_number, list(numbers)) == list(numbers.values())
    studies = {"96-ACE-0407-OE": "1996-ACE-407-OE", " 2024-aso-5144-oe ": "2024-ASO-5144-OE", "12-AGL-1-NRA": "2012-AGL-1-NRA", "N/A": None, None: None, "123-A-1-OE": None}
    assert apply(spark, text.normalize_study, list(studies)) == list(studies.values())


def test_domains(spark):
    mails = {"A@B.Com": "b.com", "x@y@ Z.org ": "z.org", "nobody": None, "a@": None, None: None}
    assert apply(spark, text.email_domain, list(mails)) == list(mails.values())
    assert apply(spark, text.domain_suffixes, ["a.b.c"]) == [["a.b.c", "b.c", "c"]]


def test_groups(spark):
    assert apply(spark, text.status_group, ["DET-FAV", "X", None]) == ["DET", "X", "NONE"]
    assert apply(spark, text.structure_group, ["tower$antenna", "CRANE$WINDMILL", None, " pole "]) == ["TOWER", "WINDMILL", "UNKNOWN", "POLE"]


@pytest.mark.parametrize("word, says", [("existing tower", True), ("colo", True), ("model", False), ("mod", True), ("as built", True), ("5g add", True), ("new site", False), (None, False), ("address", False)])
def test_keywords(spark, word, says):
    assert apply(spark, text.says_existing, [word]) == [says]


def test_dates(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 2, 29), dt.date(2023, 12, 31)]
    starts = apply(spark, lambda c: dates.period_start(c, "W"), days, "date")
    assert starts == [dt.date(2024, 1, 1), dt.date(2024, 2, 26), dt.date(2023, 12, 25)]
    assert apply(spark, lambda c: dates.period_end(dates.period_start(c, "Q"), "Q"), days, "date") == [dt.date(2024, 3, 31), dt.date(2024, 3, 31), dt.date(2023, 12, 31)]
    assert apply(spark, dates.half_label, days, "date") == ["2024H1", "2024H1", "2023H2"]
    assert apply(spark, dates.quarter_start, ["2019Q3", "2019-q1", "2019Q5", "x", None]) == [dt.date(2019, 7, 1), dt.date(2019, 1, 1), None, None, None]
    assert apply(spark, dates.us_date, ["06/30/2006", "13/01/2006", "", None]) == [dt.date(2006, 6, 30), None, None, None]
    assert apply(spark, dates.iso_date, ["2025-01-06T23:20:24-05:00", "2025-01-06", "bad"]) == [dt.date(2025, 1, 6), dt.date(2025, 1, 6), None]


def test_quantiles(spark):
    import random

    random.seed(1)
    for n in (1, 2, 5, 10, 11, 24):
        values = [random.randrange(1000) for _ in range(n)]
        df = spark.createDataFrame([(v, dt.date(2000, 1, 1) + dt.timedelta(v)) for v in values], "v int, d date")
        near = stats.nearest_quantiles(df.withColumn("k", F.lit(1)), ["k"], "v", {"q": 0.75}).first().q
        low = df.agg(stats.date_quantile_lower("d", 10)).first()[0]
        assert near == sorted(values)[int((n - 1) * 0.75 + 0.5)]
        assert low == dt.date(2000, 1, 1) + dt.timedelta(sorted(values)[(n - 1) // 10])


def test_safe_corr(spark):
    df = spark.createDataFrame([("flat", 1.0, float(i)) for i in range(5)] + [("line", float(i), 2.0 * i) for i in range(5)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)], "k string, x double, y double")
    got = {r[0]: r[1] for r in df.groupBy("k").agg(stats.safe_corr(F.col("x"), F.col("y"))).collect()}
    assert got["flat"] is None and got["few"] is None and abs(got["line"] - 1) < 1e-12


def test_staged_tables_are_released(spark):
    from pathlib import Path

    from sitesignal import session

    df = session.staged(spark.range(3), "release")
    assert df.count() == 3
    place = Path(session.scratch(spark, "x").removeprefix("file://")).parent
    assert list(place.iterdir())
    session.release(spark)
    assert not place.exists()
