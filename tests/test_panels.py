import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitesignal.operators import features
from sitesignal.operators.projects import assign_projects

SCHEMA = (
    "asn string, date_entered date, category string, is_tower_signal boolean, sponsor_norm string, entity string, ticker string, entity_type string, entity_source string,"
    "structure_description string, date_built date, latitude double, longitude double, agl_structure_height double, asr_registration_date date, asr_date_constructed date,"
    "asr_date_dismantled date, build_kind string, project_id string"
)
WHO = [("AMT X", "American Tower", "AMT", "tower_reit", "sponsor"), ("VZ X", "Verizon", "VZ", "carrier", "sponsor"), ("JOE", "Crown Castle", "CCI", "tower_reit", "asr_owner"), ("TOW", features.JOINT_VENTURE, None, "private_towerco", "sponsor"), ("ANN", None, None, None, None)]


def cases(n=600, seed=7):
    rng = random.Random(seed)
    start, out = dt.date(2022, 7, 1), []
    for k in range(n):
        d = start + dt.timedelta(rng.randrange(720))
        near = lambda lo, hi: d + dt.timedelta(rng.randrange(lo, hi)) if rng.random() < 0.4 else None
        cat = rng.choice(["tower", "monopole", "cow", "antenna_mount"])
        who = rng.choice(WHO)
        out.append((
            f"n{k:04}", d, cat, cat in ("tower", "monopole"), who[0], *who[1:], rng.choice(["swap", "new", None]), near(-200, 200), 40 + rng.randrange(60) * 0.0004, -90 + rng.randrange(40) * 0.0004,
            rng.choice([None, 100.0, 300.0]), near(-900, 400), near(-300, 300), near(-500, 500), rng.choice(["new_build", "modification", "unknown"]), None,
        ))
    return out


def as_known(rows, cutoff):
    """The rows as a database of that day would have them: later filings are missing, and later facts are."""
    hide = lambda d: d if d is not None and d <= cutoff else None
    return [(*r[:10], hide(r[10]), *r[11:14], hide(r[14]), hide(r[15]), hide(r[16]), *r[17:]) for r in rows if r[1] <= cutoff]


def panel(spark, rows, cutoff):
    df = spark.createDataFrame(rows, SCHEMA)
    daily = df.groupBy("date_entered").agg(F.count(F.lit(1)).alias("n"))
    p = features.panel(features.prepare(df), daily, "Q", asof=F.lit(cutoff))
    return {tuple(r) for r in p.where(F.col("basis") == "pit").where("complete").withColumn("n_hw", F.round("n_hw", 6)).collect()}


@pytest.mark.parametrize("cutoff", [dt.date(2023, 6, 30), dt.date(2024, 3, 31)])
def test_the_past_does_not_change(spark, cutoff):
    rows = cases()
    full = {r for r in panel(spark, rows, dt.date(2024, 12, 31)) if r[0] <= cutoff}
    assert panel(spark, as_known(rows, cutoff), cutoff) == full and full


def test_hindsight_does_change(spark):
    cutoff = dt.date(2023, 6, 30)
    rows = [(*r[:8], "sponsor", *r[9:]) if r[0] > "n0300" else r for r in cases()]
    shifted = [(*r[:14], r[1] - dt.timedelta(400), *r[15:]) if r[1] <= cutoff else r for r in rows]
    assert panel(spark, shifted, cutoff) != panel(spark, rows, cutoff)


def test_groups_overlap_and_totals_add_up(spark):
    df = spark.createDataFrame(cases(), SCHEMA)
    daily = df.groupBy("date_entered").agg(F.count(F.lit(1)).alias("n"))
    p = features.panel(features.prepare(df), daily, "W").cache()
    total = p.where("basis = 'pit' AND name = 'all' AND category = 'all' AND kind = 'all'").agg(F.sum("n")).first()[0]
    signal = df.where("is_tower_signal").count()
    assert total == signal
    assert p.where("basis = 'pit' AND name = 'all' AND category <> 'all' AND kind <> 'all'").agg(F.sum("n")).first()[0] == signal
    assert p.where("level = 'coverage'").agg(F.sum("n")).first()[0] == df.count()
    assert p.groupBy(*features.KEYS).count().where("count > 1").count() == 0
    owners = p.where("name = 'Crown Castle' AND kind = 'all' AND category = 'all'").groupBy("basis").agg(F.sum("n")).collect()
    assert [r[0] for r in owners] == ["hindsight"]  # known from the owner only


def test_series_and_start(spark):
    quarters = [dt.date(2020 + k // 4, 1 + 3 * (k % 4), 1) for k in range(12)]
    n = {0: 100, 1: 90, 2: 10, 3: 95, 4: 100, 6: 100, 7: 100, 8: 100, 9: 95}
    rows = [(quarters[k], "pit", "coverage", "all_cases", "any", "all", v, 0.0, 0, True) for k, v in n.items()] + [(quarters[10], "pit", "coverage", "all_cases", "any", "all", 1, 0.0, 0, False)]
    rows += [(quarters[4], "pit", "group", "all", "all", "modification", 5, 0.0, 0, True)]
    p = spark.createDataFrame(rows, "period date, basis string, level string, name string, category string, kind string, n long, n_hw double, n_projects long, complete boolean")
    assert features.default_start(p).first()["start"] == quarters[6]
    assert {r.period: r.ok for r in features.coverage_ok(p).collect()}[quarters[2]] is False
    s = {r.period: r.value for r in features.series(p, "all", kind="modification").collect()}
    assert len(s) == 10 and s[quarters[4]] == 5.0 and sum(s.values()) == 5.0
    none = p.where("period < '1990-01-01'")
    assert features.default_start(none).first()["start"] is None and features.series(none, "all").count() == 0


def test_project_ids_are_cases(spark):
    df = spark.createDataFrame(cases(200), SCHEMA).withColumn("project_key", F.coalesce("entity", "sponsor_norm"))
    p = assign_projects(df)
    assert p.count() == 200 and p.join(df.select(F.col("asn").alias("project_id")), "project_id", "left_anti").count() == 0


def test_kinds_of_one_side_only(spark):
    rows = [(dt.date(1999, 3, 1), None, "new_build"), (dt.date(2000, 3, 1), "modification", None), (dt.date(2001, 3, 1), "modification", "new_build")]
    df = spark.createDataFrame(rows, "date_entered date, pit_kind string, build_kind string")
    got = {r.year: (r.modification, r.hs_new_build) for r in features.kind_counts(df, ["modification"], ["new_build"]).collect()}
    assert got == {1999: (0, 1), 2000: (1, 0), 2001: (1, 1)}
