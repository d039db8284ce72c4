"""Filing panels over weeks and quarters, as known at the time (pit) and in hindsight."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.functions.dates import grid, period_end, period_start
from sitesignal.operators.buildkind import pit_kind
from sitesignal.operators.projects import assign_projects

# The unit of height weights, and the members of the groups.
HEIGHT_UNIT_FT = 200.0
JOINT_VENTURE = "The Towers (Vertical Bridge/Verizon JV)"
REITS = ("AMT", "CCI", "SBAC")
CARRIERS = ("VZ", "T", "TMUS")
ENTITY_TYPES = ("tower_reit", "towerco", "carrier", "private_towerco")
KEYS = ("period", "basis", "level", "name", "category", "kind")


def group_conditions() -> dict[str, Column]:
    """The named groups; a filing may be in several."""
    ticker, entity, kind = F.col("ticker"), F.col("entity"), F.col("entity_type")
    carriers, venture, private = ticker.isin(*CARRIERS), entity == JOINT_VENTURE, kind == "private_towerco"
    return {
        "listed_reits": ticker.isin(*REITS), "carriers": carriers, "carriers_incl_towers_jv": carriers | venture,
        "vz_incl_towers_jv": (ticker == "VZ") | venture, "private_builders": private, "private_and_carriers": private | carriers, "all": F.lit(True),
    }


def prepare(cases: DataFrame, **pit) -> DataFrame:
    """Signal filings with what is needed for both bases: entity, kind and project start, pit and hindsight, and w.

    pit entities come from the sponsor alone; projects are clustered anew on them. w is height in units, 1 if unknown.
    """
    signal = cases.where("is_tower_signal").join(pit_kind(cases, **pit).select("asn", "pit_kind", "pit_basis"), "asn", "left")
    own = F.col("entity_source") == "sponsor"
    signal = signal.withColumns({f"{c}_pit": F.when(own, F.col(c)) for c in ("entity", "ticker", "entity_type")})
    keyed = signal.select("asn", "date_entered", "latitude", "longitude", F.coalesce("entity_pit", "sponsor_norm").alias("project_key"))
    projects = assign_projects(keyed).select("asn", F.col("project_id").alias("project_id_pit"))
    return signal.join(projects, "asn", "left").withColumns({
        "w": F.coalesce("agl_structure_height", F.lit(HEIGHT_UNIT_FT)) / HEIGHT_UNIT_FT,
        "project_start_pit": F.col("project_id_pit") == F.col("asn"),
        "project_start_hindsight": F.coalesce("project_id", "asn") == F.col("asn"),
    })


def both_bases(prepared: DataFrame) -> DataFrame:
    """One row for each filing and basis: the columns that panel groups by, under the same names for either basis."""
    columns = {
        "pit": ("entity_pit", "ticker_pit", "entity_type_pit", "pit_kind", "project_start_pit"),
        "hindsight": ("entity", "ticker", "entity_type", "build_kind", "project_start_hindsight"),
    }
    names = ("entity", "ticker", "entity_type", "kind", "project_start")
    rows = [F.struct(F.lit(b).alias("basis"), *[F.col(c).alias(n) for c, n in zip(cs, names, strict=True)]) for b, cs in columns.items()]
    return prepared.select("date_entered", "category", "w", F.explode(F.array(*rows)).alias("r")).select("date_entered", "category", "w", "r.*")


def panel(prepared: DataFrame, daily: DataFrame, freq: str, asof: Column | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """The long sparse panel: KEYS, n, n_hw, n_projects, complete.

    daily: date_entered, n of all cases, for the coverage rows. Filings are counted by period and by all that decides where
    they count, which leaves a small table; each of its rows is listed with the names it counts for (its entity, and its
    groups), and one aggregation with grouping sets makes all totals over category and kind. asof: the last day known, by
    default the last one of daily.
    """
    names = F.array_compact(F.array(
        F.when(F.col("entity").isNotNull() & F.col("entity_type").isin(*ENTITY_TYPES), F.struct(F.lit("entity").alias("level"), F.col("entity").alias("name"))),
        *[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit("group").alias("level"), F.lit(n).alias("name"))) for n, c in group_conditions().items()],
    ))
    decides = ("basis", "category", "kind", "entity", "ticker", "entity_type")
    few = both_bases(prepared).groupBy(period_start(F.col("date_entered"), freq).alias("period"), *decides)
    few = few.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("n_hw"), F.count_if("project_start").alias("n_projects"))
    rows = few.withColumn("member", F.explode(names)).select("period", "basis", "member.level", "member.name", "category", "kind", "n", "n_hw", "n_projects")
    by = [F.col(c) for c in KEYS]
    sets = rows.groupingSets([by, by[:4] + [by[4]], by[:4] + [by[5]], by[:4]], *by)
    counted = sets.agg(
        F.grouping("category").alias("g_category"), F.grouping("kind").alias("g_kind"), F.sum("n").alias("n"), F.sum("n_hw").alias("n_hw"),
        F.sum("n_projects").alias("n_projects"),
    )
    counted = counted.withColumns({c: F.when(F.col(f"g_{c}") == 1, F.lit("all")).otherwise(F.col(c)) for c in ("category", "kind")}).drop("g_category", "g_kind")
    total = F.sum("n").cast("long")
    coverage = daily.groupBy(period_start(F.col("date_entered"), freq).alias("period")).agg(total.alias("n"), total.cast("double").alias("n_hw"), total.alias("n_projects"))
    coverage = coverage.select("period", F.lit("pit").alias("basis"), F.lit("coverage").alias("level"), F.lit("all_cases").alias("name"), F.lit("any").alias("category"), F.lit("all").alias("kind"), "n", "n_hw", "n_projects")
    out = counted.select(*KEYS, "n", "n_hw", "n_projects").unionByName(coverage)
    if start is not None:
        out = out.where(F.col("period") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("period") <= F.lit(end))
    if asof is None:
        last = daily.agg(F.max("date_entered").alias("asof")).withColumn("one", F.lit(1))  # one row
        out = out.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").drop("one")
    else:
        out = out.withColumn("asof", asof)
    return out.withColumn("complete", period_end(F.col("period"), freq) <= F.col("asof")).drop("asof")


def series(
    p: DataFrame, name: str, kind: str = "new_or_unknown", category: str = "all", basis: str = "pit", metric: str = "n", freq: str = "Q",
    complete_only: bool = True, level: str | None = None,
) -> DataFrame:
    """period, value: one series of the panel, zero where it has no row, over the panel's complete periods."""
    source = p.where("complete") if complete_only else p
    bounds = source.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).where("lo IS NOT NULL")
    periods = bounds.select(F.explode(grid(F.col("lo"), F.col("hi"), freq)).alias("period"))
    chosen = p.where((F.col("name") == name) & (F.col("kind") == kind) & (F.col("category") == category) & (F.col("basis") == basis))
    if level is not None:
        chosen = chosen.where(F.col("level") == level)
    values = chosen.select("period", F.col(metric).cast("double").alias("value"))
    return periods.join(values, "period", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def kind_counts(kinds: DataFrame, pit_kinds: list[str], hindsight_kinds: list[str]) -> DataFrame:
    """Filings by year: one column for each pit kind, hs_ ones for hindsight, years of either side."""
    year = F.year("date_entered").alias("year")
    pit = kinds.groupBy(year).pivot("pit_kind", pit_kinds).count()
    hindsight = kinds.groupBy(year).pivot("build_kind", hindsight_kinds).count().withColumnsRenamed({k: f"hs_{k}" for k in hindsight_kinds})
    return pit.join(hindsight, "year", "full").fillna(0)


def basis_shares(kinds: DataFrame, bases: list[str]) -> DataFrame:
    """Share of each deciding evidence by year."""
    counts = kinds.groupBy(F.year("date_entered").alias("year"), "pit_basis").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 3))
    return shares.groupBy("year").pivot("pit_basis", bases).agg(F.first("share")).fillna(0.0)


def coverage_ok(p: DataFrame, least: float = 0.5) -> DataFrame:
    """period, n, ok of complete periods: whether the count is at least that share of the median."""
    c = p.where((F.col("level") == "coverage") & F.col("complete")).select("period", "n")
    median = c.agg(F.median("n").alias("median")).withColumn("one", F.lit(1))  # one row
    joined = c.withColumn("one", F.lit(1)).join(F.broadcast(median), "one")
    return joined.select("period", "n", (F.col("n") >= least * F.coalesce("median", F.lit(0.0))).alias("ok"))


def default_start(p: DataFrame, least: float = 0.5, freq: str = "Q") -> DataFrame:
    """start: the first period of the last unbroken run of covered periods; null if the last period is not covered.

    Rows are periods, not filings. A period that is not covered, or a gap, ends a run.
    """
    whole = Window.orderBy("period")
    days = 8 if freq == "W" else 95
    gap = F.coalesce(F.datediff("period", F.lag("period").over(whole)) > days, F.lit(False))
    runs = coverage_ok(p, least).withColumn("breaks", (gap | ~F.col("ok")).cast("int"))
    runs = runs.withColumn("run", F.sum("breaks").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = runs.groupBy("run").agg(F.min(F.when(F.col("ok"), F.col("period"))).alias("start"))
    return firsts.agg(F.max_by("start", "run").alias("start"))
