"""The stages from cases to report, on the tables of one data folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.functions.dates import half_label, month_label
from sitesignal.functions.text import empty_to_null
from sitesignal.operators import backtest, buildkind, coverage, features, projects, registry, reports, rules, truth
from sitesignal.operators.state import Store

VIEWS = {"cases": "cases", "case_history": "case_history", "cases_enriched": "cases_enriched", "asr": "asr", "case_asr": "case_asr"}
ASR_COLUMNS = {"registration_number": "asr_registration_number", "match_method": "asr_match_method", "match_distance_m": "asr_match_distance_m"}
WORK = ("asn", "sponsor", "structure_type", "structure_description", "date_entered", "date_built", "fcc_asr_number", "latitude", "longitude")


# The companies whose filings are watched by month, the dates of their tables, and the size of a group
# from which its lags are shown.
WATCHED = ("American Tower", "Crown Castle", "SBA Communications", "Vertical Bridge", features.JOINT_VENTURE)
BASE, AFTER, SINCE, MOVED = (date(2024, 1, 1), date(2025, 12, 31)), date(2026, 1, 1), date(2026, 8, 1), date(2024, 7, 1)
LEAST_LAGS = 40


def match(store: Store, registrations: DataFrame, rule_set: rules.RuleSet) -> DataFrame:
    """Stores the registry and the cases' matches with it (with their owners' entities)."""
    asr = store.write("asr", registrations)
    found = registry.matched_registrations(registry.match_cases(rules.classify(store.read("cases")), asr), asr)
    return store.write("case_asr", rules.join_null_safe(found, rules.owner_entities(found, rule_set), ["asr_owner", "asr_owner_domain"]))


def enrichment(cases: DataFrame, matches: DataFrame, rule_set: rules.RuleSet) -> DataFrame:
    """asn and all derived columns. Owner entities are derived anew, so that changed rules apply to stored matches."""
    owner = ["asr_owner_entity", "asr_owner_ticker", "asr_owner_entity_type"]
    plain = matches.drop(*owner)
    matches = rules.join_null_safe(plain, rules.owner_entities(plain, rule_set), ["asr_owner", "asr_owner_domain"])
    d = rules.attribute(rules.classify(cases.select(*WORK)), rule_set)
    d = rules.owner_fallback(d.join(matches.withColumnsRenamed(ASR_COLUMNS).drop("asr_faa_asn"), "asn", "left"))
    kinds = buildkind.build_kind(d, matches.select("asn", "match_method", "asr_registration_date", "asr_date_constructed"))
    grouped = projects.assign_projects(d.withColumn("project_key", F.coalesce("entity", "sponsor_norm")))
    d = d.join(kinds, "asn", "left").join(grouped, "asn", "left")
    lag = F.when(F.col("build_kind") == "new_build", F.datediff("asr_date_constructed", "date_entered"))
    return d.withColumn("filing_to_construction_days", lag).drop(*[c for c in WORK if c != "asn"])


def enrich(store: Store, rule_set: rules.RuleSet) -> DataFrame:
    """Stores cases with all derived columns."""
    cases = store.read("cases")
    return store.write("cases_enriched", cases.join(enrichment(cases, store.read("case_asr"), rule_set), "asn", "left"))


def build_features(store: Store, start: date | None = None, **pit) -> dict[str, DataFrame]:
    """Stores the weekly and quarterly panels and the point-in-time kinds."""
    enriched = store.read("cases_enriched").where("date_entered IS NOT NULL")
    wanted = sorted({*buildkind.CATEGORIES, *buildkind.PRIOR_CATEGORIES})
    prepared = features.prepare(enriched.where(F.col("category").isin(*wanted)), **pit)
    daily = enriched.groupBy("date_entered").agg(F.count(F.lit(1)).alias("n"))
    out = {f: store.write(name, features.panel(prepared, daily, f, start=start), ("basis",)) for f, name in (("W", "features_weekly"), ("Q", "features_quarterly"))}
    out["kinds"] = store.write("pit_kinds", prepared.select("asn", "date_entered", "category", "entity_pit", "pit_kind", "pit_basis", "build_kind"))
    return out


def load_truth(store: Store, kpis: DataFrame | None, facts: DataFrame | None) -> DataFrame:
    """Stores the ground truth: KPIs and, from facts, capital expenditure. One that is missing is left as it was stored."""
    stored = store.read("truth")
    parts = []
    for new, ours in ((kpis, F.col("source") != "sec_xbrl"), (None if facts is None else truth.capex(facts), F.col("source") == "sec_xbrl")):
        if new is not None:
            parts.append(new.select(*truth.COLUMNS))
        elif stored is not None:
            parts.append(stored.where(ours))
    if not parts:
        return stored
    return store.write("truth", parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0])


def run_backtest(store: Store, pairings: tuple[backtest.Pairing, ...] = backtest.PAIRINGS, start: date | None = None, end: date | None = None, least: int = backtest.LEAST_TRAIN) -> dict[str, DataFrame]:
    """Stores the tables of the backtest; the signal starts with the last unbroken run of covered quarters."""
    panel = store.read("features_quarterly")
    start = start or features.default_start(panel).first()["start"]
    signal = None
    for p in pairings:
        one = features.series(panel, p.signal, kind=p.kind).withColumn("key", F.lit(p.key))
        signal = one if signal is None else signal.unionByName(one)
    truth_rows = store.read("truth")
    if start is not None:
        signal = signal.where(F.col("period") >= F.lit(start))
    if end is not None:
        signal, truth_rows = signal.where(F.col("period") <= F.lit(end)), truth_rows.where(F.col("period") <= F.lit(end))
    tables = backtest.run(signal, truth_rows, pairings, least)
    return {n: store.write(f"backtest_{n}", df) if n != "skipped" else df for n, df in tables.items()}


def watched(tower: DataFrame, owner: str = "Crown Castle", filer: str = "Vertical Bridge", base: tuple[date, date] = BASE, after: date = AFTER, since: date = SINCE, moved: date = MOVED) -> list[tuple[str, DataFrame, int]]:
    """Tables of single companies: filings by month, who follows on one owner's structures, and one filer's owners."""
    digits = F.regexp_replace(F.regexp_replace("fcc_asr_number", r"\D", ""), "^0+", "")
    tower = tower.withColumn("reg", F.coalesce("asr_registration_number", empty_to_null(digits)))
    last = tower.agg(F.max("date_entered")).first()[0]
    if last is None:
        return []
    months = reports.monthly_pivot(tower, [*WATCHED], F.lit(date(last.year - 1, 1, 1)), F.lit(last)).orderBy("month")
    halves = sorted(r[0] for r in tower.where(F.col("date_entered") >= F.lit(moved)).select(half_label(F.col("date_entered"))).distinct().collect())
    return [
        ("Filings by month", months.withColumn("month", month_label(F.col("month"))), 0),
        (f"Later filings on structures of {owner}'s filings", reports.followups(tower, owner, (F.lit(base[0]), F.lit(base[1])), F.lit(after)).orderBy(F.desc("n"), "entity"), 0),
        (f"Filers on structures that {owner} owns", reports.filer_shift(tower, owner, F.lit(moved), halves), 0),
        (f"Owners of structures that {filer} files for", reports.owner_mix(tower, filer, F.lit(since)), 0),
    ]


def report(store: Store) -> str:
    """The tables as Markdown. Stored backtest tables are shown as they are."""
    cases, enriched = store.read("cases"), store.read("cases_enriched")
    tower = enriched.where("is_tower_signal")
    panel = store.read("features_quarterly")
    groups = coverage.status_groups(cases)
    types = sorted(r[0] for r in cases.select("asn_type").where("asn_type IS NOT NULL").distinct().collect())
    parts = [
        ("Completeness by year", coverage.completeness_by_year(coverage.completeness(cases, groups), types).orderBy("asn_year"), 3),
        ("Covered quarters", features.coverage_ok(panel).orderBy("period"), 3),
        ("Attribution by year", reports.attribution_by_year(tower).orderBy("year"), 3),
    ]
    kinds = store.read("pit_kinds")
    if kinds is not None:
        kinds = kinds.where("date_entered IS NOT NULL")
        listed = lambda c: sorted(r[0] for r in kinds.select(c).where(f"{c} IS NOT NULL").distinct().collect())
        parts += [
            ("Build kind, point in time and hindsight", features.kind_counts(kinds, listed("pit_kind"), listed("build_kind")).orderBy("year"), 0),
            ("Evidence for modifications", features.basis_shares(kinds, listed("pit_basis")).orderBy("year"), 3),
        ]
    built = tower.where("filing_to_construction_days >= -30")
    parts += [
        ("Filing to construction", reports.lag_summary(built, None), 0),
        ("Filing to construction by entity", reports.lag_summary(built, "entity", LEAST_LAGS).orderBy(F.desc("n"), "entity").limit(10), 0),
    ]
    figures = store.read("truth")
    if figures is not None:
        parts.append(("KPI series", truth.coverage_table(figures).orderBy("entity", "metric"), 3))
    parts += watched(tower)
    leadlag = store.read("backtest_leadlag")
    if leadlag is not None:
        parts += [(f"Lead-lag, {t}", backtest.wide_lead_lag(leadlag.where(F.col("transform") == t)).orderBy("key"), 2) for t in ("yoy", "level")]
        parts.append(("Out of sample", store.read("backtest_oos").orderBy("key"), 2))
    return "# Filings against reported figures\n\n" + "\n".join(f"## {title}\n\n{reports.markdown(df, digits)}" for title, df, digits in parts)


def publish(spark: SparkSession, store: Store) -> None:
    """Temp views of all stored tables."""
    store.views(VIEWS)
