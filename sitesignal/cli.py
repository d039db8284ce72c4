"""Command line: python -m sitesignal COMMAND. The exit code is 1 if a window failed."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesignal.operators import coverage, rules, truth
from sitesignal.operators.backtest import LEAST_TRAIN
from sitesignal.operators.state import Store
from sitesignal.plans import pipeline
from sitesignal.session import build_session
from sitesignal.sources import case_xml, client, files, windows


def quarter(label: str) -> date:
    year, q = label.upper().replace("-", "").split("Q")
    return date(int(year), 3 * int(q) - 2, 1)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sitesignal")
    p.add_argument("--data-dir", default=os.environ.get("SITESIGNAL_DATA", "data"))
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    many = lambda text: text.split(",")

    def pulls(c: argparse.ArgumentParser) -> None:
        c.add_argument("--types", type=many, default=list(windows.CASE_TYPES))
        c.add_argument("--regions", type=many, default=list(windows.REGIONS))
        c.add_argument("--workers", type=int, default=4)

    c = sub.add_parser("backfill", help="pull all windows of some years that are not in the log")
    c.add_argument("--from", dest="first", type=int, required=True)
    c.add_argument("--to", dest="last", type=int, default=date.today().year)
    pulls(c)
    c = sub.add_parser("ingest", help="pull the last days again")
    c.add_argument("--days", type=int, default=180)
    pulls(c)
    c = sub.add_parser("coverage", help="completeness by region and year")
    c.add_argument("--long", action="store_true")
    sub.add_parser("rebuild", help="cases and history anew from the raw answers")
    c = sub.add_parser("entities", help="attribution rates")
    c.add_argument("--unmatched", action="store_true")
    c.add_argument("--top", type=int, default=50)
    c = sub.add_parser("asr", help="registrations and their matches")
    c.add_argument("--archive", help="a registration archive; by default <data>/asr/r_tower.zip, fetched when it is missing or a week old")
    c.add_argument("--force", action="store_true", help="fetch it anyway")
    sub.add_parser("enrich", help="cases with all derived columns")
    c = sub.add_parser("features", help="weekly and quarterly panels")
    c.add_argument("--start", type=date.fromisoformat)
    c.add_argument("--prior-lookback-days", type=int)
    c = sub.add_parser("truth", help="KPI series")
    c.add_argument("--kpis", nargs="*", default=[], help="KPI files; several are merged into <data>/truth/kpis.csv")
    c.add_argument("--no-capex", action="store_true", help="leave the companies' facts out")
    c.add_argument("--refresh", action="store_true", help="fetch the facts anew")
    c = sub.add_parser("backtest", help="lead-lag and forecasts")
    c.add_argument("--start", type=quarter)
    c.add_argument("--end", type=quarter)
    c.add_argument("--min-train", type=int, default=LEAST_TRAIN)
    c = sub.add_parser("report", help="all tables as Markdown")
    c.add_argument("--out", default="reports/summary.md")
    return p


def fetched(url: str) -> tuple[int, bytes]:
    """The status and body of a regulator's answer; SITESIGNAL_AGENT names who asks."""
    try:
        return 200, client.fetch_url(url, 300.0, os.environ.get("SITESIGNAL_AGENT", "sitesignal/0.1 (research)"))
    except client.HttpStatus as e:
        return e.status, b""


def main(argv: list[str] | None = None, source: client.Source | None = None, today: date | None = None, answer: Callable[[str], tuple[int, bytes]] = fetched) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    root, today = Path(a.data_dir).resolve(), today or date.today()
    store, landing = Store(spark, f"file://{root}/tables"), client.Landing(root)
    rule_set = rules.RuleSet.load()

    def fetch(url: str) -> bytes:
        status, body = answer(url)
        if status >= 400:
            raise OSError(f"HTTP {status} for {url}")
        return body

    def snapshots(paths: list[Path], first: int) -> DataFrame:
        """The cases of raw answers with asof, the day in their path, and batch_seq: the number, in the log, of their file."""
        days = [next(x for x in p.parts if x.startswith("asof=")).removeprefix("asof=") for p in paths]
        named = [(p.relative_to(landing.root).as_posix(), date.fromisoformat(day), first + k) for k, (p, day) in enumerate(zip(paths, days, strict=True))]
        names = spark.createDataFrame(named, "file string, asof date, batch_seq long")
        cases = case_xml.read_cases(spark, [f"file://{p}" for p in paths])
        return cases.withColumn("file", F.concat(F.lit("raw/"), F.substring_index(F.input_file_name(), "/raw/", -1))).join(names, "file").drop("file")

    def stage(paths: list[Path]) -> None:
        store.stage(snapshots(paths, sum(len(e["files"]) for e in landing.entries())))

    if a.command in ("backfill", "ingest"):
        entries = [(e["case_type"], e["year"], e["region"], date.fromisoformat(e["start"]), date.fromisoformat(e["end"])) for e in landing.entries()]
        done = spark.createDataFrame(entries, "case_type string, year int, region string, start date, end date")
        which = {"types": a.types, "regions": a.regions}
        todo = windows.backfill(spark, a.first, a.last, today, done, **which) if a.command == "backfill" else windows.incremental(spark, a.days, today, **which)
        stats = client.pull(windows.as_windows(todo), source or client.Client(), landing, today, stage, a.workers)
        store.compact()
        print(f"windows={stats.windows} requests={stats.requests} rows={stats.rows} capped={len(stats.capped)} errors={len(stats.errors)}")
        for line in [f"CAPPED: {w}" for w in stats.capped] + [f"ERROR: {e}" for e in stats.errors]:
            print(line)
        return 1 if stats.errors else 0
    if a.command == "rebuild":
        store.rebuild(snapshots([root / f for e in landing.entries() for f in e["files"]], 0))
        print(f"rebuilt {store.read('cases').count():,} cases")
    elif a.command == "coverage":
        cases = store.read("cases")
        complete = coverage.completeness(cases, coverage.status_groups(cases))
        if a.long:
            complete.orderBy(*coverage.KEYS).show(1000, False)
        years = sorted(r[0] for r in complete.select("asn_year").where("asn_year IS NOT NULL").distinct().collect())
        for kind in windows.CASE_TYPES:
            coverage.completeness_matrix(complete, kind, years).orderBy("asn_region").show(100, False)
    elif a.command == "entities":
        named = rules.classify(rules.attribute(store.read("cases"), rule_set))
        matches = store.read("case_asr")
        if matches is not None:
            named = rules.owner_fallback(named.join(matches.select("asn", "asr_owner_entity", "asr_owner_ticker", "asr_owner_entity_type"), "asn", "left"))
        rules.attribution_rate(named).show()
        rules.attribution_rate(named, F.year("date_entered").alias("year")).orderBy("year").show(100)
        if a.unmatched:
            rules.unmatched(named, a.top).show(a.top, False)
    elif a.command == "asr":
        members = tuple(f"{r}.dat" for r in files.RECORDS)
        archive = Path(a.archive) if a.archive else files.download(files.REGISTRY_URL, root / "asr/r_tower.zip", fetch, force=a.force, members=members)
        folder = files.unpack(archive, root / "asr/records")
        pipeline.match(store, files.read_registrations(spark, f"file://{folder}"), rule_set).groupBy("match_method").count().show()
    elif a.command == "enrich":
        pipeline.enrich(store, rule_set).where("is_tower_signal").groupBy("build_kind", "build_kind_basis").count().show()
    elif a.command == "features":
        pipeline.build_features(store, a.start, lookback_days=a.prior_lookback_days)
    elif a.command == "truth":
        kpis = facts = None
        if a.kpis:
            merged = root / "truth/kpis.csv"
            merged.parent.mkdir(parents=True, exist_ok=True)
            files.write_kpis(truth.merge_kpis(files.read_kpi_parts(spark, [f"file://{Path(k).resolve()}" for k in a.kpis])), merged, files.KPI_NOTE)
            kpis = files.read_kpis(spark, f"file://{merged}")
        if not a.no_capex:
            try:
                facts = files.company_facts(spark, root / "truth", answer, a.refresh)
            except files.Refused as e:
                print(f"capital expenditure is left out: {e}")
        figures = pipeline.load_truth(store, kpis, facts)
        if figures is None:
            print("no figures")
        else:
            truth.coverage_table(figures).orderBy("entity", "metric").show(100, False)
    elif a.command == "backtest":
        tables = pipeline.run_backtest(store, start=a.start, end=a.end, least=a.min_train)
        tables["oos"].orderBy("key").show(100, False)
        tables["skipped"].show(100, False)
    else:
        out = Path(a.out)
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(pipeline.report(store), encoding="utf-8")
        print(f"wrote {out}")
    return 0
