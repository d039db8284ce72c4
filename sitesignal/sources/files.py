"""Registration archives, KPI tables and regulator facts."""

from __future__ import annotations

import json
import os
import time
import zipfile
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesignal.functions.dates import quarter_start
from sitesignal.functions.text import empty_to_null
from sitesignal.operators.registry import parse_registrations

# Where the archive's records have which field, counted from 0.
RECORDS = {
    "RA": {
        3: "registration_number", 5: "application_purpose", 8: "status_code", 9: "date_entered", 11: "date_issued", 12: "date_constructed",
        13: "date_dismantled", 14: "date_action", 24: "city", 25: "state", 30: "overall_height_agl_m", 31: "overall_height_amsl_m",
        32: "asr_structure_type", 33: "faa_determination_date", 34: "faa_study_number",
    },
    "CO": {3: "registration_number", 5: "coordinate_type", 6: "lat_d", 7: "lat_m", 8: "lat_s", 9: "lat_dir", 11: "lon_d", 12: "lon_m", 13: "lon_s", 14: "lon_dir"},
    "EN": {3: "registration_number", 5: "entity_type", 9: "entity_name", 16: "email"},
    "HS": {3: "registration_number", 5: "date", 6: "event"},
}


def fresh(path: Path, days: float) -> bool:
    """Whether a cached file is younger than that."""
    return path.exists() and time.time() - path.stat().st_mtime < days * 86400


def download(url: str, dest: Path, fetch: Callable[[str], bytes], max_age_days: float = 6.0, force: bool = False, members: tuple[str, ...] = ()) -> Path:
    """dest, fetched anew if it is older; written aside and renamed, after its members have been checked."""
    if not force and fresh(dest, max_age_days):
        return dest
    dest.parent.mkdir(parents=True, exist_ok=True)
    part = dest.with_name(dest.name + ".part")
    part.write_bytes(fetch(url))
    if members:
        with zipfile.ZipFile(part) as z:
            missing = set(members) - set(z.namelist())
        if missing:
            raise ValueError(f"{url} lacks {sorted(missing)}")
    os.replace(part, dest)
    return dest


def unpack(archive: Path, folder: Path) -> Path:
    """The archive's record files in a folder, which Spark can read (it reads no ZIP members)."""
    with zipfile.ZipFile(archive) as z:
        for record in RECORDS:
            z.extract(f"{record}.dat", folder)
    return folder


def read_record(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One record file: fields by position as trimmed text, empty as null, short rows filled with nulls, and `line`.

    Lines are split as text: no quoting, bytes that are not UTF-8 replaced, any number of fields.
    """
    fields = RECORDS[record]
    parts = F.split(F.regexp_replace("value", r"\r$", ""), r"\|")
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.length("value") > 0)
    return lines.select("line", *[empty_to_null(F.trim(F.get(parts, F.lit(k)))).alias(c) for k, c in fields.items()])


def read_registrations(spark: SparkSession, folder: str) -> DataFrame:
    """The registry from a folder of record files."""
    return parse_registrations(*[read_record(spark, f"{folder}/{r}.dat", r) for r in ("RA", "CO", "EN", "HS")])


KPI_NOTE = "# Figures from releases, merged; the first of equal quarter, entity and metric stays. Missing quarters are absent.\n"
KPI_SCHEMA = "quarter string, entity string, metric string, value double, unit string, source_url string, note string"


def read_kpis(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """KPI CSV files (with # comments): their columns, period and source."""
    df = spark.read.csv(path, schema=KPI_SCHEMA, header=True, comment="#", quote='"', escape='"')
    return df.withColumns({"period": quarter_start(F.col("quarter")), "source": F.lit("kpi_csv")})


def read_kpi_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw KPI files with `file` and `line`, for merge_kpis."""
    parts = [spark.read.csv(p, schema=KPI_SCHEMA, header=True, comment="#", quote='"', escape='"').withColumns({"file": F.lit(k), "line": F.monotonically_increasing_id()}) for k, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_kpis(df: DataFrame, dest: Path, header: str) -> None:
    """A curated KPI file, which is a few hundred rows, with a comment on top."""
    import csv

    with dest.open("w", encoding="utf-8", newline="") as f:
        f.write(header)
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.orderBy("entity", "metric", "quarter").collect())


# The regulator's services, and by company the number it files under and the concepts of its capital
# expenditure, best first; one counts from the date beside it on.
FACTS_URL = "https://data.sec.gov/api/xbrl/companyfacts/CIK{cik}.json"
REGISTRY_URL = "https://data.fcc.gov/download/pub/uls/complete/r_tower.zip"
CAPEX = {
    "VZ": ("0000732712", [("PaymentsToAcquirePropertyPlantAndEquipment", None), ("PaymentsToAcquireProductiveAssets", None), ("PaymentsToAcquireOtherProductiveAssets", date(2017, 1, 1))]),
    "T": ("0000732717", [("PaymentsToAcquirePropertyPlantAndEquipment", None), ("PaymentsToAcquireProductiveAssets", None)]),
    "TMUS": ("0001283699", [("PaymentsToAcquirePropertyPlantAndEquipment", None)]),
}

FACT = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()), T.StructField("val", T.DoubleType()),
    T.StructField("filed", T.StringType()), T.StructField("form", T.StringType()),
])
FACTS = T.StructType([T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("units", T.MapType(T.StringType(), T.ArrayType(FACT)))]))))])


def read_facts(spark: SparkSession, paths: dict[str, str], concepts: dict[str, list[tuple[str, date | None]]]) -> DataFrame:
    """entity, start, end, value, filed, form, rank, min_end, concept for the concepts of each entity, best first."""
    wanted = spark.createDataFrame([(e, c, k, m) for e, cs in concepts.items() for k, (c, m) in enumerate(cs)], "entity string, concept string, rank int, min_end date")
    out = None
    for entity, path in paths.items():
        raw = spark.read.schema(FACTS).option("multiLine", True).json(path)
        usd = raw.select(F.explode(F.col("facts")["us-gaap"]).alias("concept", "c")).select("concept", F.explode(F.col("c.units")["USD"]).alias("f"))
        rows = usd.select(F.lit(entity).alias("entity"), "concept", F.to_date("f.start").alias("start"), F.to_date("f.end").alias("end"), F.col("f.val").alias("value"), F.to_date("f.filed").alias("filed"), "f.form")
        out = rows if out is None else out.unionByName(rows)
    return out.join(F.broadcast(wanted), ["entity", "concept"])


class Refused(RuntimeError):
    """The regulator's service turned a request down."""


def cached_facts(url: str, dest: Path, fetch: Callable[[str], tuple[int, bytes]], max_age_days: float = 7.0, refresh: bool = False) -> dict:
    """Facts from a cached file, or fetched; 403 and 429 raise Refused."""
    if not refresh and fresh(dest, max_age_days):
        return json.loads(dest.read_text(encoding="utf-8"))
    status, body = fetch(url)
    if status in (403, 429):
        raise Refused(f"HTTP {status} for {url}: set a user agent that names you")
    if status >= 400:
        raise OSError(f"HTTP {status} for {url}")
    dest.parent.mkdir(parents=True, exist_ok=True)
    dest.write_bytes(body)
    return json.loads(body)


def company_facts(spark: SparkSession, folder: Path, fetch: Callable[[str], tuple[int, bytes]], refresh: bool = False) -> DataFrame:
    """read_facts of all companies in CAPEX, from files in folder that are fetched where they are missing or old."""
    paths = {}
    for entity, (cik, _) in CAPEX.items():
        dest = folder / f"companyfacts_CIK{cik}.json"
        cached_facts(FACTS_URL.format(cik=cik), dest, fetch, refresh=refresh)
        paths[entity] = f"file://{dest}"
    return read_facts(spark, paths, {e: concepts for e, (_, concepts) in CAPEX.items()})


def last_line_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last row in file order of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc("line"))
    return df.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", "line")
