"""Queries: windows of the pull plan, KPI files, record files, XML and streams, over data made from the test tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.functions.dates import quarter_start
from sitesignal.operators import truth
from sitesignal.plans.register import Register
from sitesignal.session import scratch, table
from sitesignal.sources import case_xml, files, windows
from sitesignal.streaming import upserts

query = Register()


@query(
    """WITH sp AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
    m AS (SELECT k, a, b, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS f FROM sp)
    SELECT k, greatest(f, a) AS start, least(last_day(f), b) AS "end" FROM m"""
)
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda f: f("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(day(F.min).alias("start"), day(F.max).alias("end"))
    return windows.month_windows(spans)


_PLAN = """y AS (SELECT unnest([2021, 2022, 2023]) AS year), m AS (SELECT year, make_date(year, mo, 1) AS start, least(last_day(make_date(year, mo, 1)), DATE '2023-05-17') AS "end" FROM y, (SELECT unnest(generate_series(1, 12)) AS mo) WHERE make_date(year, mo, 1) <= DATE '2023-05-17'),
    t AS (SELECT unnest(['OE', 'NRA']) AS case_type), r AS (SELECT unnest(['AAL', 'ACE', 'AEA', 'AGL', 'ANE', 'ANM', 'ASO', 'ASW', 'AWP', 'WTE', 'WTW']) AS region),
    p AS (SELECT case_type, year, region, start, "end" FROM m, t, r UNION ALL SELECT 'NRA', year, region, make_date(year - 1, 1, 1), make_date(year - 1, 12, 31) FROM y, r)"""


@query(f"WITH {_PLAN} SELECT case_type, CAST(year AS INT) AS year, region, start, \"end\" FROM p WHERE NOT (case_type = 'OE' AND month(start) = 2)")
def backfill_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of three years, of which the log has the February windows of one series."""
    today = date(2023, 5, 17)
    done = windows.plan(spark, [2021, 2022, 2023], today).where("case_type = 'OE' AND month(start) = 2")
    return windows.backfill(spark, 2021, 2024, today, done)


@query(f"WITH {_PLAN} SELECT case_type, CAST(year AS INT) AS year, region, greatest(start, CASE WHEN year(start) = year THEN DATE '2022-11-18' ELSE start END) AS start, \"end\" FROM p WHERE (year(start) <> year AND year = 2023) OR (year(start) = year AND \"end\" >= DATE '2022-11-18')")
def incremental_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.incremental(spark, 180, date(2023, 5, 17))


@query("SELECT DISTINCT ON (n_name) concat(1995 + n_nationkey % 7, 'Q', 1 + n_nationkey % 4) AS quarter, n_name AS entity, make_date(1995 + n_nationkey % 7, 1 + 3 * (n_nationkey % 4), 1) AS period, CAST(n_nationkey AS DOUBLE) / 4 AS value FROM nation ORDER BY n_name, n_regionkey")
def kpi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping KPI files with comments, written and read back, merged: the first file's values stay."""
    n = F.col("n_nationkey")
    label = F.concat((1995 + n % 7).cast("string"), F.lit("-Q"), (1 + n % 4).cast("string"))
    paths = []
    for factor in (1, 2):
        row = F.concat_ws(",", label, "n_name", F.lit("m"), (factor * n / 4).cast("string"), F.lit("usd"), F.lit(""), F.lit('"a, ""b"""'))
        head = spark.createDataFrame([("# a comment",), ("quarter,entity,metric,value,unit,source_url,note",)], "value string")
        paths.append(scratch(spark, "kpi"))
        head.unionByName(table(spark, sf_dir, "nation").select(row.alias("value"))).coalesce(1).write.text(paths[-1])
    merged = truth.merge_kpis(files.read_kpi_parts(spark, paths))
    named = merged.withColumn("period", quarter_start(F.col("quarter")))
    return named.select(F.regexp_replace("quarter", "-", "").alias("quarter"), "entity", "period", "value")


@query("SELECT o_orderkey AS case_id, concat(year(o_orderdate), '-ASO-', o_orderkey, '-OE') AS asn, CAST(year(o_orderdate) AS INT) AS asn_year, CAST(o_orderdate AS DATE) AS date_entered, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 90 AS DOUBLE) / 2 END AS latitude, CASE WHEN o_orderkey % 2 = 0 THEN 'mail.example.org' END AS sponsor_email_domain FROM orders")
def xml_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases written as XML and read back."""
    path = scratch(spark, "xml")
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    mail = F.when(key % 2 == 0, F.lit("Some.One@Mail.Example.ORG"))
    lat = F.when(key % 3 == 0, F.lit("north")).otherwise(((key % 90) / 2).cast("string"))
    out = o.select(
        key.cast("string").alias("id"), F.concat(year, F.lit("-ASO-"), key.cast("string"), F.lit("-OE")).alias("asn"), lat.alias("latitude"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00-05:00")).alias("createdDate"), mail.alias("sponsorEmail"), F.lit("555").alias("sponsorPhone"),
    )
    out.write.option("rowTag", "OECase").option("rootTag", "caseList").format("xml").save(path)
    return case_xml.read_cases(spark, path).select("case_id", "asn", "asn_year", "date_entered", "latitude", "sponsor_email_domain")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream, counted by week: each micro-batch writes the windows that it changed, the last state counts."""
    path = scratch(spark, "stream")
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    upserts.changes(upserts.weekly(stream, "event_type"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return upserts.latest(spark, f"{path}/out", "week", "event_type")


QUERIES, ORACLES = query.queries, query.oracles
