"""The domain's tables, made from the star-schema tables, so that every operator runs on data of any size.

Columns are given as SQL that Spark and DuckDB read alike ({div} is integer division), so that a query and its oracle
start from the same rows; what happens after that is the library on one side and independent SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.operators.rules import Rule, RuleSet
from sitesignal.session import table

_LAT = "35 + ({k} % 600) * CAST(0.0004 AS DOUBLE)"
_LON = "-97 + (((({k} {div} 600) * 151 + {k} * 7) % 400)) * CAST(0.0004 AS DOUBLE)"


def _place(k: str, shift: str = "0") -> dict[str, str]:
    return {"latitude": f"{_LAT} + {shift}".replace("{k}", k), "longitude": _LON.replace("{k}", k)}


CASES = {
    "asn": "o_orderkey",
    "asn_sequence": "o_orderkey",
    "asn_year": "CAST(year(o_orderdate) AS INT)",
    "asn_region": "n_regionkey",
    "asn_type": "o_orderstatus",
    "status_code": "o_orderpriority",
    "sponsor": "c_name",
    "custkey": "o_custkey",
    "date_entered": "CAST(o_orderdate AS DATE)",
    "structure_type": "CASE o_orderkey % 7 WHEN 0 THEN 'TOWER$ANTENNA' WHEN 1 THEN 'pole$mono' WHEN 2 THEN 'TOWER$COW' WHEN 3 THEN 'WATER_TOWER' WHEN 4 THEN 'BUILDING$HIGH' WHEN 5 THEN 'CRANE$WINDMILL' ELSE ' tower ' END",
    "structure_description": "CASE o_orderkey % 9 WHEN 0 THEN 'new raw land site' WHEN 1 THEN 'COLO on tower' WHEN 2 THEN 'existing pole, mod' WHEN 3 THEN 'swap antennas' WHEN 4 THEN 'model change' WHEN 5 THEN 'as-built' ELSE NULL END",
    "date_built": "CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderdate AS DATE) - 100 WHEN 1 THEN CAST(o_orderdate AS DATE) - 10 ELSE NULL END",
    "fcc_asr_number": "CASE o_orderkey % 10 WHEN 0 THEN concat('A0', CAST(1000000 + o_orderkey AS STRING), '.0') WHEN 1 THEN '77' WHEN 2 THEN 'none' ELSE NULL END",
    "agl_structure_height": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(50 + o_orderkey % 97 AS DOUBLE) END",
    **_place("o_orderkey"),
}
REGISTRY = {
    "registration_number": "CAST(1000000 + k AS STRING)",
    "faa_asn": "CASE WHEN k % 6 = 0 THEN k END",
    "overall_height_agl_ft": "CAST(50 + k % 97 + k % 9 AS DOUBLE)",
    "registration_date": "lo",
    "date_constructed": "hi",
    "date_dismantled": "CASE WHEN k % 5 = 0 THEN hi - 400 END",
    "status": "CASE k % 3 WHEN 0 THEN 'constructed' WHEN 1 THEN 'granted' ELSE 'dismantled' END",
    "asr_structure_type": "'TOWER'",
    "asr_owner": "CASE WHEN sup % 7 = 0 THEN NULL ELSE concat('Supplier#', lpad(CAST(sup AS STRING), 9, '0')) END",
    "asr_owner_domain": "CASE sup % 5 WHEN 0 THEN 'mail.crowncastle.com' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'dot.state.tx.us' WHEN 3 THEN NULL ELSE 'example.com' END",
    **_place("k", "CAST(0.0001 AS DOUBLE)"),
}
SHIP = "SELECT l_orderkey AS k, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi, min(l_suppkey) AS sup FROM lineitem GROUP BY l_orderkey"

#: Rules for the stand-in sponsors: normalised names end in digits, and the last one decides.
RULES = RuleSet(
    (
        Rule("0$", "American Tower", "AMT", "tower_reit"),
        Rule("[12]$", "Crown Castle", "CCI", "tower_reit", domains=("crowncastle.com",)),
        Rule("3$", "Verizon", "VZ", "carrier", domains=("verizon.com",)),
        Rule("4$", "The Towers (Vertical Bridge/Verizon JV)", None, "private_towerco"),
        Rule("[56]$", None, None, "consultant"),
        Rule("7$", None, None, "private_towerco", from_name=True),
    ),
    frozenset({"gmail.com"}),
)
_KEY = "custkey % 10"
#: Attribution by RULES, spelled out over the key that the names end in.
ATTRIBUTED = {
    "entity": f"CASE WHEN {_KEY} = 0 THEN 'American Tower' WHEN {_KEY} IN (1, 2) THEN 'Crown Castle' WHEN {_KEY} = 3 THEN 'Verizon' WHEN {_KEY} = 4 THEN 'The Towers (Vertical Bridge/Verizon JV)' WHEN {_KEY} = 7 THEN 'CUSTOMER' END",
    "ticker": f"CASE WHEN {_KEY} = 0 THEN 'AMT' WHEN {_KEY} IN (1, 2) THEN 'CCI' WHEN {_KEY} = 3 THEN 'VZ' END",
    "entity_type": f"CASE WHEN {_KEY} IN (0, 1, 2) THEN 'tower_reit' WHEN {_KEY} = 3 THEN 'carrier' WHEN {_KEY} IN (4, 7) THEN 'private_towerco' WHEN {_KEY} IN (5, 6) THEN 'consultant' END",
    "sponsor_norm": "replace(upper(sponsor), '#', ' ')",
    "category": "CASE asn % 7 WHEN 0 THEN 'tower' WHEN 1 THEN 'monopole' WHEN 2 THEN 'cow' WHEN 3 THEN 'antenna_mount' WHEN 4 THEN 'building' WHEN 5 THEN 'crane' ELSE 'tower' END",
    "is_tower_signal": "asn % 7 IN (0, 1, 6)",
}
#: What the enriched table has besides, by simple rules instead of the operators that have queries of their own.
ENRICHED = {
    "entity_source": "CASE WHEN entity IS NULL THEN NULL WHEN asn % 4 = 0 THEN 'asr_owner' ELSE 'sponsor' END",
    "build_kind": "CASE asn % 5 WHEN 0 THEN 'new_build' WHEN 1 THEN 'unknown' ELSE 'modification' END",
    "asr_owner_entity": "CASE asn % 4 WHEN 0 THEN 'Crown Castle' WHEN 1 THEN 'American Tower' WHEN 2 THEN 'Tall Poles' END",
    "reg": "CASE WHEN asn % 3 = 0 THEN CAST(asn % 500 AS STRING) END",
    "filing_to_construction_days": "CASE WHEN asn % 5 = 0 THEN CAST((asn * 37) % 900 - 30 AS INT) END",
    "pit_kind": "CASE WHEN asn % 3 = 0 THEN 'new_or_unknown' ELSE 'modification' END",
    "pit_basis": "CASE asn % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'keyword' ELSE 'prior_case' END",
    "entity_pit": "CASE WHEN asn % 4 <> 0 THEN entity END",
    "ticker_pit": "CASE WHEN asn % 4 <> 0 THEN ticker END",
    "entity_type_pit": "CASE WHEN asn % 4 <> 0 THEN entity_type END",
    "project_start_pit": "asn % 3 <> 1",
    "project_start_hindsight": "asn % 2 = 0",
    "w": "coalesce(agl_structure_height, CAST(200 AS DOUBLE)) / 200",
}


def _select(df: DataFrame, columns: dict[str, str], keep: bool = False) -> DataFrame:
    return df.select(*["*"] * keep, *[F.expr(x.replace("{div}", "div")).alias(c) for c, x in columns.items()])


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x.replace('{div}', '//')} AS {c}" for c, x in columns.items())


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings: orders with their customers and nations."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return _select(o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")), CASES)


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(cases(spark, sf_dir), ATTRIBUTED, keep=True)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(attributed(spark, sf_dir), ENRICHED, keep=True)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: one for each order that has shipped something."""
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"), F.min("l_suppkey").alias("sup")
    )
    return _select(ship, REGISTRY)


CASES_SQL = f"cases AS (SELECT {_sql(CASES)} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
ATTRIBUTED_SQL = f"{CASES_SQL}, attributed AS (SELECT *, {_sql(ATTRIBUTED)} FROM cases)"
ENRICHED_SQL = f"{ATTRIBUTED_SQL}, enriched AS (SELECT *, {_sql(ENRICHED)} FROM attributed)"
REGISTRY_SQL = f"ship AS ({SHIP}), registry AS (SELECT {_sql(REGISTRY)} FROM ship)"

#: Quarterly KPI: shipped value by return flag, in millions.
KPI_SQL = "kpi AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period, l_returnflag AS entity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)"


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """period, entity, value."""
    exact = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "QUARTER").alias("period"), F.col("l_returnflag").alias("entity")).agg(exact.alias("value"))


#: Year-to-date facts: the running sum of the KPI in its year, filed twice, and a restated one in an odd form.
FACTS_SQL = f"""{KPI_SQL},
    y AS (SELECT entity, period, CAST(date_trunc('year', period) AS DATE) AS start, CAST(period + INTERVAL 3 MONTH AS DATE) - 1 AS "end",
        CAST(sum(CAST(value AS DECIMAL(18, 2))) OVER (PARTITION BY entity, year(period) ORDER BY period) AS DOUBLE) AS value FROM kpi),
    facts AS (
        SELECT entity, start, "end", value, "end" + 40 AS filed, '10-Q' AS form, 0 AS rank, CAST(NULL AS DATE) AS min_end FROM y WHERE NOT (month(period) = 10 AND year(period) % 4 = 1)
        UNION ALL SELECT entity, start, "end", value * 2, "end" + 400, '10-K', 0, NULL FROM y
        UNION ALL SELECT entity, start, "end", value * 3, "end" + 10, '8-K', 0, NULL FROM y
        UNION ALL SELECT entity, start, "end", value * 5, "end" + 20, '10-Q', 1, DATE '1999-01-01' FROM y
    )"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, start, end, value, filed, form, rank, min_end."""
    from pyspark.sql import Window

    k = kpi(spark, sf_dir)
    year = Window.partitionBy("entity", F.year("period")).orderBy("period")
    y = k.select(
        "entity", "period", F.trunc("period", "YEAR").alias("start"), F.date_sub(F.add_months("period", 3), 1).alias("end"),
        F.sum(F.col("value").cast("decimal(18,2)")).over(year).cast("double").alias("value"),
    )
    none = F.lit(None).cast("date")
    kinds = [(1, 40, "10-Q", 0, none), (2, 400, "10-K", 0, none), (3, 10, "8-K", 0, none), (5, 20, "10-Q", 1, F.lit("1999-01-01").cast("date"))]
    rows = F.array(*[F.struct((F.col("value") * m).alias("value"), F.date_add("end", n).alias("filed"), F.lit(f).alias("form"), F.lit(r).alias("rank"), e.alias("min_end"), F.lit(m).alias("m")) for m, n, f, r, e in kinds])
    out = y.select("entity", "period", "start", "end", F.explode(rows).alias("r")).select("entity", "period", "start", "end", "r.*")
    gap = (F.month("period") == 10) & (F.year("period") % 4 == 1) & (F.col("m") == 1)
    return out.where(~gap).drop("m", "period")
