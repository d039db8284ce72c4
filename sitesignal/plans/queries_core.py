"""Queries: coverage, names and rules, distances and matching, build kinds, projects, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesignal.functions import text
from sitesignal.functions.geo import EARTH_RADIUS_M, cell_degrees, haversine_m
from sitesignal.operators import buildkind, coverage, projects, registry, rules, spatial, state
from sitesignal.plans import standins as s
from sitesignal.plans.register import Register
from sitesignal.session import table

query = Register()
STATUS = ("1", "2", "3", "4", "5")
YEARS = tuple(range(1995, 2002))

_COUNTS = ", ".join(f"count(*) FILTER (WHERE split_part(status_code, '-', 1) = '{g}') AS n_{g}" for g in STATUS)
_COMPLETE = f"""complete AS (SELECT asn_region, asn_year, asn_type, count(*) AS n_cases, count(DISTINCT asn_sequence) AS n_distinct_seq, min(asn_sequence) AS min_seq,
    max(asn_sequence) AS max_seq, {_COUNTS}, round(count(DISTINCT asn_sequence) / max(asn_sequence), 3) AS completeness FROM cases GROUP BY asn_region, asn_year, asn_type)"""


@query(f"WITH {s.CASES_SQL}, {_COMPLETE} SELECT * FROM complete")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.completeness(s.cases(spark, sf_dir), STATUS)


@query(
    f"WITH {s.CASES_SQL}, {_COMPLETE} SELECT asn_region, "
    + ", ".join(f'max(CASE WHEN asn_year = {y} THEN completeness END) AS "{y}"' for y in YEARS)
    + " FROM complete WHERE asn_type = 'O' GROUP BY asn_region"
)
def completeness_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.completeness_matrix(coverage.completeness(s.cases(spark, sf_dir), STATUS), "O", YEARS)


@query(
    f"WITH {s.CASES_SQL}, {_COMPLETE} SELECT asn_year, "
    + ", ".join(
        f"CAST(sum(n_cases) FILTER (WHERE asn_type = '{t}') AS BIGINT) AS cases_{t}, round(sum(n_distinct_seq) FILTER (WHERE asn_type = '{t}') / sum(max_seq) FILTER (WHERE asn_type = '{t}'), 3) AS completeness_{t}"
        for t in "FOP"
    )
    + " FROM complete GROUP BY asn_year"
)
def completeness_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.completeness_by_year(coverage.completeness(s.cases(spark, sf_dir), STATUS), "FOP")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.weekly_counts(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), "event_type", "day")


@query(f"WITH {s.CASES_SQL} SELECT asn_type, status_code, count(*) AS n FROM cases GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.status_counts(s.cases(spark, sf_dir))


@query(
    f"""WITH {s.CASES_SQL} SELECT coalesce(split_part(status_code, '-', 1), 'NONE') AS status_group,
    CASE WHEN contains(upper(structure_type), 'WIND') THEN 'WINDMILL' ELSE trim(split_part(upper(structure_type), '$', 1)) END AS structure_group, count(*) AS n FROM cases GROUP BY ALL"""
)
def code_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [text.status_group(F.col("status_code")).alias("status_group"), text.structure_group(F.col("structure_type")).alias("structure_group")]
    return s.cases(spark, sf_dir).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {s.ATTRIBUTED_SQL} SELECT structure_type, category, is_tower_signal, count(*) AS n FROM attributed GROUP BY ALL")
def classify_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(s.cases(spark, sf_dir)).groupBy("structure_type", "category", "is_tower_signal").agg(F.count(F.lit(1)).alias("n"))


_SHAPES = [
    "concat('Acme Towers ', CAST(c_custkey % 50 AS STRING), ' LLC (CK-MD)')", "concat('  crown  castle usa.nb ', '')", "concat('Verizon Wireless - CS', CAST(c_custkey % 3 AS STRING))",
    "'AT&T Mobility, LLC-REGULATORY'", "concat('Bob''s Poles DBA Tall Co Inc - x (y)_MJ', '')", "concat('T-MOBILE USA MR ', '')", "c_name", "'...'", "NULL",
]
_SHAPE = "CASE c_custkey % 9 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_SHAPES)) + " END"


def _stripped(rounds: int) -> str:
    """The stripping rounds for an engine without look-behind."""
    x = "trim(regexp_replace(upper(name), '\\s+', ' ', 'g'))"
    for _ in range(rounds):
        for pattern, by in (
            (r"\s*\([^()]*\)\s*$", ""), (r"\s+[-~_]\s*[A-Z0-9.&'' ]{1,15}$", ""), (r"(\bUSA|\bLLC|\bINC)\s*[-.,_~]\s*[A-Z0-9.&'' ]{1,15}$", r"\1"),
            (r"(\bUSA)\s+[A-Z]{1,3}$", r"\1"), (r"_[A-Z]{1,4}$", ""), (r"[\s\-~_.,]+$", ""),
        ):
            x = f"trim(regexp_replace({x}, '{pattern}', '{by}'))"
    return x


_LEGAL = text.LEGAL_SUFFIXES.replace("'", "''")


@query(
    f"""WITH n AS (SELECT c_custkey, {_SHAPE} AS name FROM customer), a AS (SELECT c_custkey, name, {_stripped(4)} AS x FROM n),
    b AS (SELECT c_custkey, name, nullif(trim(regexp_replace(regexp_replace(regexp_replace(x, '[&''’]', '', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS norm FROM a),
    c AS (SELECT *, trim(regexp_replace(norm, '\\b(D B A|DBA)\\b.*$', '')) AS head FROM b)
    SELECT c_custkey, name, norm, coalesce(nullif(trim(regexp_replace(head, '{_LEGAL}', '')), ''), head) AS base FROM c"""
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SHAPE).alias("name"))
    names = named.select("name").distinct().withColumn("norm", text.normalize_name(F.col("name")))  # once for each name
    names = names.withColumn("base", text.base_name(F.col("norm")))
    return rules.join_null_safe(named, names, ["name"]).select("c_custkey", "name", "norm", "base")


@query(
    f"""WITH {s.CASES_SQL} SELECT asn, ltrim(regexp_replace(regexp_replace(fcc_asr_number, '\\.0+$', ''), '\\D', '', 'g'), '0') AS number_raw,
    nullif(ltrim(regexp_replace(regexp_replace(fcc_asr_number, '\\.0+$', ''), '\\D', '', 'g'), '0'), '') AS number,
    CASE WHEN asn % 3 = 2 THEN NULL ELSE concat(CAST(CASE WHEN asn % 3 = 0 THEN 1900 + 90 + asn % 10 ELSE 2000 + asn % 50 END AS STRING), '-ACE-', CAST(asn % 900 AS STRING), '-OE') END AS study FROM cases"""
)
def normalize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k = F.col("asn")
    year = F.when(k % 3 == 0, (90 + k % 10).cast("string")).when(k % 3 == 1, two(k % 50)).otherwise(F.lit("N/A"))
    study = F.concat(F.lit(" "), year, F.lit("-ace-"), F.lpad((k % 900).cast("string"), 4, "0"), F.lit("-OE "))
    number = text.normalize_number(F.col("fcc_asr_number"))
    raw = F.when(F.col("fcc_asr_number").isNotNull(), F.coalesce(number, F.lit("")))
    return s.cases(spark, sf_dir).select("asn", raw.alias("number_raw"), number.alias("number"), text.normalize_study(study).alias("study"))


@query(
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS asn_year, 'ASO' AS asn_region, o_orderkey AS asn_sequence, CASE WHEN o_orderkey % 2 = 0 THEN 'OE' ELSE 'NRA' END AS asn_type FROM orders WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0"""
)
def case_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    number = F.concat_ws("-", F.year("o_orderdate").cast("string"), F.when(key % 3 == 0, F.lit("x1")).otherwise(F.lit("ASO")), key.cast("string"), F.when(key % 2 == 0, F.lit("OE")).otherwise(F.lit("NRA")))
    return o.select("o_orderkey", *[c.alias(n) for n, c in text.case_number(number).items()])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 3 THEN NULL WHEN s_suppkey % 4 = 2 THEN NULL ELSE concat('mail', CAST(s_suppkey % 10 AS STRING), '.example.org') END AS domain FROM supplier")
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    mail = F.when(k % 4 == 0, F.concat(F.lit("Me@x@ Mail"), (k % 10).cast("string"), F.lit(".Example.ORG "))).when(k % 4 == 1, F.concat(F.lit("a@mail"), (k % 10).cast("string"), F.lit(".example.org"))).when(k % 4 == 2, F.lit("nobody"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.email_domain(mail).alias("domain"))


@query(
    f"""WITH {s.ATTRIBUTED_SQL} SELECT asn, sponsor_norm, CASE WHEN custkey % 10 = 7 THEN 'CUSTOMER' ELSE entity END AS entity, ticker, entity_type,
    CASE WHEN entity IS NOT NULL THEN 'sponsor' END AS entity_source FROM attributed"""
)
def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribute(s.cases(spark, sf_dir), s.RULES).select("asn", "sponsor_norm", "entity", "ticker", "entity_type", "entity_source")


_OWNER = """owners AS (SELECT DISTINCT asr_owner, asr_owner_domain FROM registry),
    o1 AS (SELECT *, CAST(right(asr_owner, 1) AS INT) AS d, CASE WHEN asr_owner IS NOT NULL THEN replace(upper(asr_owner), '#', ' ') END AS norm,
        asr_owner_domain = 'mail.crowncastle.com' AS crown, asr_owner_domain = 'dot.state.tx.us' AS gov FROM owners),
    o2 AS (SELECT *, CASE WHEN d = 0 THEN 'American Tower' WHEN d IN (1, 2) THEN 'Crown Castle' WHEN d = 3 THEN 'Verizon' WHEN d = 4 THEN 'The Towers (Vertical Bridge/Verizon JV)' WHEN d = 7 THEN 'SUPPLIER' END AS ne,
        CASE WHEN d = 0 THEN 'AMT' WHEN d IN (1, 2) THEN 'CCI' WHEN d = 3 THEN 'VZ' END AS nt,
        CASE WHEN d IN (0, 1, 2) THEN 'tower_reit' WHEN d = 3 THEN 'carrier' WHEN d IN (4, 7) THEN 'private_towerco' WHEN d IN (5, 6) THEN 'consultant' END AS nk FROM o1),
    o3 AS (SELECT asr_owner, asr_owner_domain, CASE WHEN crown THEN 'Crown Castle' WHEN ne IS NOT NULL THEN ne WHEN norm IS NOT NULL AND coalesce(nk, '') <> 'consultant' THEN 'SUPPLIER' END AS asr_owner_entity,
        CASE WHEN crown THEN 'CCI' WHEN ne IS NOT NULL THEN nt END AS asr_owner_ticker,
        CASE WHEN crown THEN 'tower_reit' WHEN ne IS NOT NULL THEN nk WHEN norm IS NOT NULL AND coalesce(nk, '') <> 'consultant' THEN CASE WHEN gov THEN 'government' ELSE coalesce(nk, 'other') END END AS asr_owner_entity_type FROM o2)"""


@query(f"WITH {s.REGISTRY_SQL}, {_OWNER} SELECT registration_number, r.asr_owner, r.asr_owner_domain, asr_owner_entity, asr_owner_ticker, asr_owner_entity_type FROM registry r JOIN o3 ON r.asr_owner IS NOT DISTINCT FROM o3.asr_owner AND r.asr_owner_domain IS NOT DISTINCT FROM o3.asr_owner_domain")
def owner_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.registry(spark, sf_dir).select("registration_number", "asr_owner", "asr_owner_domain")
    return rules.join_null_safe(r, rules.owner_entities(r, s.RULES), ["asr_owner", "asr_owner_domain"])


_FALLBACK = """joined AS (SELECT a.asn, a.entity AS e, a.ticker AS t, a.entity_type AS k, CASE WHEN a.entity IS NOT NULL THEN 'sponsor' END AS src, a.is_tower_signal, a.sponsor, a.sponsor_norm, asr_owner_entity AS oe, asr_owner_ticker AS ot, asr_owner_entity_type AS ok
        FROM attributed a LEFT JOIN registry r ON r.registration_number = CAST(1000000 + a.asn AS STRING) LEFT JOIN o3 ON r.asr_owner IS NOT DISTINCT FROM o3.asr_owner AND r.asr_owner_domain IS NOT DISTINCT FROM o3.asr_owner_domain AND r.registration_number IS NOT NULL),
    fb AS (SELECT asn, is_tower_signal, sponsor, sponsor_norm, e IS NULL AND oe IS NOT NULL AS u, CASE WHEN u THEN oe ELSE e END AS entity, CASE WHEN u THEN ot ELSE t END AS ticker, CASE WHEN u THEN ok ELSE k END AS entity_type, CASE WHEN u THEN 'asr_owner' ELSE src END AS entity_source FROM joined)"""
_FB = f"WITH {s.ATTRIBUTED_SQL}, {s.REGISTRY_SQL}, {_OWNER}, {_FALLBACK}"


def _with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.registry(spark, sf_dir).select("registration_number", "asr_owner", "asr_owner_domain")
    owned = rules.join_null_safe(r, rules.owner_entities(r, s.RULES), ["asr_owner", "asr_owner_domain"])
    base = rules.classify(rules.attribute(s.cases(spark, sf_dir), s.RULES))
    number = (F.col("asn") + 1000000).cast("string")
    return rules.owner_fallback(base.withColumn("__n", number).join(owned, F.col("__n") == F.col("registration_number"), "left"))


@query(f"{_FB} SELECT asn, entity, ticker, entity_type, entity_source FROM fb")
def owner_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_owner(spark, sf_dir).select("asn", "entity", "ticker", "entity_type", "entity_source")


@query(
    f"""{_FB} SELECT CAST(asn % 12 AS BIGINT) AS part, count(*) AS n, count(entity) AS n_attributed, round(avg(CASE WHEN entity IS NOT NULL THEN 1e0 ELSE 0e0 END), 3) AS rate,
    round(avg(CASE WHEN entity_source = 'sponsor' THEN 1e0 ELSE 0e0 END), 3) AS rate_sponsor_only, round(avg(CASE WHEN ticker IS NOT NULL THEN 1e0 ELSE 0e0 END), 3) AS rate_listed FROM fb WHERE is_tower_signal GROUP BY ALL"""
)
def attribution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribution_rate(_with_owner(spark, sf_dir), (F.col("asn") % 12).alias("part"))


@query(
    f"""WITH {s.ATTRIBUTED_SQL}, t AS (SELECT * FROM attributed WHERE is_tower_signal)
    SELECT coalesce(sponsor_norm, '<no sponsor>') AS sponsor_norm, count(*) AS n, mode(sponsor ORDER BY sponsor) AS example, coalesce(bool_or(entity_type = 'consultant'), false) AS consultant,
    round(count(*) / (SELECT count(*) FROM t), 4) AS share FROM t WHERE entity IS NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50"""
)
def unmatched_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unmatched(rules.classify(rules.attribute(s.cases(spark, sf_dir), s.RULES)), 50)


_HOST_RULES = rules.RuleSet((rules.Rule("^$", "Example Org", None, "other", domains=("example.org",)), rules.Rule("^$", "Example", "EX", "other", domains=("example.com", "blog.example.org"))), frozenset({"example.net"}))


@query(
    """WITH h AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '') AS host FROM pages)
    SELECT page_id, host, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'Example Org' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'Example' END AS domain_entity,
    CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'EX' END AS domain_ticker,
    CASE WHEN regexp_matches(host, '(^|\\.)example\\.(org|com)$') THEN 'other' WHEN regexp_matches(host, '\\.gov$|\\.mil$') THEN 'government' END AS domain_type FROM h"""
)
def domain_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))
    found = rules.match_domains(hosts.select("host").where("host IS NOT NULL").distinct(), _HOST_RULES, "host")
    return hosts.join(found, "host", "left").select("page_id", "host", "domain_entity", "domain_ticker", "domain_type")


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer), n AS (SELECT CASE WHEN n_nationkey = 5 THEN NULL ELSE n_nationkey END AS k, n_name FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey = 5)
    SELECT c_custkey, c.k, n_name FROM c LEFT JOIN n ON c.k IS NOT DISTINCT FROM n.k"""
)
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("k"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0 OR n_nationkey = 5").select(F.when(F.col("n_nationkey") != 5, F.col("n_nationkey")).alias("k"), "n_name")
    return rules.join_null_safe(c, F.broadcast(n), ["k"])  # nations: a fixed list


_HAVERSINE = "2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return _HAVERSINE.format(a=a, b=b, c=c, d=d)


@query(f"WITH {s.CASES_SQL} SELECT asn, round({_hav('latitude', 'longitude', '35.1e0', '-96.9e0')}, 1) AS distance_m FROM cases")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.cases(spark, sf_dir).select("asn", F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.lit(35.1), F.lit(-96.9)), 1).alias("distance_m"))


@query(
    f"""WITH {s.CASES_SQL}, g AS (SELECT asn, latitude, longitude, CAST(floor(latitude / 0.002e0) AS BIGINT) AS gy, CAST(floor(longitude / 0.002e0) AS BIGINT) AS gx FROM cases),
    o AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT asn, latitude, longitude, gy + o1.d AS gy, gx + o2.d AS gx FROM g, o o1, o o2)
    SELECT a.asn, count(*) AS n, CAST(sum(b.asn) AS BIGINT) AS others FROM n a JOIN g b USING (gy, gx) WHERE {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 100 GROUP BY a.asn"""
)
def pairs_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.cases(spark, sf_dir).select("asn", "latitude", "longitude")
    return spatial.pairs_within(c, c, 100.0).groupBy("asn").agg(F.count(F.lit(1)).alias("n"), F.sum("asn_r").alias("others"))


_PRIOR = f"""g AS (SELECT asn, category, date_entered, latitude, longitude, CAST(floor(latitude / 0.002e0) AS BIGINT) AS gy, CAST(floor(longitude / 0.002e0) AS BIGINT) AS gx FROM attributed),
    o AS (SELECT unnest([-1, 0, 1]) AS d), n AS (SELECT asn, category, date_entered, latitude, longitude, gy + o1.d AS gy, gx + o2.d AS gx FROM g, o o1, o o2),
    prior AS (SELECT a.asn, count(*) AS n_prior_cases FROM n a JOIN g b USING (gy, gx) WHERE a.category IN ('tower', 'monopole', 'cow') AND b.category IN ('tower', 'monopole', 'antenna_mount')
        AND b.date_entered <= a.date_entered - 60 AND {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 100 GROUP BY a.asn)"""


@query(f"WITH {s.ATTRIBUTED_SQL}, {_PRIOR} SELECT * FROM prior")
def prior_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rules.classify(s.cases(spark, sf_dir))
    return spatial.prior_cases(c.where(F.col("category").isin(*buildkind.CATEGORIES)), c.where(F.col("category").isin(*buildkind.PRIOR_CATEGORIES)))


_MATCH = f"""keyed AS (SELECT *, nullif(ltrim(regexp_replace(regexp_replace(fcc_asr_number, '\\.0+$', ''), '\\D', '', 'g'), '0'), '') AS key FROM attributed),
    m1 AS (SELECT asn, registration_number, 'asr_number' AS match_method, round({_hav('c.latitude', 'c.longitude', 'r.latitude', 'r.longitude')}, 1) AS match_distance_m FROM keyed c JOIN registry r ON c.key = r.registration_number),
    m2 AS (SELECT c.asn, min(registration_number) AS registration_number, 'faa_study' AS match_method, arg_min(round({_hav('c.latitude', 'c.longitude', 'r.latitude', 'r.longitude')}, 1), registration_number) AS match_distance_m FROM keyed c JOIN registry r ON c.asn = r.faa_asn WHERE c.asn NOT IN (SELECT asn FROM m1) GROUP BY c.asn),
    pr AS (SELECT c.asn, r.registration_number, {_hav('c.latitude', 'c.longitude', 'r.latitude', 'r.longitude')} AS d FROM (SELECT *, floor(latitude / 0.001e0) AS gy FROM keyed) c JOIN (SELECT *, floor(latitude / 0.001e0) + k AS gy FROM registry, (SELECT unnest([-1, 0, 1]) AS k)) r ON c.gy = r.gy
        WHERE abs(c.latitude - r.latitude) < 0.001e0 AND abs(c.longitude - r.longitude) < 0.002e0 AND c.asn NOT IN (SELECT asn FROM m1) AND c.asn NOT IN (SELECT asn FROM m2) AND c.category IN ('tower', 'monopole', 'cow', 'antenna_mount') AND c.agl_structure_height IS NOT NULL
        AND abs(c.agl_structure_height - r.overall_height_agl_ft) <= 0.1e0 * greatest(c.agl_structure_height, r.overall_height_agl_ft)),
    m3 AS (SELECT asn, registration_number, 'proximity' AS match_method, round(d, 1) AS match_distance_m FROM (SELECT *, row_number() OVER (PARTITION BY asn ORDER BY d, registration_number DESC) AS rn FROM pr WHERE d <= 50) WHERE rn = 1),
    matches AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)"""
_MATCHED = f"WITH {s.ATTRIBUTED_SQL}, {s.REGISTRY_SQL}, {_MATCH}"


@query(f"{_MATCHED} SELECT * FROM matches")
def tiered_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.match_cases(rules.classify(s.cases(spark, sf_dir)), s.registry(spark, sf_dir))


@query(
    f"""{_MATCHED}, j AS (SELECT a.category, fcc_asr_number IS NOT NULL AS h, coalesce(match_method, '') AS m FROM attributed a LEFT JOIN matches USING (asn))
    SELECT category, count(*) AS n, round(avg(CAST(h AS INT)), 3) AS has_asr_number, round(avg(CAST(m = 'asr_number' AS INT)), 3) AS by_number, round(avg(CAST(m = 'faa_study' AS INT)), 3) AS by_study,
    round(avg(CAST(m = 'proximity' AS INT)), 3) AS by_proximity, round(avg(CAST(m <> '' AS INT)), 3) AS matched FROM j GROUP BY category"""
)
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rules.classify(s.cases(spark, sf_dir))
    return registry.match_summary(c, registry.match_cases(c, s.registry(spark, sf_dir)))


@query(
    f"""WITH {s.REGISTRY_SQL}, own AS (SELECT registration_number, CAST(registration_number AS BIGINT) // 500 AS bin, least(registration_date, date_constructed - 30, date_dismantled) AS own FROM registry),
    est AS (SELECT bin, max(e) OVER (ORDER BY bin) AS e FROM (SELECT bin, quantile_disc(own, 0.1) AS e FROM own GROUP BY bin))
    SELECT registration_number, least(own, e) AS registration_date FROM own JOIN est USING (bin)"""
)
def registry_date_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.registry(spark, sf_dir).select("registration_number", F.col("registration_date").alias("first_history_date"), F.date_sub("date_constructed", 30).alias("date_entered"), F.col("date_dismantled").alias("date_issued"))
    return registry.estimate_dates(r).select("registration_number", "registration_date")


_KEYWORDS = text.EXISTING_KEYWORDS
_KINDS = f"""mr AS (SELECT asn, match_method, registration_date, date_constructed, date_dismantled FROM matches JOIN registry USING (registration_number)),
    k0 AS (SELECT a.asn, CASE WHEN registration_date < date_entered - 365 THEN 'existing' WHEN date_constructed < date_entered - 30 THEN 'existing' WHEN match_method IS NOT NULL THEN 'new' END AS bk_asr,
        CASE WHEN date_built < date_entered - 30 THEN 'existing' END AS bk_faa_built, CASE WHEN regexp_matches(upper(coalesce(structure_description, '')), '{_KEYWORDS}') THEN 'existing' END AS bk_keyword,
        CASE WHEN n_prior_cases > 0 THEN 'existing' END AS bk_prior_case, CASE WHEN fcc_asr_number IS NOT NULL AND match_method IS NULL THEN 'existing' END AS bk_asr_number
        FROM attributed a LEFT JOIN mr USING (asn) LEFT JOIN prior USING (asn) WHERE category IN ('tower', 'monopole', 'cow')),
    kinds AS (SELECT *, CASE coalesce(bk_asr, bk_faa_built, bk_keyword, bk_prior_case, bk_asr_number) WHEN 'existing' THEN 'modification' WHEN 'new' THEN 'new_build' ELSE 'unknown' END AS build_kind,
        CASE WHEN bk_asr IS NOT NULL THEN 'asr' WHEN bk_faa_built IS NOT NULL THEN 'faa_built' WHEN bk_keyword IS NOT NULL THEN 'keyword' WHEN bk_prior_case IS NOT NULL THEN 'prior_case' WHEN bk_asr_number IS NOT NULL THEN 'asr_number' ELSE 'none' END AS build_kind_basis FROM k0)"""
_KIND = f"{_MATCHED}, {_PRIOR}, {_KINDS}"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = rules.classify(s.cases(spark, sf_dir))
    r = s.registry(spark, sf_dir)
    matched = registry.matched_registrations(registry.match_cases(c, r), r)
    return buildkind.build_kind(c, matched.select("asn", "match_method", "asr_registration_date", "asr_date_constructed"))


@query(f"{_KIND} SELECT * FROM kinds")
def build_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir)


_PAIRS = [(a, b) for i, a in enumerate(buildkind.SIGNALS) for b in buildkind.SIGNALS[i + 1 :]]


@query(f"{_KIND} " + " UNION ALL ".join(f"SELECT '{a}' AS signal_a, '{b}' AS signal_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_both, count(*) FILTER (WHERE {a} = {b}) AS n_agree, round(count(*) FILTER (WHERE {a} = {b}) / nullif(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL), 0), 3) AS agree_rate FROM kinds" for a, b in _PAIRS))
def signal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildkind.signal_agreement(_kinds(spark, sf_dir))


@query(f"{_KIND} " + " UNION ALL ".join(f"SELECT '{a}' AS signal, count(*) FILTER (WHERE {a} = 'existing') AS n_existing, count(*) FILTER (WHERE {a} = 'new') AS n_new, round(count({a}) / greatest(count(*), 1), 3) AS share_fired FROM kinds" for a in buildkind.SIGNALS))
def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildkind.signal_coverage(_kinds(spark, sf_dir))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their own order's registration."""
    r = s.registry(spark, sf_dir).select((F.col("registration_number").cast("bigint") - 1000000).alias("asn"), F.col("registration_date").alias("asr_registration_date"), F.col("date_constructed").alias("asr_date_constructed"), F.col("date_dismantled").alias("asr_date_dismantled"))
    return rules.classify(s.cases(spark, sf_dir)).join(r, "asn", "left")


@query(
    f"""WITH {s.ATTRIBUTED_SQL}, {s.REGISTRY_SQL}, {_PRIOR}, kn AS (SELECT a.*, registration_date AS rd, date_constructed AS dc, date_dismantled AS dd FROM attributed a LEFT JOIN registry r ON r.registration_number = CAST(1000000 + a.asn AS STRING) WHERE category IN ('tower', 'monopole', 'cow')),
    e AS (SELECT asn, coalesce((dd IS NULL OR dd >= date_entered) AND rd < date_entered - 365, false) AS asr_registered, coalesce((dd IS NULL OR dd >= date_entered) AND dc < date_entered - 30, false) AS asr_constructed,
        coalesce(date_built < date_entered - 30, false) AS faa_built, regexp_matches(upper(coalesce(structure_description, '')), '{_KEYWORDS}') AS keyword, coalesce(n_prior_cases, 0) > 0 AS prior_case FROM kn LEFT JOIN prior USING (asn))
    SELECT *, CASE WHEN asr_registered THEN 'asr_registered' WHEN asr_constructed THEN 'asr_constructed' WHEN faa_built THEN 'faa_built' WHEN keyword THEN 'keyword' WHEN prior_case THEN 'prior_case' ELSE 'none' END AS pit_basis,
    CASE WHEN asr_registered OR asr_constructed OR faa_built OR keyword OR prior_case THEN 'modification' ELSE 'new_or_unknown' END AS pit_kind FROM e"""
)
def pit_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildkind.pit_kind(_known(spark, sf_dir))


_HIGH, _WIDE = cell_degrees(projects.RADIUS_M)
_FAR = f"2 * {EARTH_RADIUS_M} * asin(sqrt(least(1e0, pow(sin((x.phi - me.phi) / 2), 2) + cos(me.phi) * cos(x.phi) * pow(sin((x.lam - me.lam) / 2), 2))))"
_ME = "{'asn': u.asn, 'day': u.day, 'line': u.line, 'col': u.col, 'phi': u.phi, 'lam': u.lam, 'k': u.k}"


@query(
    f"""WITH RECURSIVE {s.CASES_SQL}, u AS (SELECT asn, custkey % 40 AS pk, date_diff('day', DATE '1970-01-01', date_entered) AS day, floor(latitude / {_HIGH!r}) AS line, floor(longitude / {_WIDE!r}) AS col, radians(latitude) AS phi, radians(longitude) AS lam,
        row_number() OVER (PARTITION BY custkey % 40 ORDER BY date_entered, asn) AS k FROM cases WHERE custkey IS NOT NULL AND date_entered IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
    g AS (SELECT pk, k, asn, asn AS pid, [{_ME}] AS open FROM u WHERE k = 1
        UNION ALL SELECT pk, k, asn, coalesce(best.asn, asn), CASE WHEN best IS NULL THEN list_append(fresh, me) ELSE fresh END FROM (
            SELECT pk, k, asn, me, fresh, list_sort(list_transform(list_filter(fresh, lambda x: abs(x.line - me.line) <= 1 AND abs(x.col - me.col) <= 1 AND {_FAR} <= {projects.RADIUS_M}), lambda x: {{'far': {_FAR}, 'line': -x.line, 'col': -x.col, 'k': -x.k, 'asn': x.asn}}))[1] AS best
            FROM (SELECT u.pk, u.k, u.asn, {_ME} AS me, list_filter(g.open, lambda x: x.day >= u.day - {projects.WINDOW_DAYS}) AS fresh FROM g JOIN u ON u.pk = g.pk AND u.k = g.k + 1)))
    SELECT asn, coalesce(pid, asn) AS project_id, CAST(count(*) OVER (PARTITION BY coalesce(pid, asn)) AS INTEGER) AS project_size FROM cases LEFT JOIN (SELECT asn, pid FROM g) USING (asn)"""
)
def project_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters; the SQL walks a sponsor's cases one by one, with the open projects in a list."""
    return projects.assign_projects(s.cases(spark, sf_dir).withColumn("project_key", (F.col("custkey") % 40).cast("string")))


_SNAPSHOTS = "snap AS (SELECT l_orderkey AS asn, CAST(l_shipdate AS DATE) AS \"asof\", l_linestatus AS status_code, l_linenumber * 1000000 + l_partkey AS batch_seq, l_partkey AS payload FROM lineitem)"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asn"), F.col("l_shipdate").cast("date").alias("asof"), F.col("l_linestatus").alias("status_code"),
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("batch_seq"), F.col("l_partkey").alias("payload"),
    )


@query(
    f"""WITH {_SNAPSHOTS} SELECT asn, status_code, payload, first_seen_asof, last_seen_asof FROM (SELECT *, "asof" AS last_seen_asof, min("asof") OVER (PARTITION BY asn) AS first_seen_asof, row_number() OVER (PARTITION BY asn ORDER BY "asof" DESC, batch_seq DESC, payload) AS rn FROM snap) WHERE rn = 1"""
)
def upsert_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the newer one first, folded into the current state."""
    rows = state.seen(_snapshots(spark, sf_dir), F.col("asof")).drop("asof")
    old, new = rows.where("last_seen_asof < '1999-01-01'"), rows.where("last_seen_asof >= '1999-01-01'")
    return state.upsert(state.upsert(None, new), old).select("asn", "status_code", "payload", "first_seen_asof", "last_seen_asof")


@query(f"WITH {_SNAPSHOTS} SELECT asn, \"asof\", status_code FROM (SELECT *, row_number() OVER (PARTITION BY asn, \"asof\" ORDER BY batch_seq DESC) AS rn FROM snap) WHERE rn = 1")
def append_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snapshots(spark, sf_dir)
    columns = ("asn", "asof", "status_code")
    first = state.history(None, rows.where("payload % 2 = 0"), columns)
    return state.history(first, rows.where("payload % 2 = 1"), columns).select(*columns)


QUERIES, ORACLES = query.queries, query.oracles
