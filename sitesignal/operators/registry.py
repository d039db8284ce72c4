"""Structure registrations: parsing, estimated dates, and matching them to cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesignal.functions.dates import us_date
from sitesignal.functions.geo import haversine_m
from sitesignal.functions.stats import date_quantile_lower, share
from sitesignal.functions.text import normalize_number, normalize_study
from sitesignal.operators.spatial import pairs_within

# Units, tolerances, and the categories that may match by place.
FEET_PER_METRE = 3.28084
PROXIMITY_M = 50.0
HEIGHT_TOLERANCE = 0.10
PROXIMITY_CATEGORIES = ("tower", "monopole", "cow", "antenna_mount")
STATUS = {"C": "constructed", "G": "granted", "I": "dismantled", "T": "terminated", "A": "cancelled"}
DATES = ("date_entered", "date_issued", "date_constructed", "date_dismantled", "date_action", "faa_determination_date")
METHODS = ("asr_number", "faa_study", "proximity")


def dms(d: str, m: str, s: str, hemisphere: str, negative: str) -> Column:
    """Degrees from degrees, minutes and seconds."""
    value = F.col(d).try_cast("double") + F.col(m).try_cast("double") / 60 + F.col(s).try_cast("double") / 3600
    return F.when(F.col(hemisphere) == negative, -value).otherwise(value)


def _first(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in file order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where("__rn = 1").drop("__rn", "line")


def estimate_dates(registrations: DataFrame, bin_size: int = 500) -> DataFrame:
    """registrations (registration_number and three dates) with registration_date.

    Numbers are issued in order, so a structure's own earliest date, often that of a later change, is bounded by the
    tenth percentile of its block of bin_size numbers, made non-decreasing over blocks. Blocks number a bin_size-th of
    the registrations: only they are ordered as a whole.
    """
    number = F.col("registration_number").try_cast("bigint")
    rows = registrations.withColumns({
        "__own": F.least("first_history_date", "date_entered", "date_issued"), "__bin": F.floor(number / bin_size),
    })
    bins = rows.groupBy("__bin").agg(date_quantile_lower("__own", 10).alias("__est"))
    bins = bins.withColumn("__est", F.max("__est").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(bins, "__bin", "left").withColumn("registration_date", F.least("__own", "__est")).drop("__own", "__bin", "__est")


def parse_registrations(ra: DataFrame, co: DataFrame, en: DataFrame, hs: DataFrame) -> DataFrame:
    """One row for each registration from the four record tables, all strings, each with `line` for file order."""
    coords = _first(co.where("coordinate_type = 'T'"), "registration_number").select(
        "registration_number", dms("lat_d", "lat_m", "lat_s", "lat_dir", "S").alias("latitude"), dms("lon_d", "lon_m", "lon_s", "lon_dir", "W").alias("longitude")
    )
    domain = F.nullif(F.lower(F.regexp_extract("email", r"@([^@\s]+)$", 1)), F.lit(""))
    owners = _first(en.where("entity_type = 'O'"), "registration_number").select(
        "registration_number", F.col("entity_name").alias("asr_owner"), domain.alias("asr_owner_domain")
    )
    first = hs.groupBy("registration_number").agg(F.min(us_date(F.col("date"))).alias("first_history_date"))
    status = F.lit("unknown")
    for code, name in STATUS.items():
        status = F.when(F.col("status_code") == code, F.lit(name)).otherwise(status)
    feet = lambda c: F.round(F.col(c).try_cast("double") * FEET_PER_METRE, 1)
    rows = ra.drop("line").withColumns({c: us_date(F.col(c)) for c in DATES}).withColumns({
        "status": status, "overall_height_agl_ft": feet("overall_height_agl_m"), "overall_height_amsl_ft": feet("overall_height_amsl_m"),
        "faa_asn": normalize_study(F.col("faa_study_number")),
    })
    rows = estimate_dates(rows.join(first, "registration_number", "left"))
    out = rows.join(coords, "registration_number", "left").join(owners, "registration_number", "left")
    return out.drop("overall_height_agl_m", "overall_height_amsl_m", "first_history_date")


def match_cases(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """asn, registration_number, match_method, match_distance_m: at most one row for each case.

    By the number that the case cites, else by the study that the registration cites, else the nearest registration
    within PROXIMITY_M whose height is within HEIGHT_TOLERANCE of the larger of the two; of equally near ones the larger
    number. A case that a tier has matched is not looked up in later ones. cases: asn, fcc_asr_number, latitude,
    longitude, agl_structure_height, category.
    """
    a = registry.select("registration_number", "faa_asn", F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"), "overall_height_agl_ft")
    distance = F.round(haversine_m(F.col("latitude"), F.col("longitude"), F.col("rlat"), F.col("rlon")), 1).alias("match_distance_m")

    def tier(df: DataFrame, method: str) -> DataFrame:
        return df.select("asn", "registration_number", F.lit(method).alias("match_method"), distance)

    def one(df: DataFrame, *order: Column) -> DataFrame:
        return df.withColumn("__rn", F.row_number().over(Window.partitionBy("asn").orderBy(*order))).where("__rn = 1").drop("__rn")

    keyed = cases.withColumn("__key", normalize_number(F.col("fcc_asr_number")))
    numbered = keyed.where(F.col("__key").isNotNull()).join(a, F.col("__key") == a["registration_number"])
    by_number = one(tier(numbered, METHODS[0]), F.col("match_distance_m").asc_nulls_last())
    rest = cases.join(by_number.select("asn"), "asn", "left_anti")
    studied = rest.join(a.where(F.col("faa_asn").isNotNull()), F.col("asn") == a["faa_asn"])
    by_study = one(tier(studied, METHODS[1]), F.col("registration_number").asc())
    rest = rest.join(by_study.select("asn"), "asn", "left_anti")
    near = rest.where(F.col("category").isin(*PROXIMITY_CATEGORIES) & F.col("agl_structure_height").isNotNull())
    near = near.select("asn", "latitude", "longitude", "agl_structure_height")
    there = registry.where(F.col("overall_height_agl_ft").isNotNull()).select("registration_number", "latitude", "longitude", "overall_height_agl_ft")
    h1, h2 = F.col("agl_structure_height"), F.col("overall_height_agl_ft_r")
    pairs = pairs_within(near, there, PROXIMITY_M, residual=F.abs(h1 - h2) <= HEIGHT_TOLERANCE * F.greatest(h1, h2))
    nearest = one(pairs, F.col("distance_m").asc(), F.col("registration_number_r").desc())
    by_place = nearest.select("asn", F.col("registration_number_r").alias("registration_number"), F.lit(METHODS[2]).alias("match_method"), F.round("distance_m", 1).alias("match_distance_m"))
    return by_number.unionByName(by_study).unionByName(by_place)


#: Registry columns that a matched case gets, by their name there.
CASE_COLUMNS = {
    "status": "asr_status", "asr_structure_type": "asr_structure_type", "registration_date": "asr_registration_date",
    "date_constructed": "asr_date_constructed", "date_dismantled": "asr_date_dismantled", "overall_height_agl_ft": "asr_height_agl_ft",
    "faa_asn": "asr_faa_asn", "asr_owner": "asr_owner", "asr_owner_domain": "asr_owner_domain",
}


def matched_registrations(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """matches with the registration's columns."""
    return matches.join(registry.select("registration_number", *CASE_COLUMNS).withColumnsRenamed(CASE_COLUMNS), "registration_number", "left")


def match_summary(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """Share of cases matched, by category and method. cases: asn, category, fcc_asr_number."""
    d = cases.join(matches.select("asn", "match_method"), "asn", "left")
    method = F.col("match_method")
    return d.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("fcc_asr_number").isNotNull()).alias("has_asr_number"),
        share(method == METHODS[0]).alias("by_number"), share(method == METHODS[1]).alias("by_study"),
        share(method == METHODS[2]).alias("by_proximity"), share(method.isNotNull()).alias("matched"),
    )
