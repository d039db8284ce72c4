"""New build or modification: evidence signals, their order, and how far they agree."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.functions.text import says_existing
from sitesignal.operators.spatial import PRIOR_MIN_DAYS, PRIOR_RADIUS_M, with_prior

# Categories that get a verdict and those whose filings count as earlier ones; margins in days; and the
# signals in the order in which they decide.
CATEGORIES = ("tower", "monopole", "cow")
PRIOR_CATEGORIES = ("tower", "monopole", "antenna_mount")
REGISTERED_DAYS = 365
BUILT_DAYS = 30
SIGNALS = ("bk_asr", "bk_faa_built", "bk_keyword", "bk_prior_case", "bk_asr_number")
EVIDENCE = ("asr_registered", "asr_constructed", "faa_built", "keyword", "prior_case")

INPUT = ("asn", "category", "date_entered", "date_built", "structure_description", "fcc_asr_number", "latitude", "longitude")
MATCH_INPUT = ("asn", "match_method", "asr_registration_date", "asr_date_constructed")


def _of(cases: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    return cases.where(F.col("category").isin(*categories))


def before(d: str, days: int) -> Column:
    """Whether a date lies more than `days` before the filing."""
    return F.col(d) < F.date_sub("date_entered", days)


def signals(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """asn and the five signals, 'existing', 'new' or null, for the categories that get a verdict.

    cases: asn, category, date_entered, date_built, structure_description, fcc_asr_number, latitude, longitude.
    matches: asn, match_method, asr_registration_date, asr_date_constructed.
    """
    cases, matches = cases.select(*INPUT), matches.select(*MATCH_INPUT)
    prior = with_prior(_of(cases, CATEGORIES), _of(cases, PRIOR_CATEGORIES)).withColumn("prior", F.lit(True))
    d = _of(cases, CATEGORIES).join(matches, "asn", "left").join(prior, "asn", "left")
    existing, new = F.lit("existing"), F.lit("new")
    matched = F.col("match_method").isNotNull()
    return d.select(
        "asn",
        F.when(before("asr_registration_date", REGISTERED_DAYS), existing).when(before("asr_date_constructed", BUILT_DAYS), existing).when(matched, new).alias("bk_asr"),
        F.when(before("date_built", BUILT_DAYS), existing).alias("bk_faa_built"),
        F.when(says_existing(F.col("structure_description")), existing).alias("bk_keyword"),
        F.when(F.col("prior"), existing).alias("bk_prior_case"),
        F.when(F.col("fcc_asr_number").isNotNull() & ~matched, existing).alias("bk_asr_number"),
    )


def decide(found: DataFrame) -> DataFrame:
    """found with build_kind and build_kind_basis: the first signal that says something decides."""
    verdict = F.coalesce(*SIGNALS)
    basis = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s.removeprefix("bk_"))) for s in SIGNALS], F.lit("none"))
    kind = F.when(verdict == "existing", F.lit("modification")).when(verdict == "new", F.lit("new_build")).otherwise(F.lit("unknown"))
    return found.withColumns({"build_kind": kind, "build_kind_basis": basis})


def build_kind(cases: DataFrame, matches: DataFrame) -> DataFrame:
    return decide(signals(cases, matches))


def signal_agreement(kinds: DataFrame) -> DataFrame:
    """For each two signals: filings where both speak, where they agree, and the rate; one pass over the filings."""
    pairs = list(combinations(SIGNALS, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    counts = kinds.agg(*[F.struct(F.count_if(both(a, b)).alias("n_both"), F.count_if(both(a, b) & (F.col(a) == F.col(b))).alias("n_agree")).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"), F.col(f"{a}|{b}.n_both"), F.col(f"{a}|{b}.n_agree")) for a, b in pairs])
    out = counts.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("agree_rate", F.round(F.col("n_agree") / F.nullif("n_both", F.lit(0)), 3))


def signal_coverage(kinds: DataFrame) -> DataFrame:
    """For each signal: filings where it says existing, new, and the share where it speaks."""
    counts = kinds.agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.count_if(F.col(s) == "existing").alias("e"), F.count_if(F.col(s) == "new").alias("w")).alias(s) for s in SIGNALS])
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"{s}.e").alias("n_existing"), F.col(f"{s}.w").alias("n_new")) for s in SIGNALS])
    out = counts.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return out.withColumn("share_fired", F.round((F.col("n_existing") + F.col("n_new")) / F.greatest("n", F.lit(1)), 3)).drop("n")


def pit_kind(
    cases: DataFrame, registered_days: int = REGISTERED_DAYS, built_days: int = BUILT_DAYS, radius_m: float = PRIOR_RADIUS_M,
    min_days: int = PRIOR_MIN_DAYS, lookback_days: int | None = None,
) -> DataFrame:
    """asn, one flag for each evidence, pit_kind and pit_basis: what was known on the day of filing.

    A registered structure that was taken down before the filing is no evidence. Nothing dated after the filing counts.
    """
    standing = F.col("asr_date_dismantled").isNull() | (F.col("asr_date_dismantled") >= F.col("date_entered"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    prior = with_prior(_of(cases, CATEGORIES), _of(cases, PRIOR_CATEGORIES), radius_m, min_days, lookback_days).withColumn("prior", F.lit(True))
    d = _of(cases, CATEGORIES).join(prior, "asn", "left").select(
        "asn",
        sure(standing & before("asr_registration_date", registered_days)).alias("asr_registered"),
        sure(standing & before("asr_date_constructed", built_days)).alias("asr_constructed"),
        sure(before("date_built", built_days)).alias("faa_built"),
        says_existing(F.col("structure_description")).alias("keyword"),
        sure(F.col("prior")).alias("prior_case"),
    )
    basis = F.coalesce(*[F.when(F.col(e), F.lit(e)) for e in EVIDENCE], F.lit("none"))
    d = d.withColumn("pit_basis", basis)
    return d.withColumn("pit_kind", F.when(F.col("pit_basis") == "none", F.lit("new_or_unknown")).otherwise(F.lit("modification")))
