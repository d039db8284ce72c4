"""String expressions: names, numbers, domains and code groups. All are Column -> Column and stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes that filers append to company names, stripped from the end of the upper-cased name again and
# again, in this order.
TRAILING_CODES = (
    r"\s*\([^()]*\)\s*$",
    r"\s+[-~_]\s*[A-Z0-9.&' ]{1,15}$",
    r"(?<=\bUSA|\bLLC|\bINC)\s*[-.,_~]\s*[A-Z0-9.&' ]{1,15}$",
    r"(?<=\bUSA)\s+[A-Z]{1,3}$",
    r"_[A-Z]{1,4}$",
    r"[\s\-~_.,]+$",
)
# Legal suffixes and fund numbering at the end of a name.
LEGAL_SUFFIXES = (
    r"(\s+(LLC|L L C|INC|LP|L P|LLP|LLLP|PLLC|LTD|CORP|CORPORATION|CO|COMPANY|LIMITED|PARTNERSHIP"
    r"|I{1,3}|IV|VI{0,3}|IX|XI{0,3}|[A-Z]?\d+[A-Z]?))+$"
)
# Words by which a description says that the structure stands already.
EXISTING_KEYWORDS = (
    r"\bEXIST|\bCOLO|\bMOD(IFICATION)?\b|\bSIDE( ?(MNT|MOUNT))?\b|\bSWAP\b|\bUPGRADE|\bAS[- ]?BUILT"
    r"|\bRAISE|\bINCREASE|\bTOP ?HAT|\bEXTENSION|\bADD(ING|ITION)?\b|\b5G\b"
)


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _strip_codes(c: Column) -> Column:
    return reduce(lambda s, code: F.trim(F.regexp_replace(s, code, "")), TRAILING_CODES, c)


def strip_codes(c: Column) -> Column:
    """An upper-cased name without trailing codes, however many. Each round that changes the name shortens it, so as many
    rounds as it has characters reach the fixpoint; a name that has come to rest is passed through."""
    start = F.struct(c.alias("name"), F.lit(None).cast("string").alias("before"))
    strip = lambda x, _: F.when(x["name"] == x["before"], x).otherwise(F.struct(_strip_codes(x["name"]).alias("name"), x["name"].alias("before")))
    return F.aggregate(F.sequence(F.lit(1), F.length(c) + 1), start, strip, lambda x: x["name"])


def normalize_name(c: Column) -> Column:
    """Upper case, codes stripped, ampersands and apostrophes dropped, other marks as spaces; empty is null."""
    s = strip_codes(F.trim(F.regexp_replace(F.upper(c), r"\s+", " ")))
    s = F.regexp_replace(F.regexp_replace(s, "[&'’]", ""), "[^A-Z0-9 ]", " ")
    return empty_to_null(F.trim(F.regexp_replace(s, r"\s+", " ")))


def base_name(norm: Column) -> Column:
    """A normalised name without its d/b/a clause, legal suffixes and numbering; itself where nothing would be left."""
    head = F.trim(F.get(F.split(norm, r"\b(?:D B A|DBA)\b"), F.lit(0)))
    return F.coalesce(empty_to_null(F.trim(F.regexp_replace(head, LEGAL_SUFFIXES, ""))), head)


def normalize_number(c: Column) -> Column:
    """'A01252613.0' -> '1252613': digits without leading zeros and a trailing .0; none is null."""
    digits = F.regexp_replace(F.regexp_replace(c, r"\.0+$", ""), r"\D", "")
    return empty_to_null(F.regexp_replace(digits, "^0+", ""))


# Fixed value: the form of a study number.
STUDY = r"^(\d{2}|\d{4})-([A-Z]+)-0*(\d+)-(OE|NRA)$"


def normalize_study(c: Column) -> Column:
    """'96-ACE-0407-OE' -> '1996-ACE-407-OE': years under 50 are of this century; anything else is null."""
    s = F.upper(F.trim(c))
    part = lambda k: F.regexp_extract(s, STUDY, k)
    year = part(1).try_cast("int")
    full = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.when(s.rlike(STUDY), F.concat_ws("-", full.cast("string"), part(2), part(3).try_cast("bigint").cast("string"), part(4)))


def email_domain(c: Column) -> Column:
    """What follows the last @, trimmed and lower-cased; null without one."""
    return F.when(c.contains("@"), empty_to_null(F.lower(F.trim(F.substring_index(c, "@", -1)))))


def url_host(c: Column) -> Column:
    """Host of a URL, lower-cased; null without one."""
    return empty_to_null(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)))


def domain_suffixes(c: Column) -> Column:
    """All parent domains of c and c itself, longest first."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def status_group(c: Column) -> Column:
    """Text before the first dash; NONE for null."""
    return F.coalesce(F.substring_index(c, "-", 1), F.lit("NONE"))


def structure_group(c: Column) -> Column:
    """Text before the first $, with all that has to do with wind as WINDMILL; UNKNOWN for null."""
    s = F.upper(F.coalesce(c, F.lit("UNKNOWN")))
    return F.when(s.contains("WIND"), F.lit("WINDMILL")).otherwise(F.trim(F.substring_index(s, "$", 1)))


def says_existing(c: Column) -> Column:
    """Whether a description says that the structure stands already."""
    return F.upper(F.coalesce(c, F.lit(""))).rlike(EXISTING_KEYWORDS)


def case_number(c: Column) -> dict[str, Column]:
    """Year, region, sequence and series of a case number YYYY-REG-SEQ-(OE|NRA); nulls where it is none."""
    pattern = r"^(\d{4})-([A-Z]+)-(\d+)-(OE|NRA)$"
    part = lambda k: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))
    return {"asn_year": part(1).try_cast("int"), "asn_region": part(2), "asn_sequence": part(3).try_cast("bigint"), "asn_type": part(4)}
