import datetime as dt
import zipfile

from sitesignal.operators import buildkind, registry, rules
from sitesignal.sources import files


def test_taxonomy(spark):
    types = {
        "TOWER$ANTENNA": "tower", " tower ": "tower", "POLE$MONO": "monopole", "TOWER$COW": "cow", "CRANE$WINDMILL": "crane", "WINDMILL": "wind", "TOWER$MET": "wind",
        "CONSTRUCTION$X": "crane", "WATER_TOWER": "antenna_mount", "RIG$OIL": "rig", "POLE$UTILITY": "transmission", "TRANSMISSION_LINE$A": "transmission",
        "POLE$PARKING": "lighting", "TOWER$SOLAR": "solar", "HANGAR": "building", "RUNWAY - Construction": "airport", "FORM 7480 - New": "airport", "": "other", None: "other", "ODD": "other",
    }
    df = spark.createDataFrame([(t,) for t in types], "structure_type string")
    got = {r.structure_type: (r.category, r.is_tower_signal) for r in rules.classify(df).collect()}
    assert got == {t: (c, c in ("tower", "monopole")) for t, c in types.items()}


def test_name_rules(spark):
    names = {
        "American Towers, LLC": ("American Tower", "AMT", "tower_reit"), "AT&T Mobility": ("AT&T", "T", "carrier"), "Verizon Wireless (VAW) LLC": ("Verizon", "VZ", "carrier"),
        "The Towers, LLC": ("The Towers (Vertical Bridge/Verizon JV)", None, "private_towerco"), "Pinewood Towers II, LLC": ("PINEWOOD TOWERS", None, "private_towerco"), "Tarpon Towers II, LLC": ("Tarpon Towers", None, "private_towerco"),
        "Some Engineering Inc": (None, None, "consultant"), "Rural Electric Cooperative Inc": ("RURAL ELECTRIC COOPERATIVE", None, "utility"), "Nobody Known": (None, None, None), None: (None, None, None),
    }
    df = spark.createDataFrame([(n,) for n in names], "sponsor string")
    got = {r.sponsor: (r.entity, r.ticker, r.entity_type) for r in rules.attribute(df).collect()}
    assert got == names


def test_owners(spark):
    owners = [
        ("CCATT", "x.crowncastle.com", "Crown Castle", "CCI", "tower_reit"), ("Verizon", "gmail.com", "Verizon", "VZ", "carrier"), ("Some Town Hall", "dot.state.tx.us", "SOME TOWN HALL", None, "government"),
        ("Unknown Co", None, "UNKNOWN", None, "other"), ("Bob Consulting", None, None, None, None), (None, "agency.gov", None, None, None), (None, None, None, None, None), ("Odd Inc", "notcrowncastle.com", "ODD", None, "other"),
    ]
    df = spark.createDataFrame([o[:2] for o in owners], "asr_owner string, asr_owner_domain string")
    got = {(r.asr_owner, r.asr_owner_domain): tuple(r)[2:] for r in rules.owner_entities(df).collect()}
    assert got == {o[:2]: o[2:] for o in owners}


def row(n, fields):
    out = [""] * n
    for k, v in fields.items():
        out[k] = v
    return "|".join(out)


def test_registration_archive(spark, tmp_path):
    ra = [
        row(49, {3: "1001", 8: "C", 9: "01/05/2000", 11: "02/05/2000", 12: "06/30/2006", 30: " 90.2 ", 34: "96-ACE-0407-OE"}),
        row(49, {3: "1002", 8: "Q", 9: "13/45/2000", 11: "03/05/2001", 30: "x"}), row(49, {3: "1003", 8: "I", 9: "01/01/2010"}), "",
    ]
    co = [row(15, {3: "1001", 5: "A", 6: "1", 7: "0", 8: "0", 9: "N", 11: "2", 12: "0", 13: "0", 14: "E"}), row(15, {3: "1001", 5: "T", 6: "40", 7: "30", 8: "36", 9: "S", 11: "90", 12: "0", 13: "0", 14: "W"})]
    en = [row(17, {3: "1001", 5: "O", 9: "Acme|", 16: "x"}), row(20, {3: "1001", 5: "O", 9: "First", 16: "A@Mail.COM"}), row(20, {3: "1001", 5: "R", 9: "Contact", 16: "q@z.com"})]
    en = en[1:]
    hs = [row(7, {3: "1001", 5: "05/05/1999"}), row(7, {3: "1001", 5: "05/05/1998"}), "short|row"]
    archive = tmp_path / "r.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, lines in (("RA", ra), ("CO", co), ("EN", en), ("HS", hs)):
            z.writestr(f"{name}.dat", "\r\n".join(lines).encode() + (b"\r\nxx|\xff" if name == "HS" else b""))
    got = {r.registration_number: r for r in files.read_registrations(spark, f"file://{files.unpack(archive, tmp_path / 'u')}").collect()}
    a = got["1001"]
    assert (a.status, a.overall_height_agl_ft, a.faa_asn, a.asr_owner, a.asr_owner_domain) == ("constructed", round(90.2 * 3.28084, 1), "1996-ACE-407-OE", "First", "mail.com")
    assert (a.latitude, a.longitude, a.registration_date) == (-(40 + 30 / 60 + 36 / 3600), -90.0, dt.date(1998, 5, 5))
    b = got["1002"]
    assert (b.status, b.date_entered, b.overall_height_agl_ft, b.asr_owner) == ("unknown", None, None, None) and got["1003"].status == "dismantled"


def test_tiers(spark):
    reg = [("11", "A-1", 40.0, -90.0, 200.0), ("12", "A-2", 41.0, -90.0, 200.0), ("13", None, 42.0, -90.0, 205.0), ("14", None, 42.0, -90.0, 205.0), ("15", None, 43.0, -90.0, 300.0)]
    a = spark.createDataFrame(reg, "registration_number string, faa_asn string, latitude double, longitude double, overall_height_agl_ft double")
    cases = [
        ("A-1", "A0012.0", 40.0, -90.0, 100.0, "building"), ("A-2", None, 41.0, -90.0, 100.0, "building"), ("A-3", None, 42.0001, -90.0, 200.0, "tower"),
        ("A-4", None, 43.0, -90.0, 200.0, "tower"), ("A-5", None, 44.0, -90.0, 200.0, "tower"), ("A-6", None, 42.0, -90.0, 200.0, "building"), ("A-7", "99", 42.0, -90.0, 200.0, "tower"),
    ]
    c = spark.createDataFrame(cases, "asn string, fcc_asr_number string, latitude double, longitude double, agl_structure_height double, category string")
    got = {r.asn: (r.registration_number, r.match_method) for r in registry.match_cases(c, a).collect()}
    assert got == {"A-1": ("12", "asr_number"), "A-2": ("12", "faa_study"), "A-3": ("14", "proximity"), "A-7": ("14", "proximity")}


def test_build_kinds(spark):
    d = dt.date(2020, 6, 1)
    day = lambda n: d - dt.timedelta(n)
    places = iter(range(100))
    case = lambda asn, built=None, text=None, number=None, cat="tower": (asn, cat, d, built, text, number, 30 + next(places) * 0.1, -90.0)
    cases = [case("reg"), case("con"), case("new"), case("built", day(31)), case("late", day(30)), case("word", text="swap"), case("num", number="7"), case("none"), case("roof", cat="building")]
    cases += [("p0", "antenna_mount", day(60), None, None, None, 10.0, -90.0), ("p1", "tower", d, None, None, None, 10.0, -90.0)]
    c = spark.createDataFrame(cases, "asn string, category string, date_entered date, date_built date, structure_description string, fcc_asr_number string, latitude double, longitude double")
    matches = [("reg", "asr_number", day(366), None), ("con", "asr_number", day(10), day(31)), ("new", "faa_study", day(365), day(30))]
    m = spark.createDataFrame(matches, "asn string, match_method string, asr_registration_date date, asr_date_constructed date")
    kinds = buildkind.build_kind(c, m)
    got = {r.asn: (r.build_kind, r.build_kind_basis) for r in kinds.collect()}
    assert got == {
        "reg": ("modification", "asr"), "con": ("modification", "asr"), "new": ("new_build", "asr"), "built": ("modification", "faa_built"), "late": ("unknown", "none"),
        "word": ("modification", "keyword"), "num": ("modification", "asr_number"), "none": ("unknown", "none"), "p1": ("modification", "prior_case"),
    }
    assert {r.signal: (r.n_existing, r.n_new) for r in buildkind.signal_coverage(kinds).collect()}["bk_asr"] == (2, 1)
