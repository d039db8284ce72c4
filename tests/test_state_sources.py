import datetime as dt
import gzip
import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitesignal import cli
from sitesignal.operators import state
from sitesignal.sources import case_xml, client, files, windows
from sitesignal.sources.datasource import CaseListSource
from sitesignal.streaming import upserts

SCHEMA = "asn string, asof date, batch_seq long, status_code string, date_completed date, expiration_date date, date_built date, agl_structure_height double, agl_structure_height_det double, amsl_overall_height_proposed double, amsl_overall_height_det double"


def snapshots(spark, n=60):
    rng = random.Random(3)
    rows = [(f"a{rng.randrange(12)}", dt.date(2024, 1, 1 + rng.randrange(4)), k, rng.choice("PQR"), None, None, None, float(k), None, None, None) for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def current(df):
    return {r.asn: (r.status_code, r.first_seen_asof, r.last_seen_asof) for r in df.collect()}


def test_order_of_snapshots_does_not_matter(spark, tmp_path):
    rows, df = snapshots(spark)
    want = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        want[r[0]] = (r[3], min(x[1] for x in rows if x[0] == r[0]), r[1])
    for name, days in (("up", (1, 2, 3, 4)), ("down", (4, 3, 2, 1, 2))):
        store = state.Store(spark, f"file://{tmp_path}/{name}")
        for day in days:
            store.fold(df.where(F.dayofmonth("asof") == day))
        assert current(store.read("cases")) == want
        history = {(r.asn, r.asof): r.status_code for r in store.read("case_history").collect()}
        assert history == {(r[0], r[1]): r[3] for r in sorted(rows, key=lambda r: r[2])}
    store.rebuild(df)
    assert current(store.read("cases")) == want
    assert spark.sql("SELECT count(*) FROM case_history").first()[0] == len(history)


def test_crash_between_steps_leaves_the_table(spark, tmp_path, monkeypatch):
    rows, df = snapshots(spark)
    store = state.Store(spark, f"file://{tmp_path}/s")
    store.stage(df.where("day(asof) < 3"))
    store.compact()
    before, history = current(store.read("cases")), store.read("case_history").count()
    put = state.Store._put
    for step in (".claim", ".new"):

        def crash(self, path, text, overwrite, step=step):
            if path.endswith(step) and "/cases/" in path:
                raise OSError("lost")
            put(self, path, text, overwrite)

        store.stage(df.where("day(asof) >= 3"))
        monkeypatch.setattr(state.Store, "_put", crash)
        with pytest.raises(OSError):
            store.compact()
        monkeypatch.setattr(state.Store, "_put", put)
        assert current(store.read("cases")) == before  # as it was, and never gone
    store.compact()  # what was staged is still there, twice
    whole = state.Store(spark, f"file://{tmp_path}/whole")
    whole.rebuild(df)
    assert current(store.read("cases")) == current(whole.read("cases")) != before
    assert store.read("case_history").count() == whole.read("case_history").count() > history
    store.compact()
    assert current(store.read("cases")) == current(whole.read("cases")) and store.read("staged").count() == 0


def test_only_touched_parts_are_written(spark, tmp_path):
    rows, df = snapshots(spark)
    store = state.Store(spark, f"file://{tmp_path}/s")
    store.rebuild(df)
    old = {n: store.manifest(n)["parts"] for n in ("cases", "case_history")}
    store.fold(df.where("asn = 'a1' AND day(asof) = 2"))
    new = {n: store.manifest(n)["parts"] for n in ("cases", "case_history")}
    assert sum(new["cases"][k] != old["cases"][k] for k in old["cases"]) == 1 < len(old["cases"])
    assert [k for k in old["case_history"] if new["case_history"][k] != old["case_history"][k]] == ["2024-01-02"]


def test_second_pull_of_a_day_wins(spark, tmp_path):
    args, day = ["--data-dir", str(tmp_path), "ingest", "--days", "5", "--types", "OE", "--regions", "ASO"], dt.date(2024, 3, 11)
    for status in ("OLD", "NEW"):
        assert cli.main(args, Fake(1, status=status), day) == 0
    store = state.Store(spark, f"file://{tmp_path}/tables")
    for _ in range(2):
        assert {r[0] for r in store.read("cases").select("status_code").collect()} == {"NEW"}
        assert {r[0] for r in store.read("case_history").select("status_code").collect()} == {"NEW"}
        assert cli.main(["--data-dir", str(tmp_path), "rebuild"]) == 0


def test_new_columns_come_in(spark):
    old = spark.createDataFrame([("a", 1, dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "asn string, batch_seq long, first_seen_asof date, last_seen_asof date")
    new = spark.createDataFrame([("b", 1, "x", dt.date(2024, 1, 2), dt.date(2024, 1, 2))], "asn string, batch_seq long, extra string, first_seen_asof date, last_seen_asof date")
    assert {r.asn: r.extra for r in state.upsert(old, new).collect()} == {"a": None, "b": "x"}


def test_stream_of_snapshots(spark, tmp_path):
    rows, df = snapshots(spark)
    for day in (3, 1, 4, 2):
        df.where(F.dayofmonth("asof") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = state.Store(spark, f"file://{tmp_path}/s")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upserts.upserts(stream, store, f"{tmp_path}/ck").awaitTermination()
    once = state.Store(spark, f"file://{tmp_path}/once")
    once.rebuild(df)
    assert current(store.read("cases")) == current(once.read("cases"))
    upserts.upserts(stream, store, f"{tmp_path}/ck").awaitTermination()  # nothing new
    assert current(store.read("cases")) == current(once.read("cases"))


XML = """<caseList><!-- note --><OECase><id>7</id><asn>2025-ASO-00042-OE</asn><caseType>OE</caseType><dateEntered>2025-01-05</dateEntered><latitude>33.5</latitude>
<aglStructureHeight>tall</aglStructureHeight><sponsorEmail>Jo.Doe@Mail.Example.COM </sponsorEmail><sponsorPhone>555</sponsorPhone><mobilePhone>556</mobilePhone><futureTag>x &amp; y</futureTag><sponsor></sponsor></OECase>
<NRACase><asn>2025-AAL-6-NRA</asn><createdDate>2025-01-06T23:20:24-05:00</createdDate><year>2025.0</year></NRACase><OECase><asn>odd</asn></OECase></caseList>"""


def check_cases(rows):
    got = {r.asn: r for r in rows}
    a = got["2025-ASO-00042-OE"]
    assert (a.case_id, a.asn_year, a.asn_region, a.asn_type, a.case_type, a.date_entered) == (7, 2025, "ASO", "OE", "OE", dt.date(2025, 1, 5))
    assert (a.latitude, a.agl_structure_height, a.sponsor, a.sponsor_email_domain) == (33.5, None, None, "mail.example.com")
    b = got["2025-AAL-6-NRA"]
    assert (b.case_type, b.date_entered, b.year) == ("NRA", dt.date(2025, 1, 6), None)
    assert b.created_date == dt.datetime(2025, 1, 7, 4, 20, 24)
    assert got["odd"].asn_year is None and got["odd"].case_type is None
    return a


def test_xml(spark, tmp_path):
    path = tmp_path / "x.xml.gz"
    path.write_bytes(gzip.compress(XML.encode()))
    tags = case_xml.discover_tags(spark, f"file://{path}")
    assert tags == ["futureTag"]
    df = case_xml.read_cases(spark, f"file://{path}", tags)
    assert df.schema.names == case_xml.case_schema().names and len(df.columns) == 40
    assert not [c for c in df.columns if "phone" in c]
    assert check_cases(df.collect()).extra == '{"futureTag":"x & y"}'
    (tmp_path / "none.xml").write_bytes(b"<caseList/>")
    assert case_xml.empty_cases(spark).columns == df.columns and case_xml.read_cases(spark, f"file://{tmp_path}/none.xml").count() == 0
    assert client.count_cases(XML.encode()) == 3


class Fake:
    """Serves so many cases a day, each state's share being a part of them."""

    def __init__(self, per_day=3, fail=None, status="PEN"):
        self.per_day, self.fail, self.status, self.asked, self.lock = per_day, fail, status, [], threading.Lock()

    def case_list(self, w):
        with self.lock:
            self.asked.append(w)
        if self.fail and self.fail(w):
            raise OSError("down")
        if w.year != w.start.year:
            return b"<caseList/>"
        days = [w.start + dt.timedelta(k) for k in range((w.end - w.start).days + 1)]
        n = self.per_day if w.state is None else self.per_day // 2 if w.state in ("TX", "AK") else 0
        rows = [f"<OECase><asn>{d.year}-{w.region}-{d:%m%d}{k:03}{'' if w.state is None else w.state == 'TX' and 1 or 2}-{w.case_type}</asn><dateEntered>{d}</dateEntered><statusCode>{self.status}</statusCode></OECase>" for d in days for k in range(n)]
        return f"<caseList>{''.join(rows)}</caseList>".encode()


def test_splitting():
    w = windows.Window("OE", "ASO", dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    pieces = list(client.fetch_pieces(Fake(3), w, cap=20))
    days = [d for p in pieces for d in (p.window.start, p.window.end)]
    assert sum(p.rows for p in pieces) == 93 and days == sorted(days) and all(p.rows < 20 for p in pieces)
    one = windows.Window("OE", "ASO", dt.date(2024, 1, 1), dt.date(2024, 1, 1))
    states = list(client.fetch_pieces(Fake(30), one, cap=20, states=("AK", "TX", "VA")))
    assert [(p.window.state, p.rows, p.capped) for p in states] == [("AK", 15, False), ("TX", 15, False), ("VA", 0, False)]
    assert [p.capped for p in client.fetch_pieces(Fake(60), one, cap=20, states=("AK",))] == [True]


def test_windows():
    w = windows.Window("OE", "ASO", dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert w.query() == {"dateEnteredStart": "2024-01-01", "dateEnteredEnd": "2024-02-01", "region": "ASO"} and w.year == 2024
    for bad in ((dt.date(2023, 12, 1), dt.date(2024, 1, 1)), (dt.date(2024, 2, 1), dt.date(2024, 1, 1))):
        with pytest.raises(ValueError):
            windows.Window("OE", None, *bad)


def test_retries_and_pace():
    slept, answers = [], [client.HttpStatus(500, "u"), client.HttpStatus(429, "u"), TimeoutError(), b"ok"]

    def fetch(url, timeout, agent):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    c = client.Client("http://x", interval=0, backoff=2.0, fetch=fetch, sleep=slept.append)
    assert c.case("A-1") == b"ok" and slept == [2.0, 4.0, 8.0]
    answers[:] = [client.HttpStatus(404, "u")]
    with pytest.raises(client.HttpStatus):
        c.case("A-1")
    answers[:] = [client.HttpStatus(503, "u")] * 9
    with pytest.raises(client.HttpStatus):
        client.Client("http://x", interval=0, retries=2, fetch=fetch, sleep=lambda s: None).case("A-1")
    assert len(answers) == 6
    now, waits = [0.0], []
    pace = client.Pace(1.0, clock=lambda: now[0], sleep=waits.append)
    for _ in range(3):
        pace.wait()
    assert waits == [1.0, 2.0]


def test_command_line_round_trip(spark, tmp_path, capsys):
    root, today = ["--data-dir", str(tmp_path)], dt.date(2024, 3, 10)
    args = [*root, "backfill", "--from", "2024", "--to", "2025", "--types", "OE", "--regions", "ASO,ANE"]
    broken = Fake(1, fail=lambda w: w.region == "ANE" and w.start.month == 2)
    assert cli.main(args, broken, today) == 1
    fixed = Fake(1)
    assert cli.main(args, fixed, today) == 0 and [w.key for w in fixed.asked] == [("OE", 2024, "ANE", dt.date(2024, 2, 1), dt.date(2024, 2, 29))]
    store = state.Store(spark, f"file://{tmp_path}/tables")
    assert store.read("cases").count() == 2 * 70
    assert cli.main([*root, "ingest", "--days", "20", "--types", "OE", "--regions", "ASO"], Fake(1, status="DET-X"), dt.date(2024, 3, 11)) == 0
    cases = store.read("cases")
    assert cases.count() == 141 and cases.where("status_code = 'DET-X'").count() == 21
    assert store.read("case_history").count() == 140 + 21
    before = sorted(map(tuple, cases.select("asn", "status_code", "first_seen_asof", "last_seen_asof").collect()))
    assert cli.main([*root, "rebuild"]) == 0
    assert sorted(map(tuple, store.read("cases").select("asn", "status_code", "first_seen_asof", "last_seen_asof").collect())) == before
    assert cli.main([*root, "coverage"]) == 0
    spark.dataSource.register(CaseListSource)
    import json

    keys = json.dumps([["OE", 2024, "ASO", "2024-01-01", "2024-01-31"], ["OE", 2024, "ANE", "2024-01-01", "2024-01-31"]])
    lists = spark.read.format("case_lists").option("root", str(tmp_path)).option("windows", keys).load()
    assert {(r.region, client.count_cases(bytes(r.xml))) for r in lists.collect()} == {("ASO", 31), ("ANE", 31)}


def test_facts_and_kpis(spark, tmp_path):
    import json

    facts = {"facts": {"us-gaap": {"Capex": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 5, "filed": "2020-05-01", "form": "10-Q"}, {"end": "2020-03-31", "val": 1, "filed": "2020-05-01", "form": "10-Q"}]}}, "Other": {"units": {}}}}}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(facts, indent=1))
    got = files.read_facts(spark, {"X": f"file://{path}"}, {"X": [("Missing", None), ("Capex", dt.date(2017, 1, 1))]})
    assert sorted(((r.value, str(r.start), r["rank"], str(r.min_end)) for r in got.collect()), reverse=True)[0] == (5.0, "2020-01-01", 1, "2017-01-01")
    kpis = tmp_path / "k.csv"
    kpis.write_text('# c\nquarter,entity,metric,value,unit,source_url,note\n2019Q3,AMT,m,1.5,pct,http://x,"a, b"\n')
    r = files.read_kpis(spark, f"file://{kpis}").first()
    assert (r.period, r.value, r.note, r.source) == (dt.date(2019, 7, 1), 1.5, "a, b", "kpi_csv")
    dest = tmp_path / "c.json"
    with pytest.raises(files.Refused):
        files.cached_facts("u", dest, lambda u: (403, b""))
    assert files.cached_facts("u", dest, lambda u: (200, b"{}")) == {} and files.cached_facts("u", dest, lambda u: (403, b"")) == {}
    files.write_kpis(files.read_kpis(spark, f"file://{kpis}").drop("period", "source"), tmp_path / "o.csv", "# h\n")
    assert Path(tmp_path / "o.csv").read_text().startswith("# h\nquarter,entity")


def test_figures_from_facts_and_files(spark, tmp_path, capsys):
    import json

    quarters = [("01-01", "03-31", 1), ("01-01", "06-30", 2), ("01-01", "09-30", 3), ("01-01", "12-31", 4)]
    facts = lambda k: json.dumps({"facts": {"us-gaap": {"PaymentsToAcquirePropertyPlantAndEquipment": {"units": {"USD": [{"start": f"2020-{a}", "end": f"2020-{b}", "val": k * n * 1e6, "filed": f"2020-{b}", "form": "10-Q"} for a, b, n in quarters]}}}}}).encode()
    ciks = {cik: k for k, (cik, _) in enumerate(files.CAPEX.values(), 1)}
    asked = []

    def answer(url):
        asked.append(url)
        return 200, facts(next(k for cik, k in ciks.items() if cik in url))

    for name, value in (("a", 1.5), ("b", 9.0)):
        (tmp_path / f"{name}.csv").write_text(f"# c\nquarter,entity,metric,value,unit,source_url,note\n2019Q3,AMT,m,{value},pct,http://x,n\n")
    root = ["--data-dir", str(tmp_path), "truth"]
    assert cli.main([*root, "--kpis", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], answer=answer) == 0
    store = state.Store(spark, f"file://{tmp_path}/tables")
    got = {(r.entity, r.metric, str(r.period)): r.value for r in store.read("truth").collect()}
    assert got["AMT", "m", "2019-07-01"] == 1.5 and got["VZ+T+TMUS", "capex_usd_m", "2020-10-01"] == 6.0 and got["T", "capex_usd_m", "2020-04-01"] == 2.0
    assert len(got) == 1 + 4 * 4 and len(asked) == 3
    # refused: what is stored stays; files that are young are not fetched again
    assert cli.main(root, answer=lambda u: (403, b"")) == 0 and len(asked) == 3 and store.read("truth").count() == 17
    assert cli.main([*root, "--refresh"], answer=lambda u: (403, b"")) == 0 and store.read("truth").count() == 17
    assert "left out" in capsys.readouterr().out


def test_registry_is_fetched(spark, tmp_path):
    import io
    import zipfile

    asked = []

    def answer(url):
        asked.append(url)
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w") as z:
            for r in files.RECORDS:
                z.writestr(f"{r}.dat", "")
        return 200, body.getvalue()

    state.Store(spark, f"file://{tmp_path}/tables").write("cases", case_xml.empty_cases(spark))
    for force in ([], [], ["--force"]):
        assert cli.main(["--data-dir", str(tmp_path), "asr", *force], answer=answer) == 0
    assert asked == [files.REGISTRY_URL] * 2


def test_late_events_of_a_stream(spark, tmp_path):
    batches = [[("2024-12-02", "a"), ("2024-12-03", "a")], [("2024-11-30", "a"), ("2024-12-08", "b"), ("2024-01-05", "a")], [("2024-12-04", "a"), ("2024-01-06", "b")]]
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame([(dt.datetime.fromisoformat(day), kind) for day, kind in rows], "ts timestamp, kind string")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        upserts.changes(upserts.weekly(stream, "kind"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(str(r.week), r.kind): r.n for r in upserts.latest(spark, f"file://{tmp_path}/out", "week", "kind").collect()}
    # late by some days: counted; by more than the watermark: not
    assert got == {("2024-12-02", "a"): 3, ("2024-12-02", "b"): 1, ("2024-11-25", "a"): 1}
