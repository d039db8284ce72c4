import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value in a form in which both engines' results compare."""
    import datetime
    import decimal

    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)) or type(v).__module__ == "numpy":
        return round(float(v), 7)
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v)
    return str(v)


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Asserts that a query gives its oracle's rows."""

    def check(query, oracle, folder=None):
        df = query(spark, folder or sf)
        found = df.collect()
        cursor = duck.execute(oracle)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert ordered([[r[n] for n in names] for r in found]) == ordered(cursor.fetchall())
        return found

    return check
