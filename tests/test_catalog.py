"""Every catalogue query against its SQL in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.functions import fingerprint as fp
from spindrift.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "pages", "events", "lineitem", "orders", "region", "nation", "supplier"]


def plain(x):
    return None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else round(x, 9) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = [dict(zip(cols, r)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    key = lambda rows: sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in rows)
    assert key(got) == key(want)
    assert got or name == "excluded_urls"


def bitwise(data, poly, degree):
    """The fingerprint bit by bit: x^0 is bit 63, a shift right multiplies by x."""
    f = 1 << 63
    for bit in [0] * 64:
        f = f >> 1 ^ (poly if f >> (64 - degree) & 1 else 0)
    for byte in data:
        # the eight bits that leave take the byte's with them
        f ^= byte
        for _ in range(8):
            f = f >> 1 ^ (poly if f & 1 else 0) if degree == 64 else f >> 1 ^ (_lift(poly, degree) if f & 1 else 0)
    return f


def _lift(poly, degree):
    """x^64 modulo a polynomial of less degree."""
    v = 1 << 63
    for _ in range(64):
        v = v >> 1 ^ (poly if v >> (64 - degree) & 1 else 0)
    return v


@pytest.mark.parametrize("text", ["", "http://example.com/", "http://example.com/1", "é日本"])
def test_fingerprint(text):
    want = bitwise(text.encode(), fp.POLY64, 64)
    assert fp.fingerprint_bytes(text.encode()) == want
    assert fp.fingerprint_column([text.encode(), b"x"], fp.POLY64, 64)[0] == fp.signed(want)


@pytest.mark.parametrize("prefix,ws", [("com,example,", 97), ("net,example,", 251), ("org,example,", 173)])
def test_worksets(prefix, ws):
    assert fp.fingerprint_bytes(prefix.encode(), fp.POLY31, 31) >> 56 == ws


def test_charwise_and_extend(spark):
    df = spark.createDataFrame([("http://example.com/1",), ("",), (None,)], "u string")
    want = [fp.signed(bitwise("http://example.com/1".encode("utf-16-le"), fp.POLY64, 64)), -2935493925047926053, None]
    assert [r[0] for r in df.select(fp.fingerprint_charwise("u")).collect()] == want
    longer = df.select(fp.extend(fp.frontier_id("u"), F.lit("/more"))).collect()
    assert [r[0] for r in longer] == [None if x is None else fp.signed(fp.fingerprint_bytes((x + "/more").encode())) for x in ("http://example.com/1", "", None)]


def test_one_evaluation_of_the_fingerprint(spark):
    """A filter on another column reaches the rows before they are hashed."""
    from spindrift.plans import views

    x = views.links(spark, SF).withColumn("id", fp.frontier_id("u")).where("seq % 3 = 0")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
