"""The driver's contract: every query with SQL gives its rows at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def _same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    assert type(a) is type(b)
    return abs(a - b) <= 1e-6 * max(1, abs(a)) if isinstance(a, float) or isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is not None and x == x, str(round(x, 4) + 0.0 if isinstance(x, float) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x)) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    res = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    want = sorted(res, key=key)
    assert len(got) == len(want)
    assert all(_same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["wellkey", "month_missing"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
