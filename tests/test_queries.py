"""Every query against its SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "as_integer_ratio") or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return str(v)


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-5 * max(1, abs(a))
    return a == b


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["engine", "language", "n", "genuine_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, ROOT)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=str)
    assert len(a) == len(b)
    assert all(close(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("p")))
def test_runs(spark, name):
    assert entry.queries()[name](spark, ROOT).count() > 0
