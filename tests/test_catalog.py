"""Queries against their SQL on the smallest test tables, and the registry's coverage."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import compare
from veriloom.plans import catalog
from veriloom.plans.registry import ENTRIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(DATA.glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_query_equals_sql(spark, con, name):
    df = ENTRIES[name].run(spark, str(DATA))
    columns = sorted(df.columns)
    got = compare.bag([tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()])
    cur = con.execute(ENTRIES[name].sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert got == Counter(tuple(compare.plain(r[i]) for i in at) for r in cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e.sql))
def test_query_without_sql_runs(spark, name):
    assert ENTRIES[name].run(spark, str(DATA)).count() >= 0


@needs_data
def test_flagship(spark):
    rows = {(r.stratum, r.level): r.r1 for r in catalog.flagship(spark, str(DATA)).collect()}
    assert rows["attack", "none"] > 0.9


def test_every_query_names_operators():
    assert all(e.operators for e in ENTRIES.values()) and len(catalog.operators()) > 100
