"""Comparisons of all pairs of methods."""

from collections import Counter
from pathlib import Path

import compare
import numpy as np
import pytest

from veriloom.functions import stats
from veriloom.operators import evaluate
from veriloom.plans.queries_calibration import PAIRED_SQL
from veriloom.plans.registry import ENTRIES

DATA = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@needs_data
@pytest.mark.parametrize("name", ["mcnemar_holm", "wilcoxon_statistic"])
def test_all_methods_are_paired(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert "chosen" not in PAIRED_SQL
    cur = con.execute(ENTRIES[name].sql)
    theirs = [d[0] for d in cur.description]
    df = ENTRIES[name].run(spark, str(DATA))
    want = Counter(tuple(compare.plain(v) for v in r) for r in cur.fetchall())
    assert compare.bag([tuple(r) for r in df.select(*theirs).collect()]) == want
    assert sum(want.values()) > 6


@needs_data
def test_paired_tests_has_all_pairs(spark):
    got = {(r.m1, r.m2) for r in ENTRIES["paired_tests"].run(spark, str(DATA)).collect()}
    want = {(r.m1, r.m2) for r in ENTRIES["mcnemar_holm"].run(spark, str(DATA)).collect()}
    assert len(want) > 6 and got >= want


@needs_data
def test_paired_tests_are_holm_adjusted(spark):
    rows = [r for r in ENTRIES["paired_tests"].run(spark, str(DATA)).collect() if r.p is not None]
    assert rows and [r.holm for r in rows] == pytest.approx(stats.holm([r.p for r in rows]))


def test_paired_difference_has_an_interval_of_the_difference(spark):
    rng = np.random.default_rng(6)
    rate = {"a": 0.9, "b": 0.5, "c": 0.5}
    rows = [(m, f"s{i:03d}", str(j), 0.9 if rng.random() < p else None) for m, p in rate.items() for i in range(60) for j in range(3)]
    negatives = [(m, f"n{i % 80:03d}", float(rng.random()) / 2) for m in rate for i in range(800)]
    found = evaluate.paired_difference(spark.createDataFrame(rows, "m string, s string, q string, x double"), spark.createDataFrame(negatives, "m string, s string, x double"), "m", "s", "q", "x", 0.05, 500, 2000).collect()
    got = {(r.m1, r.m2): r for r in found}
    right = {m: np.mean([x is not None for k, _, _, x in rows if k == m]) for m in rate}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"]["diff"] == pytest.approx(right["a"] - right["b"])
    assert all(r.diff_lo < r["diff"] < r.diff_hi and r.unresolved == 0 for r in found)
    assert got["a", "b"].diff_lo > 0.2 and got["a", "b"].p < 0.01 and got["b", "c"].diff_lo < 0 < got["b", "c"].diff_hi
