from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import cutoffs


def brute(rows, targets):
    by = defaultdict(list)
    for s, x in rows:
        by[s].append(x)
    out = {}
    for s, pct in targets.items():
        x = sorted(by.get(s, []), reverse=True)
        cut = next((v for v in x if sum(y >= v for y in x) * 100.0 >= pct * len(x)), None)
        out[s] = (cut, sum(y >= cut for y in x) if cut is not None else 0, len(x))
    return out


def test_against_brute_force_with_ties_and_hot_source(spark):
    rows = [("hot", float(i % 7)) for i in range(900)] + [("few", 1.0), ("few", 1.0), ("few", 0.5)] + [("other", 3.0)]
    targets = {"hot": 30, "few": 50, "none": 10}
    t = spark.createDataFrame(list(targets.items()), "source string, target_pct int")
    got = {r.source: (r.cutoff, r.kept, r.total) for r in cutoffs.share_cutoffs(spark.createDataFrame(rows, "source string, score double"), t).collect()}
    assert got == brute(rows, targets)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-3, 3).map(float)), max_size=40), st.integers(1, 100))
def test_property(spark, rows, pct):
    targets = dict.fromkeys("abc", pct)
    df = spark.createDataFrame(rows, "source string, score double")
    t = spark.createDataFrame(list(targets.items()), "source string, target_pct int")
    assert {r.source: (r.cutoff, r.kept, r.total) for r in cutoffs.share_cutoffs(df, t).collect()} == brute(rows, targets)


def test_nulls_non_finite_and_clashing_columns(spark):
    rows = [("a", 1.0, "x", 1), ("a", None, "x", 2), ("a", float("nan"), "x", 3), ("a", float("inf"), "x", 4), (None, 9.0, "x", 5), ("a", 0.0, "x", 6)]
    df = spark.createDataFrame(rows, "source string, score double, cutoff string, n int")
    t = spark.createDataFrame([("a", 50), ("a", 40), (None, 10), ("b", None)], "source string, target_pct int")
    assert [(r.source, r.n) for r in cutoffs.keep_share(df, t).collect()] == [("a", 1)]
    assert cutoffs.share_cutoffs(df, t).count() == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "source string, score double")
    t = spark.createDataFrame([("a", 50)], "source string, target_pct int")
    assert [(r.source, r.cutoff, r.kept) for r in cutoffs.share_cutoffs(df, t).collect()] == [("a", None, 0)]
    assert cutoffs.keep_share(df, t).count() == 0 and cutoffs.share_cutoffs(df, t.limit(0)).count() == 0


def test_calibration_records(spark):
    q = spark.createDataFrame([(1, " pdq ", [0.1, None, float("inf")], True), (1, "PDQ", [0.1], True), (2, "PDQ", [], True), (3, "PDQ", [0.4], None), (4, "PDQ", [0.2, 0.9], True), (None, "PDQ", [1.0], True), (5, None, [1.0], True)], "rec_id long, method string, scores array<float>, cal boolean")
    t = spark.createDataFrame([("PDQ", 50)], "method string, target_pct int")
    records, targets = cutoffs.calibration_records(q, t)
    assert sorted((r.method, r.rec_id, round(r.score, 3)) for r in records.collect()) == [("PDQ", 1, 0.1), ("PDQ", 4, 0.9)]
    assert [r.rec_id for r in cutoffs.keep_share(records, targets, "method").collect()] == [4]
