import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.operators import calibrate, reports, retrieval


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g in ("a", "b", None) for x in rng.integers(0, 40, 137)] + [("c", 2.0), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in calibrate.quantiles(df, ["g"], "x", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect()}
    assert set(got) == {"a", "b", None, "c"} and got["c"].mid == 2.0
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g and v is not None]
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(np.quantile(x, [0.05, 0.5, 0.99]).tolist()) and got[g].n == len(x)
    assert calibrate.quantiles(df.limit(0), ["g"], "x", {"m": 0.5}).count() == 0


def vectors(spark, n, seed, key, name):
    x = np.random.default_rng(seed).normal(size=(n, 6))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (n, None)], f"{key} int, {name} array<double>")


def test_count_above_and_scored_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 17)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 5)
    q, qd = vectors(spark, 12, 1, "query_id", "query")
    r, rd = vectors(spark, 50, 2, "ref_id", "ref")
    s = q @ r.T
    got = {x.query_id: x.n for x in retrieval.count_above(qd.withColumn("bar", F.lit(0.3)), rd, "bar", "ip", 6).collect()}
    assert got == {i: int((s[i] > 0.3).sum()) for i in range(12)}
    city = lambda a, b: -np.abs(a[:, None] - b[None]).sum(2)
    found = retrieval.scored_pairs(qd, rd, city, 4).collect()
    want = np.argsort(-np.round(city(q, r), 9), axis=1, kind="stable")[:, :4]
    assert {(x.query_id, x["rank"], x.ref_id) for x in found} == {(i, k + 1, int(want[i, k])) for i in range(12) for k in range(4)}
    assert retrieval.scored_pairs(qd, rd.limit(0), city, 4).count() == 0


def test_second_stage_takes_the_best_variant(spark):
    top = spark.createDataFrame([("q", "r", 0.9), ("x", "r", 0.5)], "query_id string, ref_id string, score double")
    q = spark.createDataFrame([("q", 3), ("q", 8)], "query_id string, a int")
    r = spark.createDataFrame([("r", 2)], "ref_id string, b int")
    got = {x.query_id: x.inliers for x in reports.second_stage(top, q, r, F.col("a") + F.col("b")).collect()}
    assert got == {"q": 10, "x": 0}


def test_merge_picks_and_winners(spark):
    a = spark.createDataFrame([("k", "1"), ("k", "2"), (None, "3")], "name string, value string")
    assert sorted(map(tuple, reports.merge_values({"s": a, "t": a.where("value = '1'")}).collect())) == [("s.k", "2", 2), ("t.k", "1", 1)]
    rows = spark.createDataFrame([("g", "o1", 5), ("g", "o1", 9), ("g", "o2", 7), ("g", "o3", 1), ("h", "o1", 2)], "g string, o string, v int")
    assert sorted((r.g, r.o, r.v, r.place) for r in reports.picks(rows, "g", "o", [F.col("v").desc()], 2).collect()) == [("g", "o1", 9, 1), ("g", "o2", 7, 2), ("h", "o1", 2, 1)]
    c = spark.createDataFrame([("b", 1.0, None), ("a", 1.0, 3.0), ("c", 2.0, 1.0)], "config string, x double, y double")
    assert {(r.prize, r.config) for r in reports.winners(c, "config", {"x": F.col("x"), "y": F.col("y")}).collect()} == {("x", "a"), ("y", "c")}


def test_fixed_threshold_bootstrap(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"s{i}", True, bool(rng.random() < 0.8)) for i in range(200) for _ in range(3)] + [("m", f"n{i}", False, i < 2) for i in range(300)] + [(None, "s", True, True), ("m", None, True, True)]
    (r,) = reports.fixed_threshold_bootstrap(spark.createDataFrame(rows, "g string, s string, p boolean, h boolean"), "g", "s", "p", "h").collect()
    assert r.n_sources == 500 and r.tpr_lo < r.tpr < r.tpr_hi and r.tpr == pytest.approx(np.mean([x[3] for x in rows[:600]])) and r.tpr_hi - r.tpr_lo < 0.1
    assert (r.false_binds, r.n_negatives) == (2, 300) and 0.015 < r.false_bound < 0.03


def test_plane_digests_tell_planes_apart(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 9, 4]), (3, None)], "k int, f array<int>")
    d = {(r.k, r.plane): r.digest for r in reports.plane_digests(df, "k", "f", 2).collect()}
    assert d[1, 0] == d[2, 0] and d[1, 1] != d[2, 1] and len(d) == 4


def test_round_trip_of_records(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    assert {r.what: r.n for r in reports.round_trip(items, items).collect()} == {"items": 2, "sets": 2, "stale": 0}
