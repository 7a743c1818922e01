import numpy as np
import pytest

from veriloom.llm import overlap, similar
from veriloom.llm.similar import Space


def near_data(rng, n, dim, groups):
    base = rng.normal(size=(n, dim))
    for g in range(groups):
        base[n - 1 - g] = base[g] + rng.normal(size=dim) * 0.1
    return base


def brute(x, k, least, metric):
    if metric == "ip":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
    else:
        s = -np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    np.fill_diagonal(s, -np.inf)
    return {(i, j) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k].tolist() if s[i, j] >= least}


@pytest.mark.parametrize(("metric", "least"), [("ip", 0.9), ("l2", -1.5)])
def test_recall_against_brute_force(spark, metric, least):
    x = near_data(np.random.default_rng(3), 700, 24, 120)
    df = spark.createDataFrame([(f"i{i:04d}", "m", v.tolist()) for i, v in enumerate(x)], "item_id string, method string, vec array<float>")
    rows = similar.most_similar(df, [Space("m", metric, 24)], 5, [least]).collect()
    got = {(int(r.item_id[1:]), int(r.other[1:])) for r in rows}
    want = brute(x.astype(np.float32), 5, least, metric)
    assert len(got & want) >= 0.97 * len(want) and got <= want


def test_copies_unusable_vectors_and_extra_columns(spark):
    v = [1.0, 0.0, 0.0, 0.0]
    rows = [(f"c{i}", "m", v, "z") for i in range(9)] + [("c0", "m", v, "z"), ("z", "m", [0.0] * 4, "z"), ("n", "m", None, "z"), ("s", "m", [1.0], "z"), ("f", "m", [float("nan")] * 4, "z"), (None, "m", v, "z"), ("h", "m", [1.0, None, 0.0, 0.0], "z"), ("o", "other", v, "z")]
    df = spark.createDataFrame(rows, "item_id string, method string, vec array<float>, node string")
    got = similar.most_similar(df, [Space("m", "ip", 4), Space("empty", "l2", 4)], 5, [0.9, -1.0]).collect()
    assert {r.item_id for r in got} == {f"c{i}" for i in range(9)} and len(got) == 45
    assert sorted(r.other for r in got if r.item_id == "c0") == ["c1", "c2", "c3", "c4", "c5"]
    assert sorted(r.other for r in got if r.item_id == "c8") == ["c0", "c1", "c2", "c3", "c4"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "item_id string, method string, vec array<float>")
    assert similar.most_similar(df, [Space("m", "ip", 4)], 5, [0.9]).count() == 0


def test_blocks_of_a_hot_region_lose_nothing(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((150, 8)) + rng.normal(size=(150, 8)) * 0.02, rng.normal(size=(150, 8))])
    df = spark.createDataFrame([(f"i{i:04d}", "m", v.tolist()) for i, v in enumerate(x)], "item_id string, method string, vec array<float>")
    got = {(r.item_id, r.other) for r in similar.most_similar(df, [Space("m", "l2", 8)], 3, [-9.0], probes=64, block_rows=20).collect()}
    want = {(f"i{i:04d}", f"i{j:04d}") for i, j in brute(x.astype(np.float32), 3, -9.0, "l2")}
    assert len(got & want) >= 0.97 * len(want)


def test_walk_is_ordered_by_sum():
    a, b = [0.0, 1.0, 4.0], [0.0, 0.5, 3.0]
    sums = [a[i] + b[j] for i, j in similar.walk(a, b, 9)]
    assert sums == sorted(sums) and len(sums) == 9 and similar.walk(a, b, 2) == [(0, 0), (0, 1)]


@pytest.mark.parametrize("flips", [0, 1])
def test_code_pairs_are_exact(spark, flips):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2, (160, 256), dtype=np.uint8)
    for i in range(80):
        codes[80 + i] = codes[i]
        codes[80 + i, rng.choice(256, rng.integers(0, 30), replace=False)] ^= 1
    words = np.packbits(codes, axis=1, bitorder="little").view(np.int64)
    rows = [(f"k{i}", words[i].tolist(), bool(i < 80)) for i in range(160)] + [("n", None, True), ("w", [1, 2], True), ("x", [1, 2, 3, None], False), (None, words[0].tolist(), True), ("y", words[0].tolist(), None)]
    got = {(r.q, r.r) for r in overlap.code_pairs(spark.createDataFrame(rows, "k string, words array<bigint>, side boolean"), "k", "words", "side", 256, 16, flips).collect()}
    assert got == {(f"k{i}", f"k{j}") for i in range(80) for j in range(80, 160) if (codes[i] != codes[j]).sum() <= 16}


def test_hash_pairs_in_any_spelling(spark):
    h = "0123456789abcdef" * 4
    rows = [("a", h.upper(), True), ("b", f" sha256:{h} ", False), ("c", f"SHA-256: {h}", False), ("d", h[:-1], False), ("e", None, False), ("f", "", True), (None, h, True), ("g", h, None), ("a", h, True)]
    df = spark.createDataFrame(rows, "k string, h string, side boolean")
    assert sorted((r.q, r.r) for r in overlap.hash_pairs(df, "k", "h", "side").collect()) == [("a", "b"), ("a", "c")]


def test_vector_pairs_only_cross_sides_and_include_equal_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    x[100:150] = x[:50] + rng.normal(size=(50, 16)) * 0.2
    x[150] = x[60]
    x[61] = x[60] * 2
    rows = [(f"k{i}", x[i].tolist(), bool(i < 100)) for i in range(200)]
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    want = {(f"k{i}", f"k{j}") for i in range(100) for j in range(100, 200) if u[i] @ u[j] >= 0.8}
    got = {(r.q, r.r) for r in overlap.vector_pairs(spark.createDataFrame(rows, "k string, vec array<float>, side boolean"), "k", "vec", "side", 16, 0.8).collect()}
    assert len(got & want) >= 0.97 * len(want) and got <= want and ("k60", "k150") in got and ("k61", "k150") in got


def test_layout_cuts_large_cells_and_every_vector_has_a_home(spark):
    """With tasks of few rows, shuffled rows stay in proportion and nothing is lost."""
    rng = np.random.default_rng(8)
    moved = {}
    for n in (4000, 8000):
        x = near_data(rng, n, 16, n // 6)
        df = spark.createDataFrame([(f"i{i:05d}", "m", v.tolist()) for i, v in enumerate(x)], "item_id string, method string, vec array<float>")
        space = [Space("m", "ip", 16)]
        rows = similar.usable(df, space, "method", "vec").select("__space", "item_id", "vec").selectExpr("*", "xxhash64(vec) as node", "0 as sides")
        similar.train(rows, space, "item_id", "vec", 16, 65536, 100)
        out = rows.select("__space", "node", "sides", "vec").mapInArrow(similar._assign(space, 16, 8), similar.MOVED)
        per_task = [(r["n"], r["h"]) for r in out.groupBy("task").agg({"*": "count", "home": "max"}).selectExpr("`count(1)` as n", "1 as h").collect()]
        homes = out.where("home").count()
        moved[n] = sum(a for a, _ in per_task) / n
        assert homes == n and max(a for a, _ in per_task) < 100 * 16 * 2
        got = {(int(r.item_id[1:]), int(r.other[1:])) for r in similar.most_similar(df, [Space("m", "ip", 16)], 5, [0.9], block_rows=100).collect()}
        want = brute(x.astype(np.float32), 5, 0.9, "ip")
        assert len(got & want) >= 0.99 * len(want)
    assert moved[8000] < 1.2 * moved[4000] and moved[8000] <= 16


def test_a_cell_of_many_different_vectors_is_salted():
    s = Space("m", "l2", 4, (np.zeros((2, 2), np.float32), np.zeros((2, 2), np.float32)))
    similar.layout(s, np.zeros(100, int), np.zeros(100, int), 10.0, 2, 100)
    assert s.salted == {0: 10} and s.blocks.tolist() == [2, 1] and s.salts[0] >= 4


def test_kmeans_in_parts_equals_whole():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    assert (similar.nearest(x, x[:50], 100) == similar.nearest(x, x[:50])).all()


def test_hot_code_on_both_sides(spark):
    rows = [(f"q{i}", [5], True) for i in range(40)] + [(f"r{i}", [5 if i < 30 else 4], False) for i in range(40)]
    got = overlap.code_pairs(spark.createDataFrame(rows, "k string, w array<bigint>, s boolean"), "k", "w", "s", 64, 1).count()
    assert got == 1600


def test_record_hash_ignores_case_punctuation_and_blanks(spark):
    df = spark.createDataFrame([("A, b!", "c"), ("a  B", " C."), ("a b c", ""), (None, "..."), ("ab", "c")], "x string, y string")
    h = [r[0] for r in df.select(overlap.record_hash(df.x, df.y)).collect()]
    assert h[0] == h[1] and h[3] is None and len(set(h)) == 4
