from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[find(a)] = find(b)
    groups = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def labelled(spark, edges):
    vertices = sorted({x for e in edges for x in e if x is not None})
    m = spark.createDataFrame([(v,) for v in vertices], "v string")
    got = {}
    for r in components.group_labels(m, spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r.label, set()).add(r.v)
    return {frozenset(g) for g in got.values()}


def test_chain_star_loop_and_nulls(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"s{i}") for i in range(60)] + [("x", "x"), ("y", None), (None, "z"), ("p", "q"), ("p", "q")]
    assert labelled(spark, edges) == brute([e for e in edges]) | {frozenset({"y"}), frozenset({"z"})}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30).map(str), st.integers(0, 30).map(str)), max_size=40))
def test_random_graphs(spark, edges):
    assert labelled(spark, edges) == brute(edges) if edges else True


def test_no_edges(spark):
    assert components.contract(spark.createDataFrame([], "a string, b string")).count() == 0


def tables(spark):
    edits = spark.createDataFrame(
        [(1, "img/PAAAAAAA1.JPG", " Ann "), (1, "img/PAAAAAAA1.JPG", " Ann "), (2, "paaaaaaa2|rot5", "ann"), (3, "paaaaaaa3@8000", "n/a"), (4, None, "BOB"), (5, "paaaaaaa5", "bob"), (6, None, None), (7, "nothing", "unknown"), (8, " paaaaaaa8 ", ""), (None, "paaaaaaa9", None)],
        "edit_id long, src string, author string",
    )
    items = spark.createDataFrame([("paaaaaaa3.png", "c1"), ("x/paaaaaaa4_1024.png", "c1"), ("paaaaaaa4", "c2"), ("paaaaaaa8", "c2"), ("paaaaaaa5", None), ("paaaaaaa1", None)], "item string, clip string")
    return edits, items


def test_edit_group_sources(spark):
    got = {r.edit_id: r.group_src for r in components.edit_group_sources(*tables(spark)).collect()}
    assert got == {1: "paaaaaaa1", 2: "paaaaaaa1", 3: "paaaaaaa3", 8: "paaaaaaa3", 4: "paaaaaaa5", 5: "paaaaaaa5"}


def test_edit_splits_keep_groups_together(spark):
    edits, items = tables(spark)
    rows = components.edit_splits(edits, items, [("train", 70), ("test", 30)]).collect()
    assert sorted(r.edit_id for r in rows) == list(range(1, 9))
    assert all(len({r.split_name for r in rows if r.label == lab}) == 1 for lab in {r.label for r in rows})


def test_split_shares_with_a_giant(spark):
    df = spark.createDataFrame([("giant", 330)] + [(f"g{i}", 1) for i in range(670)], "label string, weight long")
    n = Counter()
    for r in components.weighted_splits(df, [("train", 70), ("validation", 10), ("test", 20)]).collect():
        n[r.split_name] += r.weight
        assert r.label != "giant" or r.split_name == "train"
    assert abs(n["train"] - 700) <= 1 and abs(n["validation"] - 100) <= 1 and abs(n["test"] - 200) <= 1
    assert components.weighted_splits(df.limit(0), [("train", 1)]).count() == 0
