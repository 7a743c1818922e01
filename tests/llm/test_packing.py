import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veriloom.llm import packing


def plain_ffd(sizes, capacity):
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    free, out = [], [0] * len(sizes)
    for i in order:
        for b, f in enumerate(free):
            if f >= sizes[i]:
                free[b] -= sizes[i]
                out[i] = b
                break
        else:
            out[i] = len(free)
            free.append(capacity - sizes[i])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_tree_equals_plain_first_fit_decreasing(sizes):
    assert packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 20).tolist() == plain_ffd(sizes, 20)


def test_pack_conserves_tokens_and_capacity(spark):
    sizes = [None, 0, 1, 10, 11, 20, 35] + [3] * 300
    df = spark.createDataFrame([(i, n, "c") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    rows = packing.pack(df, 10, group_rows=50).collect()
    fill, total, starts = {}, {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        starts.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert max(fill.values()) <= 10 and total == {i: n for i, n in enumerate(sizes) if n}
    assert sorted(starts[6]) == [(0, 0, 10), (1, 10, 10), (2, 20, 10), (3, 30, 5)]
    assert all(len(s) == 1 for d, s in starts.items() if sizes[d] <= 10)
    assert sum(fill.values()) / (10 * len(fill)) > 0.85


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 4), (1, 4)], "doc_id long, n_tokens long")
    assert packing.pack(df, 10).count() == 2 and packing.pack(df.limit(0), 10).count() == 0


def test_token_count_is_wordpunct(spark):
    texts = ["", "  ", "a-b c_d 12.5!", "Ünïcode… “x” y", "½ ² 漢字, ok", "a b\x1cc\u0085d", None, "x" * 200_000, "!? " * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(packing.token_count(df["t"])).collect()]
    assert got == [None if t is None else len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]
