import numpy as np
import pytest

from veriloom.operators import retrieval
from veriloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def codes(rng, n, base):
    """Codes of the given words near one of some others, words on the first axis."""
    w = base.shape[1]
    bits = (np.uint64(1) << rng.integers(0, 64, (n, w)).astype(np.uint64)) * (rng.random((n, w)) < 0.6)
    return np.ascontiguousarray((base[rng.integers(0, len(base), n)] ^ bits.astype(np.uint64)).T)


@pytest.mark.parametrize("words", [1, 3, 4, 5])
def test_nearest_codes_equal_brute_force(words):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**63, (9, words)).astype(np.uint64)
    q, r = codes(rng, 40, base), codes(rng, 5000, base)
    q[:, 0] = ~r[:, 0]  # all bits differ
    d = sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(int) for x, y in zip(q, r, strict=True))
    for k in (1, 7, 5001):
        want = [(i, int(j), int(d[i, j])) for i in range(40) for j in np.lexsort((np.arange(5000), d[i]))[:k]]
        assert list(zip(*(x.tolist() for x in retrieval._nearest_codes(q, r, k)), strict=True)) == want


def test_second_stage_reads_a_search_that_ran_once(spark):
    """Every use of the second stage ran the search again: its plan must not hold it."""
    df = catalog.queries()["verified_top1"](spark, DATA)
    assert "CoGroups" not in df._jdf.queryExecution().executedPlan().toString() and any("/verified-" in f for f in df.inputFiles())


@pytest.mark.parametrize("words, most", [(1, 0), (4, 0), (4, 16), (4, 31), (5, 16), (4, 256)])
def test_near_codes_equal_brute_force(words, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2**63, (9, words)).astype(np.uint64)
    q, r = codes(rng, 70, base), codes(rng, 900, base)
    d = sum(np.bitwise_count(x[:, None] ^ y[None, :]).astype(int) for x, y in zip(q, r, strict=True))
    found = list(zip(*(x.tolist() for x in retrieval._near_codes(q, r, most)), strict=True))
    assert sorted(found) == [(int(i), int(j), int(d[i, j])) for i, j in zip(*np.nonzero(d <= most), strict=True)]


def test_few_codes_are_compared(monkeypatch):
    """All pairs of a block were compared and listed, however few were near."""
    rng = np.random.default_rng(3)
    q, r = (rng.integers(0, 2**63, (4, n)).astype(np.uint64) for n in (500, 4000))
    q[:, 7] = r[:, 9]
    seen, apart = [], retrieval._apart
    monkeypatch.setattr(retrieval, "_apart", lambda *a: (seen.append(a[1].shape[-1] if a[0].ndim == 2 else 500 * 4000), apart(*a))[1])
    i, j, d = retrieval._near_codes(q, r, 16)
    assert (i.tolist(), j.tolist(), d.tolist()) == ([7], [9], [0]) and sum(seen) < 500 * 4000 / 50


@pytest.mark.parametrize("dim, scale", [(3, 1.0), (96, 1.0), (97, 1e6), (64, 1e-3)])
def test_near_vectors_equal_brute_force(dim, scale):
    rng = np.random.default_rng(dim)
    c = rng.normal(size=(30, dim))
    q, r = ((c[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, dim))) * scale for n in (700, 5000))
    s = np.round(q @ r.T, 9)
    for share in (0.9999, 0.9, 0.2):
        least = float(np.quantile(s, share)) + 3e-10
        i, j, v = retrieval._near_vectors(q, r, least)
        found = np.zeros(s.shape, np.int8)
        np.add.at(found, (i, j), 1)
        assert np.array_equal(found, s >= least) and np.allclose(v, s[i, j])
