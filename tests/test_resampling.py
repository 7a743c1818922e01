"""Numbers of draws and flips, and the interval of the mean of items."""

import inspect

import numpy as np
import pytest

from veriloom.functions import stats
from veriloom.operators import evaluate
from veriloom.plans import queries_calibration


def test_resampling_is_not_cut():
    defaults = {n: p.default for n, p in inspect.signature(evaluate.cluster_bootstrap).parameters.items()}
    assert (defaults["draws"], defaults["mean_draws"]) == (2000, 10_000)
    assert inspect.signature(stats.sign_flip).parameters["flips"].default == 20_000
    assert "draws=" not in inspect.getsource(queries_calibration.cluster_bootstrap) and stats.sign_flip(np.ones(40)) == pytest.approx(1 / 20_001)
    assert ", 2000" not in inspect.getsource(queries_calibration.paired_tests)


def test_bootstrap_equals_one_that_weights_each_row(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"s{i % 40:02d}", bool(i % 3), bool(rng.random() < 0.7), float(rng.integers(0, 50))) for i in range(900)]
    got = evaluate.cluster_bootstrap(spark.createDataFrame(rows, "m string, s string, p boolean, h boolean, x double"), "m", "s", "p", "h", "x", 0.1, draws=60).first()
    _, at = np.unique([r[1] for r in rows], return_inverse=True)
    pos, ok, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    cal = ~pos & (at % 2 == 0)
    test, gen, want = ~pos & ~cal, stats.rng_for("bootstrap", "m"), []
    for _ in range(60):
        w = np.bincount(gen.integers(0, 40, 40), minlength=40)[at].astype(float)
        t = stats.weighted_order_statistic(s[cal], w[cal], 0.1)
        want.append([(w * (pos & ok)).sum() / (w * pos).sum(), (w * (pos & ok & (s >= t))).sum() / (w * pos).sum(), (w * (test & (s >= t))).sum() / (w * test).sum()])
    ends = np.percentile(np.array(want), (2.5, 97.5), axis=0)
    assert [got.recall_lo, got.tpr_lo, got.fpr_lo, got.recall_hi, got.tpr_hi, got.fpr_hi] == pytest.approx(ends.ravel().tolist())
    assert got.mean_lo < s.mean() < got.mean_hi
