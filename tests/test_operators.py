import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.functions import formats, stats
from veriloom.operators import calibrate, design, evaluate, features, localize, payload, postings, retrieval


def test_query_thresholds_against_sorting(spark):
    rows = [("m", 1.0 / i) for i in range(1, 601)] + [("few", 0.5)] * 20 + [("m", None), ("m", float("nan")), (None, 9.0)]
    got = {(r.method, r.target): r for r in calibrate.query_thresholds(spark.createDataFrame(rows, "method string, score double"), [0.01, 0.001, 1.0]).collect()}
    assert got["m", 0.01].k == 6 and got["m", 0.01].threshold == pytest.approx(1 / 7 + 1e-6)
    assert not got["m", 0.001].resolved and got["m", 0.001].threshold is None and not got["m", 1.0].resolved
    assert got["few", 0.01].k == 0 and not got["few", 0.01].resolved


def test_known_resolvability(spark):
    # 500 negatives, 443 references: query 1e-2 and pair 1e-4 are resolved, query 1e-3 and pair 1e-5 are not.
    rows = [("v", q, 1.0 - 0.001 * q - 0.0001 * r) for q in range(500) for r in range(3)]
    df = spark.createDataFrame(rows, "method string, rec_id long, score double")
    q = {r.target: (r.k, r.resolved) for r in calibrate.query_thresholds(df.groupBy("method", "rec_id").agg(F.max("score").alias("score")), [1e-2, 1e-3]).collect()}
    p = {r.target: (r.k, r.resolved, r.saturated) for r in calibrate.pair_thresholds(df, 443, [1e-4, 1e-5]).collect()}
    assert q == {1e-2: (5, True), 1e-3: (0, False)}
    assert p[1e-4][:2] == (22, True) and p[1e-5] == (2, False, None) and p[1e-4][2] is True


def test_alternate_calibration_half(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), ("d",), ("a",), (None,)], "source_id string")
    assert sorted((r.source_id, r.calibration) for r in calibrate.keep_alternate(df).collect()) == [("a", True), ("b", False), ("c", True), ("d", False)]


def test_micro_ap_prefers_positives_on_ties(spark):
    rows = [(0.5, True, 0, 0, 1), (0.5, True, 0, 1, 1), (0.5, False, 1, 0, 1), (0.5, False, 1, 1, 1)]
    df = spark.createDataFrame(rows, "score double, correct boolean, negative int, ord int, rank int")
    assert evaluate.micro_ap(df, 2).first()["micro_ap"] == 1.0
    assert evaluate.micro_ap(df.limit(0), 2).first()["micro_ap"] == 0.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(61)] + [("b", 2.0)] * 3 + [("a", None), ("a", float("nan"))], "g string, x double")
    got = {(r.g, r.bin): r.n for r in evaluate.histogram(df, ["g"], "x").collect()}
    assert got["a", 60] == 2 and got["a", 1] == 1 and got["b", 31] == 3 and sum(got.values()) == 64


def test_strata_and_empty_denominator(spark):
    df = spark.createDataFrame([("x", True), ("x", False), (None, True)], "k string, h boolean")
    got = {(r.stratum, r.level): r.s for r in evaluate.by_stratum(df, ["k"], evaluate.share(F.col("h")).alias("s")).collect()}
    assert got == {("k", "x"): 0.5, ("k", "missing"): 1.0, ("_all", "_all"): pytest.approx(2 / 3)}
    assert df.limit(0).agg(evaluate.over_max1(F.coalesce(F.count("h"), F.lit(0)), F.count("h")).alias("f")).first()["f"] == 0


def test_intervals(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (None, 10)], "k int, n int")
    got = [(r.lo, r.hi) for r in evaluate.with_interval(df, "k", "n").collect()]
    assert got[0][1] == pytest.approx(1 - 0.025 ** (1 / 10)) and got[1][0] == pytest.approx(0.025 ** (1 / 10)) and got[2] == pytest.approx(stats.clopper_pearson(3, 10)) and got[3] == (None, None)


def test_best_by_ignores_nan(spark):
    df = spark.createDataFrame([("t", "a", float("nan")), ("t", "b", 0.1), ("t", "c", 0.1), ("u", "d", None)], "g string, n string, v double")
    assert sorted((r.g, r.n) for r in evaluate.best_by(df, ["g"], "v", "n").collect()) == [("t", "b"), ("u", "d")]


def test_cluster_bootstrap_brackets_the_rate(spark):
    rng = np.random.default_rng(1)
    rows = [("m", f"s{i % 60}", bool(i % 2), bool(rng.random() < 0.7), float(rng.random())) for i in range(1200)]
    r = evaluate.cluster_bootstrap(spark.createDataFrame(rows, "m string, s string, p boolean, h boolean, x double"), "m", "s", "p", "h", "x", 0.1).first()
    assert r.recall_lo < 0.7 < r.recall_hi and 0 <= r.fpr_lo <= r.fpr_hi <= 0.3 and r.unresolved == 0


def test_longest_run_first_wins(spark):
    rows = [("a", i, f) for i, f in enumerate([True, True, False, True, True, False])] + [("b", 0, False), ("b", 1, None), ("c", 0, True)]
    got = {r.g: (r.start, r.end) for r in localize.longest_run(spark.createDataFrame(rows, "g string, i int, f boolean"), "g", ["i"], "f").collect()}
    assert got == {"a": (0, 2), "c": (0, 1)}


def test_diagonal_offset(spark):
    rows = [("q", i, j, 1.0 if j == i + 3 else 0.0) for i in range(4) for j in range(9)]
    r = localize.diagonal_offset(spark.createDataFrame(rows, "g string, i int, j int, s double"), "g", "i", "j", "s").first()
    assert (r.offset, r.mean_sim, r.overlap) == (3, 1.0, 4)


def test_mask_scores_auc_f1_and_cdf(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, True), ("a", 0.1, False), ("a", 0.0, False), ("t", 0.5, True), ("t", 0.5, False), ("o", 0.5, True)], "g string, s double, t boolean")
    m = {r.g: (r.f1, r.iou) for r in localize.mask_scores(df, ["g"], "s", "t", 0.5).collect()}
    assert m["a"] == (1.0, 1.0) and m["t"] == (0.0, 0.0)
    assert {r.g: r.auc for r in localize.roc_auc(df, ["g"], "s", "t").collect()} == {"a": 1.0, "t": 0.5, "o": None}
    assert {r.g: r.best_f1 for r in localize.best_f1(df, ["g"], "s", "t").collect()}["a"] == 1.0
    null = spark.createDataFrame([("n", 0.0)] * 90 + [("n", 0.1 + 0.1 * i) for i in range(10)], "g string, v double")
    assert localize.midrank_cdf(spark.createDataFrame([("n", 0.0)], "g string, v double"), null, "g", "v").first()["cdf"] == pytest.approx(0.45)


def test_interval_iou(spark):
    df = spark.createDataFrame([(1.25, 3.75), (0.0, 1.0), (0.0, 2.5), (None, 1.0)], "a double, z double")
    assert [r.iou for r in localize.interval_iou(df, "a", "z", 1.25, 3.75).collect()] == pytest.approx([1.0, 0.0, 1.25 / 3.75, 0.0])


def test_offset_vote_finds_the_excerpt(spark):
    doc = " ".join(f"w{i}" for i in range(100))
    refs = postings.shingles(spark.createDataFrame([("d", doc), ("e", "other text only here now ok"), ("n", None), ("s", "too short")], "k string, t string"), "k", "t").withColumnRenamed("k", "ref_id")
    q = postings.shingles(spark.createDataFrame([("q", " ".join(doc.split()[30:60]))], "k string, t string"), "k", "t").withColumnRenamed("k", "query_id")
    votes = postings.offset_votes(q, refs)
    best = postings.best_candidates(votes).collect()
    assert [(r.ref_id, r.offset, r.votes, r["rank"]) for r in best] == [("d", 30, 26, 1)]
    assert postings.aligned_counts(votes).first()["count"] == 26
    seq = lambda s, n: s.select(n, "pos", F.col("hash").bitwiseAND(F.lit(4294967295)).alias("word"))
    assert postings.sequence_similarity(seq(q, "query_id"), seq(refs, "ref_id"), postings.best_candidates(votes)).first()["score"] == 1.0


def test_simhash_and_mean_vectors(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "k string, t string")
    code = {r.k: r.code for r in postings.simhash(df, "k", "t").collect()}
    assert code["a"] == code["b"]
    v = postings.mean_vectors(spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 3.0]), ("z", [0.0, 0.0])], "k string, v array<double>"), "k", "v").collect()
    assert {r.k: r.vec for r in v}["a"] == pytest.approx([0.5**0.5] * 2) and {r.k: r.vec for r in v}["z"] == [0.0, 0.0]


@pytest.mark.parametrize("metric", ["ip", "l2", "hamming"])
def test_top_k_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    monkeypatch.setattr(retrieval, "CHUNK_ROWS", 15)
    rng = np.random.default_rng(7)
    if metric == "hamming":
        q, r = rng.integers(-(2**62), 2**62, (30, 2)), rng.integers(-(2**62), 2**62, (100, 2))
        kind, dim = "array<bigint>", 128
    else:
        q, r = np.round(rng.normal(size=(30, 6)), 1), np.round(rng.normal(size=(100, 6)), 1)
        kind, dim = "array<double>", 6
    s = retrieval.scores(np.ascontiguousarray(q), np.ascontiguousarray(r), metric, dim)
    want = {(i, n + 1): j for i in range(30) for n, j in enumerate(sorted(range(100), key=lambda j: (-s[i, j], j))[:5])}
    qd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(None, q[0].tolist()), (99, None)], f"query_id long, query {kind}")
    rd = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r)] + [(None, r[0].tolist())], f"ref_id long, ref {kind}")
    assert {(x.query_id, x["rank"]): x.ref_id for x in retrieval.top_k(qd, rd, 5, metric, dim).collect()} == want
    least = float(np.sort(s.ravel())[-40])
    assert {(x.query_id, x.ref_id) for x in retrieval.within(qd, rd, least, metric, dim).collect()} == {(i, j) for i in range(30) for j in range(100) if s[i, j] >= least and i != j}
    assert retrieval.top_k(qd, rd.limit(0), 5, metric, dim).count() == 0


def test_variants_share_a_place(spark):
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 1.0])], "query_id string, query array<double>")
    r = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.6, 0.8])], "ref_id string, ref array<double>")
    assert [(x.ref_id, x.score) for x in retrieval.top_k(q, r, 2, "ip", 2).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.8)]


def test_flags_and_aliases(spark):
    e = spark.createDataFrame([("i", "A", "x"), ("i", "B", "y"), ("j", "A", "x"), ("j", "B", "x")], "item_id string, method string, anchor_id string")
    assert {m: sorted(r.item_id for r in retrieval.flags(e, m).collect()) for m in ("any", "two", "none")} == {"any": ["i", "j"], "two": ["j"], "none": []}
    f = spark.createDataFrame([("q", "dup"), ("q", "ref")], "query_id string, ref_id string")
    a = spark.createDataFrame([("dup", "ref"), ("dup", "zzz")], "alias_id string, ref_id string")
    assert [r.ref_id for r in retrieval.rewrite_aliases(f, a).collect()] == ["ref", "ref"]
    reg = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted((r.k, r.v) for r in retrieval.substitute(reg, spark.createDataFrame([("b", 9)], "k string, v int"), "k", "v").collect()) == [("a", 1), ("b", 9)]


def test_payload_bits_and_gates(spark):
    df = spark.createDataFrame([([1, 0, 1], [1, 1, 1]), ([1, 0], [1, 1, 1]), (None, [1, 1, 1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(payload.equal_bits(df["a"], df["b"], 3)).collect()] == [2, 0, 0]
    per = spark.createDataFrame([("c", "s1", 96, 96), ("c", "s2", 100, 94), ("d", "s1", 10, 10)], "config string, set_name string, n int, hits int")
    meta = spark.createDataFrame([("c", None, 0.0, True, 0), ("d", 0.0, 0.5, True, None), ("e", None, None, True, 0)], "config string, native_fpr double, key_fpr double, deployable boolean, errors int")
    got = {r.config: (r.robust, r.fpr_ok, r.eligible) for r in payload.gate(per, meta).collect()}
    assert got == {"c": (False, True, False), "d": (True, True, True), "e": (False, False, False)}
    assert payload.k_thresholds(spark.createDataFrame([(32,), (16,)], "nbits int")).orderBy("nbits").select("k").collect() == [(17,), (30,)]


def test_ranks_are_ordinal_and_costs(spark):
    df = spark.createDataFrame([("a", 0.1, 0.5, 1.0, "x"), ("b", 0.1, 0.4, 2.0, "x"), ("c", None, 0.4, 3.0, "y")], "config string, flip double, lpips double, psnr double, family string")
    r = payload.rank_sum(df, "flip", "lpips", "psnr")
    assert {x.config: (x.rank_first, x.rank_second, x.place) for x in r.collect()} == {"a": (1, 3, 2), "b": (2, 1, 1), "c": (3, 2, 3)}
    assert {x.role: x.config for x in payload.runner_up(r).collect()} == {"default": "b", "runner_up": "c"}
    row = spark.range(1).select(payload.usd_per_unit(F.lit(8.79), 1000, 1.006).alias("c"), payload.psnr(F.lit(0.0)).alias("p"), payload.psnr(F.lit(0.01)).alias("q")).first()
    assert row.c == pytest.approx(0.00246, abs=1e-5) and row.p == 100 and row.q == pytest.approx(20)


def test_designs(spark):
    s = spark.createDataFrame([(f"s{i}",) for i in range(96)] + [(None,)], "k string")
    rows = design.balanced_design(s, "k", {"t": list("abcdef"), "a": [1, 2, 3, 4], "p": list("wxyz")}, 12, "x").collect()
    assert len(rows) == 96 * 12
    for level in ("t", "a", "p"):
        n = {}
        for r in rows:
            n[r[level]] = n.get(r[level], 0) + 1
        assert max(n.values()) - min(n.values()) <= 1
    split = design.rank_split(s, "k", [("reg", 0.25), ("neg", 0.25), ("dist", 0.5)], "x").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"reg": 24, "neg": 24, "dist": 48}
    bad = spark.createDataFrame([("i", "c1", True), ("i", "c2", True), ("j", "c1", True), ("j", "c2", False)], "item string, config string, f boolean")
    assert [r.item for r in design.failing_everywhere(bad, "item", "config", F.col("f")).collect()] == ["i"]
    lic = spark.createDataFrame([("CC BY 4.0",), ("CC BY-NC 4.0",), ("research only",), (None,), ("MIT",)], "l string")
    assert [r[0] for r in lic.select(design.open_licence(F.col("l"))).collect()] == [True, False, False, False, True]
    t = spark.createDataFrame([("c", 0.0), ("c", 0.4), ("c", 0.6), ("c", 1.2), ("c", 1.6), ("c", None)], "clip string, t double")
    assert sorted((r.k, r.t) for r in design.frame_samples(t, "clip", "t", 1.0).collect()) == [(0, 0.6), (1, 1.6)]


def test_features(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0]), (2, None), (3, [1.0])], "k int, v array<double>")
    m = features.signs("key", 2, 4)
    want = sum(1 << b for b in range(4) if np.array([1.0, -2.0]) @ m[:, b] > 0)
    assert [r.c for r in df.select(features.keyed_code(df["v"], "key", 2, 4).alias("c")).collect()] == [want, None, None]
    img = bytes(np.random.default_rng(0).integers(0, 256, 64 * 64, dtype=np.uint8))
    out = features.extract(spark.createDataFrame([(1, bytearray(img)), (2, None)], "k int, b binary"), "blockhash", "k", "b").collect()
    assert len(out[0].vec) == 256 and out[1].vec is None


def test_formats(spark):
    r = spark.range(1).select(formats.fixed(F.lit(0.8125), 3).alias("a"), formats.percent(F.lit(0.125), 1).alias("b"), formats.thousands(F.lit(1234567)).alias("c"), formats.significant(F.lit(0.012345), 3).alias("d"), formats.significant(F.lit(0.0), 3).alias("e")).first()
    assert tuple(r) == ("0.813", "12.5%", "1,234,567", "0.0123", "0")
