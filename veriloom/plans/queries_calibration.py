"""Queries on calibration, inference and localisation over recorded scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.operators import calibrate, evaluate, localize
from veriloom.plans.bindings import RECORDS_SQL, negative_records, table
from veriloom.plans.registry import query

R = "WITH " + RECORDS_SQL
TARGETS = (0.1, 0.01)
PAIR_TARGETS = (1e-3, 1e-4, 1e-5)

THR_SQL = R + """,
cal AS (SELECT method, top1, row_number() OVER (PARTITION BY method ORDER BY top1 DESC) - 1 AS pos, count(*) OVER (PARTITION BY method) AS n FROM rec WHERE cal),
tgt(target) AS (VALUES (0.1::DOUBLE), (0.01::DOUBLE)),
kk AS (SELECT method, target, max(n) AS n, floor(target * max(n))::BIGINT AS k FROM cal, tgt GROUP BY method, target),
thr AS (SELECT kk.method, target, kk.n, kk.k, CASE WHEN kk.k >= 5 AND kk.k < kk.n THEN top1 + 1e-6 END AS threshold, kk.k >= 5 AND kk.k < kk.n AS resolved FROM kk LEFT JOIN cal ON cal.method = kk.method AND cal.pos = kk.k)
"""


def _query_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.query_thresholds(negative_records(spark, d).where("cal").select("method", F.col("top1").alias("score")), list(TARGETS))


@query("CAL1", THR_SQL + "SELECT method, target, n, k, round(threshold, 6) AS threshold, resolved FROM thr")
def negative_query_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _query_thresholds(spark, d).withColumn("threshold", F.round("threshold", 6))


PAIR_SQL = R + """,
n_ref AS (SELECT count(DISTINCT item_id) AS r FROM set_membership WHERE set_name IN ('reg', 'dist')),
s AS (SELECT method, rec_id, unnest(scores) AS score FROM rec WHERE cal),
z AS (SELECT method, rec_id, count(*) AS c, min(score) AS low FROM s GROUP BY ALL),
tot AS (SELECT method, count(*) AS n_queries, sum(c) AS n, max(c) AS depth FROM z GROUP BY method),
tgt(target) AS (VALUES (1e-3::DOUBLE), (1e-4::DOUBLE), (1e-5::DOUBLE)),
kk AS (SELECT method, target, n_queries, n, floor(target * n_queries * (SELECT r FROM n_ref))::BIGINT AS k FROM tot, tgt),
o AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score DESC) - 1 AS pos FROM s),
thr AS (SELECT kk.method, target, n_queries, k, CASE WHEN k >= 5 AND k < n THEN score + 1e-6 END AS threshold, k >= 5 AND k < n AS resolved FROM kk LEFT JOIN o ON o.method = kk.method AND o.pos = kk.k),
w AS (SELECT z.method, max(low) AS worst FROM z JOIN tot USING (method) WHERE c = depth GROUP BY 1)
"""


def _pair_thresholds(spark: SparkSession, d: str) -> DataFrame:
    n_ref = table(spark, d, "set_membership").where(F.col("set_name").isin("reg", "dist")).select("item_id").distinct().count()
    s = negative_records(spark, d).where("cal").select("method", "rec_id", F.explode("scores").alias("score"))
    return calibrate.pair_thresholds(s, n_ref, list(PAIR_TARGETS))


@query("CAL2 CAL3", PAIR_SQL + "SELECT method, target, n_queries, k, round(threshold, 6) AS threshold, resolved, CASE WHEN resolved THEN worst >= threshold END AS saturated FROM thr LEFT JOIN w USING (method)")
def negative_pair_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return _pair_thresholds(spark, d).withColumn("threshold", F.round("threshold", 6))


@query("AGG3 AGG11", THR_SQL + """
SELECT r.method, target, CASE WHEN grouping(attack) = 0 THEN coalesce(attack, 'missing') ELSE '_all' END AS attack, count(*) AS n, sum((top1 >= threshold)::INTEGER)::BIGINT AS hits, round(sum((top1 >= threshold)::INTEGER) / greatest(1, count(*)), 6) AS fpr
FROM rec r JOIN thr ON thr.method = r.method AND resolved WHERE NOT cal GROUP BY GROUPING SETS ((r.method, target, attack), (r.method, target))""")
def heldout_fpr(spark: SparkSession, d: str) -> DataFrame:
    t = _query_thresholds(spark, d).where("resolved").select("method", "target", "threshold")
    r = negative_records(spark, d).where(~F.col("cal")).withColumn("attack", F.coalesce("attack", F.lit("missing"))).join(t, "method")
    out = r.groupingSets([[F.col("method"), F.col("target"), F.col("attack")], [F.col("method"), F.col("target")]], F.col("method"), F.col("target"), F.col("attack")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("top1") >= F.col("threshold")).cast("bigint")).alias("hits"), F.grouping("attack").alias("g"))
    return out.select("method", "target", F.when(F.col("g") == 1, evaluate.ALL).otherwise(F.col("attack")).alias("attack"), "n", "hits", F.round(evaluate.over_max1(F.col("hits"), F.col("n")), 6).alias("fpr"))


@query("AGG4 AGG5 RPT9")
def heldout_fpr_intervals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.with_interval(heldout_fpr(spark, d), "hits", "n")


@query("AGG4 INF9", """
WITH n AS (SELECT method, count(*) AS n FROM (""" + R + """ SELECT method FROM rec) GROUP BY method)
SELECT method, n, round(1 - power(0.025, 1.0::DOUBLE / n), 9) AS upper_at_zero, round(power(0.025, 1.0::DOUBLE / n), 9) AS lower_at_all, ceil(ln(0.025) / ln(1 - 1e-3))::BIGINT AS needed FROM n""")
def interval_edges(spark: SparkSession, d: str) -> DataFrame:
    n = negative_records(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return n.select("method", "n", F.round(evaluate.zero_upper(F.col("n")), 9).alias("upper_at_zero"), F.round(evaluate.full_lower(F.col("n")), 9).alias("lower_at_all"), F.ceil(F.ln(F.lit(0.025)) / F.ln(F.lit(1 - 1e-3))).cast("bigint").alias("needed"))


@query("CAL4", "SELECT method, target, k, threshold IS NULL OR isnan(threshold) OR k IS NULL OR k >= 5 AS consistent FROM thresholds")
def resolvability_guard(spark: SparkSession, d: str) -> DataFrame:
    """Recorded thresholds against the number of scores they leave above."""
    t = table(spark, d, "thresholds").withColumn("thr", F.when(~F.isnan("threshold"), F.col("threshold")))
    n = F.coalesce(F.col("k"), F.lit(5)).cast("double")
    return calibrate.resolvable(t.withColumn("one", F.lit(1.0)).withColumn("n", n), "one", "n", "thr").select("method", "target", "k", "consistent")


@query("CAL5", PAIR_SQL + """,
q AS (SELECT method, quantile_cont(top1, 0.999) AS q FROM rec WHERE cal GROUP BY method),
c0 AS (SELECT method, top1, row_number() OVER (PARTITION BY method ORDER BY top1 DESC) - 1 AS pos, count(*) OVER (PARTITION BY method) AS n FROM rec WHERE cal),
l AS (SELECT method, top1 + 1e-6 AS loose FROM c0 WHERE pos = floor(0.01::DOUBLE * n)::BIGINT AND floor(0.01::DOUBLE * n) >= 5)
SELECT q.method, round(coalesce(thr.threshold, loose, q + 1e-6), 6) AS threshold FROM q LEFT JOIN thr ON thr.method = q.method AND target = 1e-5 LEFT JOIN l ON l.method = q.method""")
def threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    q = calibrate.quantiles(negative_records(spark, d).where("cal"), ["method"], "top1", {"q": 0.999}).drop("n")
    strict = _pair_thresholds(spark, d).where(F.col("target") == PAIR_TARGETS[2]).select("method", F.col("threshold").alias("strict"))
    loose = _query_thresholds(spark, d).where(F.col("target") == TARGETS[1]).select("method", F.col("threshold").alias("loose"))
    return q.join(strict, "method", "left").join(loose, "method", "left").select("method", F.round(calibrate.fallback_threshold(F.col("strict"), F.col("loose"), F.col("q")), 6).alias("threshold"))


@query("CAL8", R + """,
f AS (SELECT method, len(scores) AS inl FROM rec WHERE cal),
g AS (SELECT method, inl, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT method, inl, sum(n) OVER (PARTITION BY method ORDER BY inl DESC) AS above FROM g)
SELECT method, (max(inl) + 1)::INTEGER AS k_zero, coalesce(max(inl) FILTER (WHERE above > 3) + 1, 0)::INTEGER AS k_match FROM c GROUP BY method""")
def verification_k(spark: SparkSession, d: str) -> DataFrame:
    f = negative_records(spark, d).where("cal").select("method", F.size("scores").alias("inliers"))
    return calibrate.verification_ks(f, 3)


@query("AGG7", R + "SELECT method, round(quantile_cont(top1, 0.05), 6) AS p05, round(quantile_cont(top1, 0.25), 6) AS p25, round(median(top1), 6) AS p50, round(quantile_cont(top1, 0.75), 6) AS p75, round(quantile_cont(top1, 0.95), 6) AS p95, count(*) AS n FROM rec GROUP BY method")
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    shares = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    r = calibrate.quantiles(negative_records(spark, d), ["method"], "top1", shares)
    return r.select("method", *[F.round(c, 6).alias(c) for c in shares], "n")


@query("AGG7 RPT17", R + """, x AS (SELECT method, min(top1) AS lo, max(top1) AS hi FROM rec GROUP BY method),
y AS (SELECT method, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM x)
SELECT r.method, least(floor((top1 - lo) / (hi - lo) * 60) + 1, 60)::INTEGER AS bin, count(*) AS n FROM rec r JOIN y ON y.method = r.method GROUP BY ALL""")
def negative_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.histogram(negative_records(spark, d), ["method"], "top1").select("method", "bin", "n")


# Outcomes of pairs of methods on the same source and transformation.
PAIRED_SQL = R + """,
med AS (SELECT method, median(top1) AS m FROM rec GROUP BY method),
o AS (SELECT method, source_id, attack, max((top1 >= m)::INTEGER) AS ok, avg(top1) AS top1 FROM rec JOIN med USING (method) WHERE source_id IS NOT NULL AND attack IS NOT NULL GROUP BY ALL),
pr AS (SELECT a.method AS m1, b.method AS m2, a.source_id, a.ok AS ok1, b.ok AS ok2, a.top1 AS s1, b.top1 AS s2 FROM o a JOIN o b ON a.source_id = b.source_id AND a.attack = b.attack AND a.method < b.method),
bc AS (SELECT m1, m2, sum((ok1 > ok2)::INTEGER)::BIGINT AS b, sum((ok2 > ok1)::INTEGER)::BIGINT AS c FROM pr GROUP BY ALL)
"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = negative_records(spark, d)
    med = calibrate.quantiles(r, ["method"], "top1", {"m": 0.5}).drop("n")
    r = r.join(med, "method").where(F.col("source_id").isNotNull() & F.col("attack").isNotNull())
    return r.groupBy("method", "source_id", "attack").agg(F.max((F.col("top1") >= F.col("m")).cast("int")).alias("ok"), F.avg("top1").alias("top1"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of all pairs of methods on the same source and transformation."""
    o = _outcomes(spark, d)
    a = o.select(F.col("method").alias("m1"), "source_id", "attack", F.col("ok").alias("ok1"), F.col("top1").alias("s1"))
    b = o.select(F.col("method").alias("m2"), "source_id", "attack", F.col("ok").alias("ok2"), F.col("top1").alias("s2"))
    return a.join(b, ["source_id", "attack"]).where(F.col("m1") < F.col("m2"))


@query("INF5 INF6 RPT4", PAIRED_SQL + """,
i AS (SELECT m1, m2, b, c, b + c AS n, unnest(range(greatest(b, c), b + c + 1)) AS i FROM bc),
p AS (SELECT m1, m2, b, c, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END AS p FROM i GROUP BY m1, m2, b, c),
h AS (SELECT * EXCLUDE (p), round(p, 9) AS p, row_number() OVER (ORDER BY round(p, 9), m1, m2) AS rn, count(*) OVER () AS m FROM p)
SELECT m1, m2, b, c, round(p, 6) AS p, round(max(least(1, (m - rn + 1) * p)) OVER (ORDER BY p, m1, m2 ROWS UNBOUNDED PRECEDING), 6) AS holm FROM h""")
def mcnemar_holm(spark: SparkSession, d: str) -> DataFrame:
    """Over all pairs of methods as one family."""
    return _mcnemar(_paired(spark, d))


def _mcnemar(pairs: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def exact(b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([stats.mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype="float64")

    bc = pairs.groupBy("m1", "m2").agg(F.sum((F.col("ok1") > F.col("ok2")).cast("bigint")).alias("b"), F.sum((F.col("ok2") > F.col("ok1")).cast("bigint")).alias("c"))
    t = bc.withColumn("p", F.round(exact("b", "c"), 9))
    order = Window.partitionBy(F.lit(0)).orderBy("p", "m1", "m2")  # one row for each pair of methods
    t = t.withColumn("rn", F.row_number().over(order)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    adjusted = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("rn") + 1) * F.col("p"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return t.select("m1", "m2", "b", "c", F.round("p", 6).alias("p"), F.round(adjusted, 6).alias("holm"))


@query("INF7 JOI20", PAIRED_SQL + """,
dd AS (SELECT m1, m2, source_id, round(avg(s1) - avg(s2), 9) AS d FROM pr GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY m1, m2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY m1, m2, abs(d)) - 1) / 2.0 AS rk FROM dd WHERE d <> 0)
SELECT m1, m2, count(*) AS n, round(least(coalesce(sum(rk) FILTER (WHERE d > 0), 0), coalesce(sum(rk) FILTER (WHERE d < 0), 0)), 6)::DOUBLE AS w FROM r GROUP BY ALL""")
def wilcoxon_statistic(spark: SparkSession, d: str) -> DataFrame:
    return _wilcoxon(_paired(spark, d))


def _wilcoxon(pairs: DataFrame) -> DataFrame:
    dd = pairs.groupBy("m1", "m2", "source_id").agg(F.round(F.avg("s1") - F.avg("s2"), 9).alias("d")).where(F.col("d") != 0)
    size = F.abs(F.col("d"))
    r = dd.withColumn("a", size).withColumn("rk", F.rank().over(Window.partitionBy("m1", "m2").orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy("m1", "m2", "a")) - 1) / 2.0)
    plus, minus = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rk"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rk"))), F.lit(0.0))
    return r.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n"), F.round(F.least(plus, minus), 6).alias("w"))


@query("INF3 INF4 INF6 INF7")
def paired_tests(spark: SparkSession, d: str) -> DataFrame:
    """Sign-flip and signed-rank p values of source means, and the difference in TPR with its interval, one row for each pair of methods.

    As in cluster_bootstrap, calibration records stand in for the positive queries
    and scores of 0.5 and more for right results. holm adjusts p, of the difference
    in TPR, and sign_flip_holm sign_flip, each over all pairs.
    """
    means = _paired(spark, d).groupBy("m1", "m2", "source_id").agg((F.avg("s1") - F.avg("s2")).alias("d"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("source_id")["d"].to_numpy()
        return pd.DataFrame([[*key, len(x), stats.sign_flip(x, seed="|".join(key)), stats.wilcoxon(x)[1]]], columns=["m1", "m2", "n", "sign_flip", "wilcoxon"])

    tests = means.groupBy("m1", "m2").applyInPandas(run, "m1 string, m2 string, n bigint, sign_flip double, wilcoxon double")
    r = negative_records(spark, d).where(F.col("source_id").isNotNull() & F.col("cal").isNotNull())
    right = F.max(F.when(F.col("top1") >= 0.5, F.col("top1"))).alias("top1")
    positives = r.where(F.col("cal") & F.col("attack").isNotNull()).groupBy("method", "source_id", "attack").agg(right)
    difference = evaluate.paired_difference(positives, r.where(~F.col("cal")), "method", "source_id", "attack", "top1", 0.05)
    return evaluate.with_holm(evaluate.with_holm(tests.join(difference, ["m1", "m2"], "left"), "sign_flip", "sign_flip_holm"), "p", "holm")


@query("INF1 INF2 UDF2")
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    r = negative_records(spark, d).where(F.col("source_id").isNotNull() & F.col("cal").isNotNull()).select("method", "source_id", F.col("cal").alias("positive"), (F.col("top1") >= 0.5).alias("hit"), "top1")
    return evaluate.cluster_bootstrap(r, "method", "source_id", "positive", "hit", "top1", 0.05)


@query("LOC3 LOC9", R + """,
c AS (SELECT method, sum((top1 > 0.5 AND cal)::INTEGER) AS tp, sum((top1 > 0.5 AND NOT cal)::INTEGER) AS fp, sum((top1 <= 0.5 AND cal)::INTEGER) AS fn, count(*) AS n FROM rec WHERE cal IS NOT NULL GROUP BY method)
SELECT method, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1, round(1.0 * tp / greatest(1, tp + fp + fn), 6) AS iou, n FROM c""")
def f1_iou_at_threshold(spark: SparkSession, d: str) -> DataFrame:
    return localize.mask_scores(negative_records(spark, d), ["method"], "top1", "cal", 0.5).select("method", F.round("f1", 6).alias("f1"), F.round("iou", 6).alias("iou"), "n")


@query("LOC4", R + """,
g AS (SELECT method, top1, sum(cal::INTEGER) AS p, count(*) AS n FROM rec WHERE cal IS NOT NULL GROUP BY ALL),
c AS (SELECT method, sum(p) OVER w AS tp, sum(n) OVER w AS taken, sum(p) OVER (PARTITION BY method) AS pos FROM g WINDOW w AS (PARTITION BY method ORDER BY top1 DESC))
SELECT method, round(max(2.0 * tp / greatest(1, taken + pos)), 6) AS best_f1 FROM c GROUP BY method""")
def best_f1(spark: SparkSession, d: str) -> DataFrame:
    return localize.best_f1(negative_records(spark, d), ["method"], "top1", "cal").withColumn("best_f1", F.round("best_f1", 6))


@query("LOC5", R + """,
k AS (SELECT method, cal, rank() OVER (PARTITION BY method ORDER BY top1) + (count(*) OVER (PARTITION BY method, top1) - 1) / 2.0 AS rk FROM rec WHERE cal IS NOT NULL),
a AS (SELECT method, sum(rk) FILTER (WHERE cal) AS s, count(*) FILTER (WHERE cal) AS p, count(*) FILTER (WHERE NOT cal) AS q FROM k GROUP BY method)
SELECT method, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0) / (p::DOUBLE * q) END, 6) AS auc FROM a""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return localize.roc_auc(negative_records(spark, d), ["method"], "top1", "cal").withColumn("auc", F.round("auc", 6))


@query("LOC1 LOC2", R + """,
ref AS (SELECT method, top1 FROM rec WHERE cal), tot AS (SELECT method, count(*) AS n FROM ref GROUP BY method),
v AS (SELECT rec_id, method, attack, top1 FROM rec WHERE NOT cal),
c AS (SELECT v.rec_id, v.method, v.attack, any_value(n) AS n, count(ref.top1) FILTER (WHERE ref.top1 < v.top1) AS lo, count(ref.top1) FILTER (WHERE ref.top1 <= v.top1) AS hi FROM v JOIN tot ON tot.method = v.method LEFT JOIN ref ON ref.method = v.method GROUP BY ALL)
SELECT attack, round(avg((lo + hi) / (2 * n)), 6) AS fused, count(*) AS n FROM c GROUP BY attack""")
def midrank_cdf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Mean over methods of the mid-rank position of held-out scores among the calibration scores of their method."""
    r = negative_records(spark, d)
    c = localize.midrank_cdf(r.where(~F.col("cal")).select("method", "attack", "top1"), r.where("cal"), "method", "top1")
    return c.where(F.col("cdf").isNotNull()).groupBy("attack").agg(F.round(F.avg("cdf"), 6).alias("fused"), F.count(F.lit(1)).alias("n"))


@query("AGG17 AGG18 SEC5", R + """,
m AS (SELECT method, source_id, attack, max(top1) AS top1 FROM rec WHERE source_id IS NOT NULL AND attack IS NOT NULL GROUP BY ALL),
o AS (SELECT method, source_id, top1, row_number() OVER (PARTITION BY method, source_id ORDER BY attack) AS ord FROM m),
b AS (SELECT method, source_id, min(ord) FILTER (WHERE top1 < 0.6) AS broke FROM o GROUP BY ALL),
r AS (SELECT method, broke, row_number() OVER (PARTITION BY method ORDER BY broke NULLS LAST, source_id) AS rn, count(*) OVER (PARTITION BY method) AS n FROM b)
SELECT method, CASE WHEN broke IS NULL THEN '>grid' ELSE broke::VARCHAR END AS median_break, n FROM r WHERE rn = floor(n / 2) + 1""")
def median_break(spark: SparkSession, d: str) -> DataFrame:
    """Upper median over sources of the first transformation, in name order, at which the score falls under 0.6."""
    from veriloom.plans.prefix import running_total

    m = negative_records(spark, d).where(F.col("source_id").isNotNull() & F.col("attack").isNotNull()).groupBy("method", "source_id", "attack").agg(F.max("top1").alias("top1"))
    o = m.withColumn("ord", F.row_number().over(Window.partitionBy("method", "source_id").orderBy("attack")))
    b = o.groupBy("method", "source_id").agg(F.min(F.when(F.col("top1") < 0.6, F.col("ord"))).alias("broke")).withColumn("one", F.lit(1))
    r = running_total(b, ["method"], [F.col("broke").asc_nulls_last(), F.col("source_id")], "one", "rn")
    n = r.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return r.join(n, "method").where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("method", F.coalesce(F.col("broke").cast("string"), F.lit(">grid")).alias("median_break"), "n")


@query("AGG23 RPT7", THR_SQL + "SELECT r.method, target, count(*) AS n, round(avg((top1 - 0.05 < threshold)::INTEGER), 6) AS success FROM rec r JOIN thr ON thr.method = r.method AND resolved WHERE top1 >= threshold GROUP BY r.method, target")
def rescore(spark: SparkSession, d: str) -> DataFrame:
    """Share of accepted scores that a loss of 0.05 would reject."""
    t = _query_thresholds(spark, d).where("resolved").select("method", "target", "threshold")
    r = negative_records(spark, d).join(t, "method").where(F.col("top1") >= F.col("threshold"))
    return r.groupBy("method", "target").agg(F.count(F.lit(1)).alias("n"), F.round(evaluate.share(F.col("top1") - 0.05 < F.col("threshold")), 6).alias("success"))


@query("CAL7 RPT10", R + "SELECT method, round(coalesce(quantile_cont(m, 0.99), 0.8), 6) AS tau FROM (SELECT method, source_id, max(top1) AS m FROM rec WHERE NOT cal GROUP BY ALL) GROUP BY method")
def interval_threshold(spark: SparkSession, d: str) -> DataFrame:
    m = negative_records(spark, d).where(~F.col("cal")).groupBy("method", "source_id").agg(F.max("top1").alias("m"))
    return calibrate.quantiles(m, ["method"], "m", {"q": 0.99}).select("method", F.round(F.coalesce("q", F.lit(0.8)), 6).alias("tau"))
