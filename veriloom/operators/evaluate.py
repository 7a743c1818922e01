"""Stratified quality of retrieval, payload and localisation results."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.plans.prefix import running_total

ALL = "_all"


def by_stratum(rows: DataFrame, strata: list[str], *aggs: Column, total: bool = True) -> DataFrame:
    """(stratum, value, aggregates): each single column of ``strata`` by value, and the whole as ``_all``.

    Grouping sets make it one pass. A null value of a stratum is reported as
    ``missing``.
    """
    filled = rows
    for s in strata:
        filled = filled.withColumn(s, F.coalesce(F.col(s).cast("string"), F.lit("missing")))
    sets = [[F.col(s)] for s in strata] + ([[]] if total else [])
    out = filled.groupingSets(sets, *[F.col(s) for s in strata]).agg(*aggs, *[F.grouping(s).alias(f"__g_{s}") for s in strata])
    name, value = F.lit(ALL), F.lit(ALL)
    for s in strata:
        here = F.col(f"__g_{s}") == 0
        name, value = F.when(here, s).otherwise(name), F.when(here, F.col(s)).otherwise(value)
    return out.withColumn("stratum", name).withColumn("level", value).drop(*strata, *[f"__g_{s}" for s in strata])


def share(condition: Column) -> Column:
    """Mean of a condition over its non-null rows."""
    return F.avg(condition.cast("double"))


def over_max1(hits: Column, n: Column) -> Column:
    """hits / max(1, n): 0 for an empty group."""
    return hits / F.greatest(F.lit(1), n)


def micro_ap(results: DataFrame, n_pos: int, groups: list[str] | None = None) -> DataFrame:
    """Micro-average precision of pooled results: (groups, micro_ap, n_results).

    ``results`` has score, correct, negative (0 for results of positive queries),
    ord (of the query) and rank. They are ranked by descending score, ties with
    positives first, then by ord and rank; the sum of the precisions at correct
    results is divided by ``n_pos``, the number of positive queries.
    """
    groups = groups or []
    order = [F.col("score").desc(), F.col("negative"), F.col("ord"), F.col("rank")]
    r = results.withColumn("__one", F.lit(1)).withColumn("__c", F.col("correct").cast("int"))
    r = running_total(r, groups, order, "__one", "__rn")
    r = running_total(r.withColumnRenamed("__rn", "position"), groups, order, "__c", "__hits")
    precision = F.when(F.col("__c") == 1, F.col("__hits") / F.col("position"))
    return r.groupBy(*groups).agg((F.coalesce(F.sum(precision), F.lit(0.0)) / F.lit(float(max(1, n_pos)))).alias("micro_ap"), F.count(F.lit(1)).alias("n_results"))


def histogram(rows: DataFrame, groups: list[str], value: str, bins: int = 60) -> DataFrame:
    """(groups, bin, n, lo, hi): equal bins from 1 between a group's extremes, the last one closed.

    A group whose values are all equal is widened by 0.5 on either side. Null and
    NaN values are left out, and empty bins have no row.
    """
    v = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = v.groupBy(*groups).agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    flat = F.col("__lo") == F.col("__hi")
    ends = ends.select(*groups, F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("lo"), F.when(flat, F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("hi"))
    joined = v.join(ends, groups) if groups else v.crossJoin(ends)  # without groups, one row
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)).cast("int")
    return joined.groupBy(*groups, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def with_interval(counts: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """``counts`` with lo and hi, the exact two-sided interval of k of n; null counts have a null interval."""
    @F.pandas_udf("lo double, hi double")
    def interval(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        pairs = [stats.clopper_pearson(int(a), int(b), alpha) if pd.notna(a) and pd.notna(b) else (None, None) for a, b in zip(ks, ns, strict=True)]
        return pd.DataFrame(pairs, columns=["lo", "hi"], dtype="float64")

    return counts.withColumn("__i", interval(F.col(k).cast("double"), F.col(n).cast("double"))).withColumns({"lo": F.col("__i.lo"), "hi": F.col("__i.hi")}).drop("__i")


def zero_upper(n: Column, alpha: float = 0.05) -> Column:
    """Upper end of the two-sided interval for no hits of n; 1 for no trials."""
    return F.when(n > 0, 1 - F.pow(F.lit(alpha / 2), 1.0 / n)).otherwise(1.0)


def full_lower(n: Column, alpha: float = 0.05) -> Column:
    """Lower end of the two-sided interval for n hits of n; 0 for no trials."""
    return F.when(n > 0, F.pow(F.lit(alpha / 2), 1.0 / n)).otherwise(0.0)


def best_by(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """(group, name, value) of the largest value in each group; nulls and NaN count as -1, ties go to the smallest name."""
    v = F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(-1.0))
    best = Window.partitionBy(*group).orderBy(v.desc(), F.col(name))
    return rows.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == 1).select(*group, name, value)


def cluster_bootstrap(rows: DataFrame, group: str, source: str, positive: str, hit: str, score: str, target: float, draws: int = 2000, mean_draws: int = 10_000) -> DataFrame:
    """Source-clustered intervals of recall, TPR, FPR and mean score per group, the threshold being computed again in each draw.

    (group, recall_lo, recall_hi, tpr_lo, tpr_hi, fpr_lo, fpr_hi, unresolved,
    mean_lo, mean_hi). Sources are drawn with replacement; a draw weights each row
    by the times its source was drawn. Spark counts the rows of each source by
    score first; a group's task holds these counts, sorts them once, and a draw is
    a weighted sum. Groups are not split further. The mean of the finite scores,
    of ``mean_draws`` draws, is not defined for fewer than two sources.
    """
    schema = f"`{group}` string, recall_lo double, recall_hi double, tpr_lo double, tpr_hi double, fpr_lo double, fpr_hi double, unresolved double, mean_lo double, mean_hi double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids, at = np.unique(pdf["__s"].astype(str), return_inverse=True)
        pos, ok = pdf["__p"].to_numpy(bool), pdf["__h"].to_numpy(bool)
        s, times = pdf["__x"].to_numpy(float), pdf["__n"].to_numpy(float)
        rng, got, bad = stats.rng_for("bootstrap", key[0]), [], 0
        cal = ~pos & (at % 2 == 0)
        test = ~pos & ~cal

        def per_source(rows: np.ndarray) -> np.ndarray:
            return np.bincount(at[rows], weights=times[rows], minlength=len(ids))

        def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = np.flatnonzero(rows)
            rows = rows[np.argsort(-s[rows], kind="stable")]
            return s[rows], at[rows], times[rows]

        def passed(r: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, t: float) -> float:
            m = np.searchsorted(-r[0], -t, side="right")
            return float((w[r[1][:m]] * r[2][:m]).sum())

        all_pos, all_hits, all_test = per_source(pos), per_source(pos & ok), per_source(test)
        by_cal, by_hit, by_test = ranked(cal), ranked(pos & ok), ranked(test)
        for _ in range(draws):
            w = np.bincount(rng.integers(0, len(ids), len(ids)), minlength=len(ids)).astype(float)
            t = stats.ranked_order_statistic(by_cal[0], w[by_cal[1]] * by_cal[2], target)
            n_pos = max(1.0, w @ all_pos)
            r = (w @ all_hits) / n_pos
            if np.isnan(t):
                bad += 1
                got.append((r, np.nan, np.nan))
            else:
                got.append((r, passed(by_hit, w, t) / n_pos, passed(by_test, w, t) / max(1.0, w @ all_test)))
        q = [np.nanpercentile(c, (2.5, 97.5)) if np.isfinite(c).any() else (np.nan, np.nan) for c in np.array(got).T]
        ends = stats.source_mean_interval(np.where(np.isfinite(s), s, 0.0) * times, np.where(np.isfinite(s), times, 0.0), at, mean_draws, f"mean|{key[0]}")
        return pd.DataFrame([[key[0], *q[0], *q[1], *q[2], bad / draws, *ends]], columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    r = rows.select(F.col(group).cast("string").alias(group), F.col(source).alias("__s"), F.col(positive).alias("__p"), F.coalesce(F.col(hit), F.lit(False)).alias("__h"), F.col(score).cast("double").alias("__x"))
    return r.groupBy(group, "__s", "__p", "__h", "__x").agg(F.count(F.lit(1)).alias("__n")).groupBy(group).applyInPandas(run, schema)


def shared_thresholds(negatives: DataFrame, group: str, source: str, score: str, target: float, draws: int = 2000) -> DataFrame:
    """(group, full, drawn): each group's threshold on all calibration negatives, and on those of each draw of sources.

    The first, third, ... source in sorted order are the calibration half. A draw
    takes the same sources in every group, as all tasks draw from one generator
    over the sources of all groups. NaN where a threshold is not resolved.
    """
    sources = negatives.where(F.col(source).isNotNull()).select(source).distinct().withColumn("__one", F.lit(1))
    sources = running_total(sources, [], [F.col(source)], "__one", "__rn").where(F.col("__rn") % 2 == 1).select(source, F.floor(F.col("__rn") / 2).alias("__at"))
    n = sources.count()
    counts = negatives.join(sources, source).groupBy(group, "__at", score).agg(F.count(F.lit(1)).alias("__n"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([score, "__at"], ascending=[False, True])
        s, at, times = pdf[score].to_numpy(float), pdf["__at"].to_numpy(), pdf["__n"].to_numpy(float)
        rng, drawn = stats.rng_for("paired", "calibration"), []
        for _ in range(draws):
            w = np.bincount(rng.integers(0, n, n), minlength=n)
            drawn.append(stats.ranked_order_statistic(s, w[at] * times, target))
        return pd.DataFrame({group: [key[0]], "full": [stats.ranked_order_statistic(s, times, target)], "drawn": [drawn]})

    return counts.groupBy(group).applyInPandas(run, f"`{group}` string, full double, drawn array<double>")


def paired_difference(positives: DataFrame, negatives: DataFrame, group: str, source: str, on: str, score: str, target: float, draws: int = 2000, flips: int = 20_000) -> DataFrame:
    """(m1, m2, n_queries, diff, diff_lo, diff_hi, unresolved, p): difference in TPR of each pair of groups, sources being resampled.

    ``positives`` has one row for each group, source and ``on``; a row succeeds if
    its score, null for a wrong result, reaches the group's threshold. Both groups
    of a pair share the drawn positive and calibration sources, and the thresholds
    are computed again in each draw. ``p`` is the sign-flip p of the differences
    per source at the full thresholds; diff is null where one is not resolved.
    """
    found = shared_thresholds(negatives, group, source, score, target, draws).collect()  # one row for each group
    full = {r[group]: math.nan if r["full"] is None else r["full"] for r in found}
    drawn = {r[group]: r["drawn"] for r in found}
    side = lambda m, s: positives.select(F.col(group).alias(m), source, on, F.col(score).cast("double").alias(s))
    pairs = side("m1", "s1").join(side("m2", "s2"), [source, on]).where(F.col("m1") < F.col("m2"))
    names = ["m1", "m2", "n_queries", "diff", "diff_lo", "diff_hi", "unresolved", "p"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values([source, on])
        ids, at = np.unique(pdf[source].to_numpy(str), return_inverse=True)
        x, y = pdf["s1"].to_numpy(float), pdf["s2"].to_numpy(float)
        nan = [math.nan] * draws
        t, u = (np.array(drawn.get(m, nan), dtype=float) for m in key)
        n, per = len(ids), np.bincount(at).astype(float)
        rng, diffs, step = stats.rng_for("paired", *key), [], max(1, 1_000_000 // len(x))
        for lo in range(0, draws, step):
            m = min(step, draws - lo)
            w = np.bincount((rng.integers(0, n, (m, n)) + np.arange(m)[:, None] * n).ravel(), minlength=m * n).reshape(m, n)
            d = (x >= t[lo : lo + m, None]).astype(np.int8) - (y >= u[lo : lo + m, None])
            diffs.append((w[:, at] * d).sum(1) / (w @ per))
        good = np.isfinite(t) & np.isfinite(u)
        ends = np.percentile(np.concatenate(diffs)[good], (2.5, 97.5)) if good.any() else (math.nan, math.nan)
        a, b = full.get(key[0], math.nan), full.get(key[1], math.nan)
        d = (x >= a).astype(float) - (y >= b)
        diff = float(d.mean()) if math.isfinite(a) and math.isfinite(b) else math.nan
        return pd.DataFrame([[*key, len(x), diff, *ends, 1 - good.mean(), stats.sign_flip(np.bincount(at, weights=d), flips, "|".join(("success", *key)))]], columns=names)

    return pairs.groupBy("m1", "m2").applyInPandas(run, "m1 string, m2 string, n_queries bigint, diff double, diff_lo double, diff_hi double, unresolved double, p double")


def with_holm(tests: DataFrame, p: str, name: str) -> DataFrame:
    """``tests`` with Holm's adjusted ``p`` over all its rows that have one; few rows, as one task orders them."""
    family = Window.partitionBy(F.col(p).isNull())
    order = family.orderBy(p)
    t = tests.withColumn("__rn", F.row_number().over(order)).withColumn("__m", F.count(F.lit(1)).over(family))
    return t.withColumn(name, F.max(F.least(F.lit(1.0), (F.col("__m") - F.col("__rn") + 1) * F.col(p))).over(family.orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0))).drop("__rn", "__m")
