"""Decision thresholds from held-out negatives.

Order statistics are found without sorting a whole group in one task: scores
are compacted to distinct values with their frequencies and summed in
descending order over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.plans.prefix import running_total

STEP = 1e-6
LEAST_ABOVE = 5


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def descending_statistic(rows: DataFrame, groups: list[str], score: str, ranks: DataFrame, rank: str) -> DataFrame:
    """``ranks`` with ``value``: the score at position ``rank`` (from 0) of its group in descending order, null beyond the end."""
    freq = rows.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("__f"))
    cum = running_total(freq, groups, [F.col(score).desc()], "__f", "__upto").select(*groups, F.col(score).alias("__score"), "__f", "__upto")
    hit = ranks.join(cum, groups).where((F.col("__upto") > F.col(rank)) & (F.col("__upto") - F.col("__f") <= F.col(rank)))
    return ranks.join(hit.select(*groups, rank, F.col("__score").alias("value")).distinct(), [*groups, rank], "left")


def quantiles(rows: DataFrame, groups: list[str], score: str, shares: dict[str, float]) -> DataFrame:
    """(groups, n, one column for each of ``shares``): quantiles of the non-null scores of each group, linear between neighbours.

    Distinct scores with their frequencies are summed over range partitions, so no
    task holds a group. A null group is a group; one without scores has no row.
    """
    freq = rows.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("__score")).agg(F.count(F.lit(1)).alias("__f"))
    cum = running_total(freq, groups, [F.col("__score")], "__f", "__upto")
    size = cum.groupBy(*[F.col(g).alias(f"__{g}") for g in groups]).agg(F.max("__upto").alias("__n"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    both = cum.join(size, same)
    holds = lambda at: F.max(F.when((F.col("__upto") > at) & (F.col("__upto") - F.col("__f") <= at), F.col("__score")))
    aggs = [F.max("__n").alias("n")]
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("__n") - 1)
        aggs += [holds(F.floor(at)).alias(f"__lo_{name}"), holds(F.ceil(at)).alias(f"__hi_{name}"), F.max(at - F.floor(at)).alias(f"__by_{name}")]
    out = both.groupBy(*groups).agg(*aggs)
    return out.select(*groups, "n", *[F.when(F.col(f"__lo_{c}") == F.col(f"__hi_{c}"), F.col(f"__lo_{c}")).otherwise(F.col(f"__lo_{c}") * (1 - F.col(f"__by_{c}")) + F.col(f"__hi_{c}") * F.col(f"__by_{c}")).alias(c) for c in shares])


def query_thresholds(top1: DataFrame, targets: list[float], group: str = "method", score: str = "score") -> DataFrame:
    """(group, target, n, k, threshold, resolved): thresholds that a share ``target`` of the negative queries exceeds.

    k = floor(target * n) queries may lie above; the threshold is the score of
    the one after, plus 1e-6, and is unresolved (null) where k is below 5 or all
    queries may lie above. Null and non-finite scores are left out.
    """
    rows = top1.where(F.col(group).isNotNull() & finite(F.col(score))).select(group, F.col(score).cast("double").alias("score"))
    wanted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    wanted = wanted.withColumn("k", F.floor(F.col("target") * F.col("n")).cast("bigint"))
    found = descending_statistic(rows, [group], "score", wanted, "k")
    ok = (F.col("k") >= LEAST_ABOVE) & (F.col("k") < F.col("n"))
    return found.select(group, "target", "n", "k", F.when(ok, F.col("value") + STEP).alias("threshold"), ok.alias("resolved"))


def pair_thresholds(scores: DataFrame, n_ref: int, targets: list[float], group: str = "method", query: str = "rec_id", score: str = "score") -> DataFrame:
    """(group, target, n_queries, k, threshold, resolved, saturated): thresholds that a share of all pairs of a query and a reference exceeds.

    ``scores`` has the recorded best scores of each negative query, one row each.
    k = floor(target * queries * n_ref); unresolved where k is below 5 or there
    are no more than k recorded scores. saturated: some query's smallest recorded
    score is at the threshold or above, so scores beyond the record are missing.
    """
    rows = scores.where(F.col(group).isNotNull() & F.col(query).isNotNull() & finite(F.col(score))).select(group, query, F.col(score).cast("double").alias("score"))
    sizes = rows.groupBy(group, query).agg(F.count(F.lit(1)).alias("__c"), F.min("score").alias("__low"))
    total = sizes.groupBy(group).agg(F.count(F.lit(1)).alias("n_queries"), F.sum("__c").alias("__n"), F.max("__c").alias("__depth"))
    wanted = total.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).withColumn("k", F.floor(F.col("target") * F.col("n_queries") * F.lit(n_ref)).cast("bigint"))
    found = descending_statistic(rows, [group], "score", wanted, "k")
    ok = (F.col("k") >= LEAST_ABOVE) & (F.col("k") < F.col("__n"))
    found = found.withColumn("threshold", F.when(ok, F.col("value") + STEP)).withColumn("resolved", ok)
    # Only queries that fill the record's depth can hide further scores.
    worst = sizes.join(total.select(group, "__depth"), group).where(F.col("__c") == F.col("__depth")).groupBy(group).agg(F.max("__low").alias("__worst"))
    return found.join(worst, group, "left").select(group, "target", "n_queries", "k", "threshold", "resolved", F.when(F.col("resolved"), F.col("__worst") >= F.col("threshold")).alias("saturated"))


def resolvable(records: DataFrame, target: str = "target", n: str = "n", threshold: str = "threshold") -> DataFrame:
    """``records`` with ``consistent``: false where a threshold is given although its target leaves fewer than five above."""
    return records.withColumn("consistent", F.col(threshold).isNull() | (F.col(target) * F.col(n) >= LEAST_ABOVE))


def fallback_threshold(strict: Column, loose: Column, quantile: Column) -> Column:
    """The strict threshold if resolved, else the loose one, else the quantile plus 1e-6."""
    return F.coalesce(strict, loose, quantile + STEP)


def verification_ks(counts: DataFrame, one_stage: int, group: str = "method", inliers: str = "inliers") -> DataFrame:
    """(group, k_zero, k_match): inlier counts that accept no calibration negative, and at most as many as ``one_stage`` did.

    k_zero is one more than the largest count; k_match the smallest k for which
    at most ``one_stage`` negatives have k inliers or more.
    """
    freq = counts.where(F.col(group).isNotNull() & F.col(inliers).isNotNull()).groupBy(group, inliers).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(group).orderBy(F.col(inliers).desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = freq.withColumn("__above", F.sum("__n").over(over))
    return cum.groupBy(group).agg((F.max(inliers) + 1).alias("k_zero"), F.coalesce(F.max(F.when(F.col("__above") > one_stage, F.col(inliers))) + 1, F.lit(0)).alias("k_match"))


def keep_alternate(names: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, calibration): sources in sorted order, the first, third, ... being the calibration half. Nulls are left out.

    The order runs over range partitions.
    """
    d = names.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__one", F.lit(1))
    return running_total(d, [], [F.col(key)], "__one", "__rn").select(key, (F.col("__rn") % 2 == 1).alias("calibration"))
