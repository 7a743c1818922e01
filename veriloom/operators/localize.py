"""Localisation of edits, excerpts and inserted intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriloom.operators import calibrate
from veriloom.plans.prefix import running_total


def midrank_cdf(values: DataFrame, reference: DataFrame, group: str, value: str) -> DataFrame:
    """``values`` with ``cdf``: (number of reference values below + number not above) / (2 n), per group.

    Both sides are compacted to distinct values and summed over range partitions;
    a group without reference has a null cdf. Null values are left out.
    """
    ref = reference.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    own = values.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("__v")).distinct().withColumn("__n", F.lit(0).cast("bigint"))
    merged = ref.unionByName(own).groupBy(group, "__v").agg(F.sum("__n").alias("__n"))
    cum = running_total(merged, [group], [F.col("__v")], "__n", "__upto")
    total = ref.groupBy(group).agg(F.sum("__n").alias("__all"))
    table = cum.join(total, group).select(group, "__v", ((2 * F.col("__upto") - F.col("__n")) / (2 * F.col("__all"))).alias("cdf"))
    v = values.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    return v.join(table, [group, "__v"], "left").drop("__v")


def mask_scores(pixels: DataFrame, group: list[str], score: str, truth: str, threshold: float) -> DataFrame:
    """(group, f1, iou, n) of the mask score > threshold against the truth; denominators are 1 at least."""
    hit, real = (F.col(score) > threshold).cast("int"), F.col(truth).cast("int")
    c = pixels.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*group).agg(F.sum(hit * real).alias("tp"), F.sum(hit * (1 - real)).alias("fp"), F.sum((1 - hit) * real).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*group, (2.0 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn)).alias("f1"), (1.0 * tp / F.greatest(F.lit(1), tp + fp + fn)).alias("iou"), "n")


def _compact(pixels: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """Distinct scores of a group with their true and false counts."""
    return pixels.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*group, F.col(score).alias("__s")).agg(F.sum(F.col(truth).cast("bigint")).alias("__p"), F.sum(1 - F.col(truth).cast("bigint")).alias("__q"))


def best_f1(pixels: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """(group, best_f1): the largest F1 over all cuts between distinct scores; 0 without a true value."""
    c = _compact(pixels, group, score, truth).withColumn("__n", F.col("__p") + F.col("__q"))
    order = [F.col("__s").desc()]
    c = running_total(c, group, order, "__p", "__tp")
    c = running_total(c, group, order, "__n", "__taken")
    real = _compact(pixels, group, score, truth).groupBy(*group).agg(F.sum("__p").alias("__real"))
    joined = c.join(real, group) if group else c.crossJoin(real)  # without groups, one row
    return joined.groupBy(*group).agg(F.max(2.0 * F.col("__tp") / F.greatest(F.lit(1), F.col("__taken") + F.col("__real"))).alias("best_f1"))


def roc_auc(pixels: DataFrame, group: list[str], score: str, truth: str) -> DataFrame:
    """(group, auc): area under the ROC curve, ties counting half; null with one class only."""
    c = running_total(_compact(pixels, group, score, truth), group, [F.col("__s")], "__q", "__below")
    pairs = F.sum(F.col("__p") * (F.col("__below") - F.col("__q") / 2.0))
    p, q = F.sum("__p"), F.sum("__q")
    return c.groupBy(*group).agg(F.when((p > 0) & (q > 0), pairs / (p.cast("double") * q)).alias("auc"))


def longest_run(rows: DataFrame, group: str, order: list[str], flag: str) -> DataFrame:
    """(group, start, end): the first longest run of true flags as a half-open range of positions from 0; groups without one have no row.

    A null flag counts as false.
    """
    by = Window.partitionBy(group).orderBy(*order)
    r = rows.select(group, *order, F.coalesce(flag, F.lit(False)).alias("__f")).withColumn("__i", F.row_number().over(by) - 1)
    r = r.where("__f").withColumn("__island", F.col("__i") - F.row_number().over(Window.partitionBy(group).orderBy("__i")))
    runs = r.groupBy(group, "__island").agg(F.min("__i").alias("start"), F.count(F.lit(1)).alias("n"))
    return runs.groupBy(group).agg(F.min_by(F.struct("start", "n"), F.struct((-F.col("n")).alias("n"), "start")).alias("b")).select(group, F.col("b.start").cast("bigint").alias("start"), (F.col("b.start") + F.col("b.n")).cast("bigint").alias("end"))


def diagonal_offset(pairs: DataFrame, group: str, q: str, r: str, sim: str) -> DataFrame:
    """(group, offset, mean_sim, overlap): the offset r - q with the largest mean similarity.

    Offsets need an overlap of max(2, third of the query's positions); of equal
    means the smallest offset wins.
    """
    size = pairs.groupBy(group).agg(F.countDistinct(q).alias("__nq"))
    d = pairs.groupBy(group, (F.col(r) - F.col(q)).alias("offset")).agg(F.round(F.avg(sim), 9).alias("mean_sim"), F.count(F.lit(1)).alias("overlap"))
    d = d.join(size, group).where(F.col("overlap") >= F.greatest(F.lit(2), F.floor(F.col("__nq") / 3)))
    best = Window.partitionBy(group).orderBy(F.col("mean_sim").desc(), "offset")
    return d.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == 1).select(group, "offset", "mean_sim", "overlap")


def interval_iou(rows: DataFrame, start: str, end: str, lo: float, hi: float) -> DataFrame:
    """``rows`` with ``iou``: overlap of [start, end] with [lo, hi] over their union; 0 where they do not meet or an end is null."""
    inter = F.greatest(F.lit(0.0), F.least(F.col(end), F.lit(hi)) - F.greatest(F.col(start), F.lit(lo)))
    union = (F.col(end) - F.col(start)) + (hi - lo) - inter
    return rows.withColumn("iou", F.when(F.col(start).isNotNull() & F.col(end).isNotNull() & (union > 0), inter / union).otherwise(0.0))


def hash_sample(rows: DataFrame, group: list[str], key: str, n: int, salt: str) -> DataFrame:
    """At most ``n`` rows of each group, the first ones by the MD5 of salt and key."""
    order = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws(":", F.lit(salt), F.col(key).cast("string"))), F.col(key))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def error_summary(rows: DataFrame, group: list[str], error: str) -> DataFrame:
    """(group, median_error, within_half, within_1, within_2, n) of absolute errors; nulls count as outside."""
    e = F.abs(F.col(error))
    inside = lambda c: F.avg(F.coalesce((e <= c).cast("int"), F.lit(0)))
    middle = calibrate.quantiles(rows.select(*group, e.alias("__e")), group, "__e", {"median_error": 0.5})
    shares = rows.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(inside(0.5).alias("within_half"), inside(1.0).alias("within_1"), inside(2.0).alias("within_2"), F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return shares.join(middle.drop("n"), same, "left").select(*[F.col(f"_{g}").alias(g) for g in group], "median_error", "within_half", "within_1", "within_2", "n")


def token_difference(pairs: DataFrame, key: str, a: str, b: str, around: int = 2) -> DataFrame:
    """(key, pos, differs, score): tokens of two texts that differ at a position, and the mean over ``around`` positions on either side.

    The longer text decides how many positions there are; a missing token differs.
    """
    words = lambda c: F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), r"\s+"), lambda x: x != "")
    t = pairs.where(F.col(key).isNotNull()).select(key, F.posexplode(F.zip_with(words(a), words(b), lambda x, y: F.coalesce((x != y).cast("int"), F.lit(1)))).alias("pos", "differs"))
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)
    return t.withColumn("score", F.avg("differs").over(near))
