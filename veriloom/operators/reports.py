"""Second stages, report tables and their parts."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.sources import manifest
from veriloom.plans.session import workspace


def second_stage(top: DataFrame, queries: DataFrame, refs: DataFrame, inliers: Column) -> DataFrame:
    """``top`` (query_id, ref_id, ...) with ``inliers`` of its two sides, the largest over their variants; 0 where a side has no data."""
    keys = top.columns
    joined = top.join(queries, "query_id", "left").join(refs, "ref_id", "left")
    return joined.groupBy(*keys).agg(F.coalesce(F.max(inliers), F.lit(0)).cast("int").alias("inliers"))


def merge_values(spaces: dict[str, DataFrame]) -> DataFrame:
    """(key, value, n_values): the (name, value) rows of several namespaces as ``space.name``; the largest value counts where they differ. Null names are left out."""
    out = None
    for space, df in spaces.items():
        part = df.where(F.col("name").isNotNull()).select(F.concat(F.lit(f"{space}."), "name").alias("key"), "value").distinct()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n_values"))


def plane_digests(frames: DataFrame, key: str, values: str, planes: int) -> DataFrame:
    """(key, plane, digest): MD5 of each plane's values, planes being equal parts of the list. A null list has no rows."""
    size = F.floor(F.size(values) / planes).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(planes - 1)), lambda p: F.md5(F.array_join(F.transform(F.slice(values, p * size + 1, size), lambda x: x.cast("string")), ",")))
    return frames.where(F.col(values).isNotNull()).select(key, F.posexplode(parts).alias("plane", "digest"))


def picks(rows: DataFrame, group: str, owner: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, at most one of each owner, with their ``place`` from 1."""
    one = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group, owner).orderBy(*order))).where(F.col("__r") == 1).drop("__r")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= n)


def winners(configs: DataFrame, key: str, prizes: dict[str, Column]) -> DataFrame:
    """(prize, key): the configuration with the smallest value of each prize, ties by name; null values do not win."""
    best = configs.agg(*[F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(key).alias("k")))).alias(p) for p, v in prizes.items()])
    return best.select(F.explode(F.array(*[F.struct(F.lit(p).alias("prize"), F.col(p)["k"].alias(key)) for p in prizes])).alias("w")).select("w.*")


def fixed_threshold_bootstrap(rows: DataFrame, group: str, source: str, positive: str, hit: str, draws: int = 2000, alpha: float = 0.05) -> DataFrame:
    """(group, n_sources, tpr, tpr_lo, tpr_hi, false_binds, n_negatives, false_bound) at thresholds that draws do not change.

    Rows are summed by source in Spark; each draw takes as many sources as there
    are, with repetition. false_bound is the exact one-sided bound on the share
    of false bindings. Null groups, sources and sides take no part.
    """
    fine = rows.where(F.col(group).isNotNull() & F.col(source).isNotNull() & F.col(positive).isNotNull())
    one = lambda c: F.sum(c.cast("bigint"))
    per = fine.groupBy(group, source).agg(one(F.col(positive)).alias("n"), one(F.col(positive) & F.col(hit)).alias("k"), one(~F.col(positive)).alias("m"), one(~F.col(positive) & F.col(hit)).alias("f"))
    # What a draw needs of a source is its two counts, and equal ones are one row: as many rows as there are pairs of counts.
    shape = per.groupBy(group, "n", "k").agg(F.count(F.lit(1)).alias("sources"), F.sum("m").alias("m"), F.sum("f").alias("f"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k"])
        w, n, k = (pdf[c].to_numpy(dtype=np.float64) for c in ("sources", "n", "k"))
        rng = stats.rng_for("verification", key[0])
        drawn = rng.multinomial(int(w.sum()), w / w.sum(), size=draws)
        rate = (drawn @ k) / np.maximum(1, drawn @ n)
        lo, hi = np.quantile(rate, [alpha / 2, 1 - alpha / 2])
        false, neg = int(pdf["f"].sum()), int(pdf["m"].sum())
        bound = stats.upper_bound(false, neg) if neg else None
        return pd.DataFrame([[key[0], int(w.sum()), float((w * k).sum() / max(1, (w * n).sum())), lo, hi, false, neg, bound]], columns=["g", "n_sources", "tpr", "tpr_lo", "tpr_hi", "false_binds", "n_negatives", "false_bound"])

    return shape.groupBy(group).applyInPandas(run, "g string, n_sources bigint, tpr double, tpr_lo double, tpr_hi double, false_binds bigint, n_negatives bigint, false_bound double").withColumnRenamed("g", group)


def round_trip(items: DataFrame, sets: DataFrame) -> DataFrame:
    """(what, n): rows of two tables after they were written as records and read back, and 1 under ``stale`` if either differs."""
    spark = items.sparkSession
    base = f"{workspace(spark)}/records-{uuid.uuid4().hex[:10]}"
    back = []
    for name, df in (("items", items), ("sets", sets)):
        manifest.write_records(df, f"{base}/{name}")
        back.append(manifest.read_records(spark, f"{base}/{name}", df.schema))
    old = any(manifest.stale(b, df) for b, df in zip(back, (items, sets), strict=True))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
    return count("items", back[0]).unionByName(count("sets", back[1])).unionByName(spark.range(1).select(F.lit("stale").alias("what"), F.lit(int(old)).cast("bigint").alias("n")))
