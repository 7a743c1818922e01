"""Expansion of sources into queries, balanced designs and selection of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.plans.prefix import running_total


def expand(sources: DataFrame, attacks: DataFrame, key: str) -> DataFrame:
    """``sources`` under each of ``attacks`` (attack, ord): query_id is ``key|attack``; the attacks are a fixed ladder."""
    return sources.crossJoin(F.broadcast(attacks)).withColumn("query_id", F.concat_ws("|", F.col(key).cast("string"), "attack"))


def hash_order(c: Column, salt: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(salt), c.cast("string")))


def positions(rows: DataFrame, key: str, salt: str, name: str = "position") -> DataFrame:
    """Distinct non-null keys with their position from 0 in the hash order of ``salt``, over range partitions."""
    k = rows.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__one", F.lit(1)).withColumn("__h", hash_order(F.col(key), salt))
    return running_total(k, [], [F.col("__h"), F.col(key)], "__one", "__rn").select(key, (F.col("__rn") - 1).alias(name))


def balanced_design(sources: DataFrame, key: str, levels: dict[str, list], per_source: int, salt: str) -> DataFrame:
    """Each source with ``per_source`` cells of a factorial grid, the counts of whose cells differ by at most one.

    The grid is ordered by hash and the sources cycle through it.
    """
    spark = sources.sparkSession
    grid = spark.range(1).select(F.lit(0).alias("__z"))
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    size = 1
    for values in levels.values():
        size *= len(values)
    cell = F.concat_ws("|", *[F.col(n).cast("string") for n in levels])
    # The grid has as many rows as the product of its levels.
    grid = grid.withColumn("cell", (F.row_number().over(Window.partitionBy("__z").orderBy(hash_order(cell, salt))) - 1).cast("bigint")).drop("__z")
    s = positions(sources, key, salt).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1))))
    return s.withColumn("cell", F.pmod(F.col("position") * per_source + F.col("j"), F.lit(size))).join(F.broadcast(grid), "cell").select(key, "j", *levels)


def collision_pairs(n: int, m: int, count: int, spark) -> DataFrame:  # noqa: ANN001
    """(j, source, target): pairs j mod n and (7 j + 3) mod m of positions."""
    j = F.col("id")
    return spark.range(count).select(j.alias("j"), (j % n).alias("source"), ((7 * j + 3) % m).alias("target"))


def rank_split(keys: DataFrame, key: str, shares: list[tuple[str, float]], salt: str) -> DataFrame:
    """Distinct keys with ``split``: consecutive ranges of the hash order with the given shares; the last takes the rest."""
    p = positions(keys, key, salt)
    n = p.count()
    name, upto = None, 0.0
    for split, share in shares[:-1]:
        upto += share
        edge = F.col("position") < F.lit(round(upto * n))
        name = F.when(edge, F.lit(split)) if name is None else name.when(edge, F.lit(split))
    last = F.lit(shares[-1][0])
    return p.select(key, (last if name is None else name.otherwise(last)).alias("split"))


def failing_everywhere(rows: DataFrame, item: str, config: str, failed: Column) -> DataFrame:
    """Items that fail in every configuration of ``rows``: (item)."""
    n = rows.where(F.col(config).isNotNull()).agg(F.countDistinct(config).alias("__all"))  # one row
    bad = rows.where(failed & F.col(item).isNotNull()).groupBy(item).agg(F.countDistinct(config).alias("__bad"))
    return bad.crossJoin(n).where(F.col("__bad") == F.col("__all")).select(item)


def unique_owner(rows: DataFrame, asset: str, owner: str) -> DataFrame:
    """Assets with exactly one distinct owner: (asset, owner)."""
    return rows.where(F.col(asset).isNotNull()).groupBy(asset).agg(F.countDistinct(owner).alias("__n"), F.min(owner).alias(owner)).where(F.col("__n") == 1).drop("__n")


def first_of(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group in ``order``; rows of a null group are dropped."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.where(F.col(group).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def open_licence(c: Column) -> Column:
    """Whether a licence text allows reuse: names an open licence and no restriction. Null gives false."""
    t = F.lower(c)
    return F.coalesce(t.rlike(r"cc0|cc[ -]?by|public domain|mit|bsd|apache") & ~t.rlike(r"\bnc\b|\bnd\b|noncommercial|no ?deriv|research only"), F.lit(False))


def frame_samples(rows: DataFrame, clip: str, t: str, fps: float) -> DataFrame:
    """(clip, k, t): of each clip the first time of at least (k + 0.5) / fps after its start, for each bucket k that has one."""
    start = rows.where(F.col(t).isNotNull()).groupBy(clip).agg(F.min(t).alias("__t0"))
    s = rows.where(F.col(t).isNotNull()).join(start, clip).withColumn("__s", F.col(t) - F.col("__t0"))
    # A time s can be the first of bucket k only if k is the largest with (k + 0.5) / fps <= s.
    s = s.withColumn("k", F.floor(F.col("__s") * fps - 0.5)).where(F.col("k") >= 0)
    return s.groupBy(clip, "k").agg(F.min("__s").alias("t"))
