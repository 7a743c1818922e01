"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriloom.plans.session import stage


def running_total(df: DataFrame, groups: list[str], order: list[Column], weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same ``groups`` up to and including the row, in ``order``.

    The rows are range-partitioned by (groups, order), so no task holds a whole
    group, however large; totals per partition give each partition its start.
    ``order`` must be a total order within a group, else ties get any order.
    A null weight counts as 0. Empty input gives empty output. Columns are kept;
    the names ``__part`` and ``__before`` are reserved.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = F.coalesce(F.col(weight), F.lit(0))
    ranged = df.repartitionByRange(n, *[F.col(g) for g in groups], *order).withColumn("__part", F.spark_partition_id())
    fixed = stage(ranged, "ranged")
    totals = fixed.groupBy(*groups, "__part").agg(F.sum(w).alias("__sum"))
    # One row per partition and group in it: a group's rows are at most as many as the partitions it spans.
    over = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "__part", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in groups]
    cond = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        cond = cond & k
    joined = fixed.alias("a").join(starts.alias("b"), cond, "left").select("a.*", "b.__before")
    within = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum(w).over(within) + F.col("__before")).drop("__part", "__before")
