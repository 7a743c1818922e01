"""Cutoffs that keep a target share of each source's records.

Scores are compacted to distinct values with their frequencies, descending
cumulative sums run over these frequencies, and the cutoff is read off where
the sum crosses the target. The sums run over range partitions
(``veriloom.plans.prefix``), so a source that holds most of the records, or as
many distinct scores as records, is still spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.plans.prefix import running_total


def score_frequencies(records: DataFrame, source: str, score: str) -> DataFrame:
    """(source, score, n): distinct scores of each source. Null sources or scores, and non-finite scores, are left out."""
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf")))
    return (
        records.where(F.col(source).isNotNull() & finite)
        .groupBy(F.col(source).alias("source"), (s + F.lit(0.0)).alias("score"))  # -0.0 and 0.0 are one score
        .agg(F.count(F.lit(1)).alias("n"))
    )


def share_cutoffs(records: DataFrame, targets: DataFrame, source: str = "source", score: str = "score", pct: str = "target_pct") -> DataFrame:
    """The cutoff of each source of ``targets``: (source, target_pct, cutoff, kept, total).

    The cutoff is the highest score at which the records scoring at least that
    much make up at least ``pct`` per cent of the source's records; all records
    at the cutoff are kept, so ties never split. A share of 0 or less keeps the
    records at the highest score; one above 100 has no cutoff. A source without
    records has null cutoff and 0 kept of 0; a source without target is not
    reported. A source given twice in ``targets`` counts once, with its largest
    share; null sources and shares are ignored.
    """
    goal = targets.where(F.col(source).isNotNull() & F.col(pct).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.max(pct).cast("double").alias("target_pct"))
    freq = score_frequencies(records, source, score)
    cum = running_total(freq, ["source"], [F.col("score").desc()], "n", "kept")
    totals = cum.groupBy("source").agg(F.sum("n").alias("total"))
    crossed = cum.join(totals, "source").join(goal, "source").where(F.col("kept") * 100.0 >= F.col("target_pct") * F.col("total"))
    best = crossed.groupBy("source").agg(F.max("score").alias("cutoff"), F.min("kept").alias("kept"))
    return (
        goal.join(totals, "source", "left")
        .join(best, "source", "left")
        .select("source", "target_pct", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))
    )


def keep_share(records: DataFrame, targets: DataFrame, source: str = "source", score: str = "score", pct: str = "target_pct") -> DataFrame:
    """The rows of ``records`` that score at least the cutoff of their source. Columns are those of ``records``."""
    cuts = share_cutoffs(records, targets, source, score, pct).where(F.col("cutoff").isNotNull()).select(F.col("source").alias("__source"), F.col("cutoff").alias("__cutoff"))
    s = F.col(score).cast("double")
    return records.join(cuts, F.col(source) == F.col("__source")).where((s >= F.col("__cutoff")) & ~F.isnan(s) & (s < F.lit(float("inf")))).drop("__source", "__cutoff")


def calibration_records(perquery: DataFrame, thresholds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (method, rec_id, score) and targets (method, target_pct) of the calibration tables.

    Method names that differ only in case or outer blanks are one, written as in
    ``thresholds``. A record is a distinct rec_id with ``cal`` true and a finite
    score; its score is the largest finite one of its rows.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    names = thresholds.where(F.col("method").isNotNull()).groupBy(key(F.col("method")).alias("__key")).agg(F.min("method").alias("method"), F.max("target_pct").alias("target_pct"))
    finite = F.filter("scores", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        perquery.where(F.col("cal") & F.col("rec_id").isNotNull() & F.col("method").isNotNull())
        .select("rec_id", key(F.col("method")).alias("__key"), F.array_max(finite).cast("double").alias("score"))
        .where(F.col("score").isNotNull())
        .groupBy("rec_id")
        .agg(F.min("__key").alias("__key"), F.max("score").alias("score"))
    )
    return rows.join(names.select("__key", "method"), "__key").select("method", "rec_id", "score"), names.select("method", "target_pct")
