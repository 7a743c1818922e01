"""The queries of this subpackage: name to (function of session and folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm import components, cutoffs, langid, leakage, overlap, packing, similar
from veriloom.llm.tables import table
from veriloom.plans.session import spread

Query = Callable[[SparkSession, str], DataFrame]


def _p1_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("items", "set_membership", "descriptors_bits", "descriptors_vec", "methods")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_found(*_p1_tables(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_p1_tables(spark, d))


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    records, targets = cutoffs.calibration_records(table(spark, d, "perquery_neg"), table(spark, d, "thresholds"))
    return cutoffs.share_cutoffs(records, targets, "method").withColumnRenamed("source", "method")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    records, targets = cutoffs.calibration_records(table(spark, d, "perquery_neg"), table(spark, d, "thresholds"))
    return cutoffs.keep_share(records, targets, "method").select("method", "rec_id")


#: Similarity that a pair of p3_found needs under each metric: a cosine, or a negated distance.
P3_LEAST = {"ip": 0.90, "l2": -1.5}

#: Index of p3_neighbours: the five nearest of every vector lie farther off than p3_found's pairs, so larger cells and longer walks.
P3_INDEX = {"probes": 128, "occupancy": 128}


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar others of every usable vector, however far."""
    spaces = similar.vector_spaces(table(spark, d, "methods"))
    return similar.most_similar(table(spark, d, "descriptors_vec"), spaces, 5, [float("-inf")] * len(spaces), **P3_INDEX).withColumn("sim", F.when(F.abs("sim") < 5e-6, 0.0).otherwise(F.round("sim", 5)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spaces = similar.vector_spaces(table(spark, d, "methods"))
    near = similar.most_similar(table(spark, d, "descriptors_vec"), spaces, 5, [P3_LEAST[s.metric] for s in spaces])
    return near.select("method", F.least("item_id", "other").alias("item_a"), F.greatest("item_id", "other").alias("item_b")).distinct()


def split_plan(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    """The rows of split_plan, of which there are as many as splits."""
    return [(r["split_name"], float(r["share_pct"])) for r in table(spark, d, "split_plan").select("split_name", "share_pct").collect() if r["split_name"] and r["share_pct"]]


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return components.edit_splits(table(spark, d, "edits"), table(spark, d, "config_items"), split_plan(spark, d)).select("edit_id", "split_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.edit_group_sources(table(spark, d, "edits"), table(spark, d, "config_items"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or its pieces, with its container."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    capacity = int(table(spark, d, "pack_sizes").select("capacity_tokens").first()[0])
    return packing.pack(docs.select("doc_id", packing.token_count(F.col("text")).alias("n_tokens")), capacity, rows=table(spark, d, "documents").count())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_packed(spark, d).where(F.col("piece_no") == 1).select("doc_id")


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents and tokens packed, and whether pieces are whole, in order and within capacity, and containers nearly as few as can be."""
    capacity = int(table(spark, d, "pack_sizes").select("capacity_tokens").first()[0])
    packed = p6_packed(spark, d)
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("doc_id").alias("docs"))
    fit = boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"), F.sum(F.when(F.col("pieces") > F.col("docs"), 1).otherwise(0)).alias("odd"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece_no").alias("last"), F.max(F.col("start_token") + F.col("n_tokens")).alias("upto"))
    whole = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.min(((F.col("pieces") == F.col("last") + 1) & (F.col("upto") == F.col("n")) & (F.col("pieces") == F.ceil(F.col("n") / capacity))).cast("int")).alias("ok"))
    least = F.ceil(F.col("tokens") / capacity)
    return fit.join(whole, F.col("tokens") == F.col("n_tokens")).select("n_docs", "n_tokens", (F.col("ok") == 1).alias("whole"), (F.col("fullest") <= capacity).alias("within"), (F.col("containers") <= least * 1.05 + 2).alias("nearly_full"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("max_share"))


def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the spans that stand in evaluation items."""
    return leakage.without_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every stretch of every document."""
    return langid.languages(spread(table(spark, d, "documents").select("doc_id", "text", "lang"))).drop("label")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = langid.languages(spread(table(spark, d, "documents").select("doc_id", "text", "lang")))
    return langid.relabelled(found, langid.Settings().reject).select("doc_id", "seg_no", "text_lang")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_cutoffs, p3_found, p3_neighbours, p5_found, p5_splits, p6_found, p6_packed, p6_balance, p7_found, p7_leaks, p7_items, p7_cleaned, p8_found, p8_languages)}
