"""Optional online paths: windowed rates and lookups over unbounded input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.plans.session import workspace


def windowed_rate(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n, errors): events and errors in each window; windows close ``late`` after their end."""
    e = events.withWatermark("ts", late)
    return e.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors")).select(F.col("window.start").alias("start"), "n", "errors")


def lookup(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """Streamed codes (query_id, code) joined with the registry (code, item_id) on equal codes; a code without item has null."""
    return queries.join(registry, "code", "left")


def run_windows(spark: SparkSession, path: str) -> DataFrame:
    """``windowed_rate`` over the rows of a Parquet table, read as a stream until its present end: every window, the one still open too.

    Each batch writes the windows that it changed to the shared folder, under the
    batch's number, so a repeated batch replaces itself; the last state counts.
    """
    schema = spark.read.parquet(path).schema
    out = f"{workspace(spark)}/stream-{uuid.uuid4().hex[:10]}"
    # The source is a folder: one that holds the table, whether that is a file or a folder itself.
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_folder(spark, path) else "*.parquet").parquet(folder if not _is_folder(spark, path) else path)
    stream = source.withColumn("ts", F.col("ts").cast("timestamp"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = windowed_rate(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.schema("start timestamp, n bigint, errors bigint, batch bigint").parquet(out)
    return states.groupBy("start").agg(F.max_by("n", "batch").alias("n"), F.max_by("errors", "batch").alias("errors"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
