"""Manifests, descriptor tables, record files and locks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "url", "licence", "sha256")])
MANIFEST = T.MapType(T.StringType(), T.StructType([T.StructField("sets", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("items", T.MapType(T.StringType(), ITEM))]))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items (modality, item_id, path, url, licence, sha256) and membership (modality, set_name, item_id, ord) of a corpus manifest in JSON."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MANIFEST)).alias("modality", "m"))
    items = m.select("modality", F.explode("m.items").alias("item_id", "i")).select("modality", "item_id", "i.*")
    sets = m.select("modality", F.explode("m.sets").alias("set_name", "ids")).select("modality", "set_name", F.posexplode("ids").alias("ord", "item_id"))
    return items, sets


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON records, one a line or one a file, plain or gzip by their extension.

    A file whose first line that is not blank is a whole JSON value holds records
    by line, any other file is one record or one list of records. In a file by
    line, a line that is no JSON gives a row of nulls.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    probe = T.StructType([T.StructField("x", T.StringType()), T.StructField("bad", T.StringType())])
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start").where((F.col("file_block_start") == 0) & (F.trim("value") != ""))
    first = lines.withColumn("n", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "n").alias("value"))
    whole = F.from_json(F.concat(F.lit('{"x":'), "value", F.lit("}")), probe, {"columnNameOfCorruptRecord": "bad"})
    kinds = first.select("file_path", whole["bad"].isNull().alias("by_line")).collect()  # one row a file
    parts = []
    for by_line in (True, False):
        files = sorted(r["file_path"] for r in kinds if r["by_line"] == by_line)
        if files:
            parts.append(spark.read.schema(schema).option("multiLine", not by_line).json(files))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header, plain or gzip."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, sha256) of files, for decoders that run in Arrow functions."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def register_set(membership: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``membership`` with the items ``ids`` as one more set, columns that they lack being null."""
    return membership.unionByName(ids.select("item_id").distinct().withColumn("set_name", F.lit(name)), allowMissingColumns=True)


def verify(files: DataFrame, lock: DataFrame, key: str, digest: str, strict: bool = False) -> DataFrame:
    """``files`` with ``status`` against ``lock`` (key, locked): equal, spelling (same digits), missing or differs.

    With ``strict``, reading a row that differs fails.
    """
    plain = F.nullif(F.regexp_extract(F.lower(F.col(digest)), "([0-9a-f]{64})", 1), F.lit(""))
    status = F.when(F.col(digest).isNull(), "missing").when(F.col(digest) == F.col("locked"), "equal").when(plain == F.col("locked"), "spelling").otherwise("differs")
    out = files.join(lock, key, "left").withColumn("status", status)
    if strict:
        out = out.withColumn("status", F.when(F.col("status") == "differs", F.raise_error(F.concat(F.lit("digest differs: "), F.col(key)))).otherwise(F.col("status")))
    return out


def write_descriptors(df: DataFrame, path: str) -> None:
    """A descriptor table, partitioned by method and set so that scans prune both."""
    df.write.mode("overwrite").partitionBy("method", "set_name").parquet(path)


def read_descriptors(spark: SparkSession, path: str, method: str | None = None, sets: tuple[str, ...] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    if method:
        df = df.where(F.col("method") == method)
    return df.where(F.col("set_name").isin(*sets)) if sets else df


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines with sorted columns; a reader sees the old folder or the complete new one."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def stale(stored: DataFrame, fresh: DataFrame) -> bool:
    """Whether a regenerated table differs from the stored one, as bags of rows."""
    cols = sorted(stored.columns)
    if cols != sorted(fresh.columns):
        return True
    a, b = stored.select(*cols), fresh.select(*cols)
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()


def read_tar_lines(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, line_no, line) of the text lines of the members of tar archives, plain or gzip, whose names end in ``suffix``.

    One archive is read by one task, line by line.
    """
    def run(frames):  # noqa: ANN001, ANN202
        import gzip
        import io
        import tarfile

        import pandas as pd

        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if not m.isfile() or not m.name.removesuffix(".gz").endswith(suffix):
                            continue
                        f = tar.extractfile(m)
                        f = gzip.open(f) if m.name.endswith(".gz") else f
                        lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in f]
                        yield pd.DataFrame({"archive": name, "member": m.name, "line_no": range(len(lines)), "line": lines})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, line_no int, line string")


def write_evidence(positives: DataFrame, negatives: DataFrame, path: str) -> None:
    """Per-query evidence as two Parquet tables, pos and neg, partitioned by method."""
    for name, df in (("pos", positives), ("neg", negatives)):
        df.write.mode("overwrite").partitionBy("method").parquet(f"{path}/{name}")
