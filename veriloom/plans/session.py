"""Session settings, shared working folder and staged tables.

Operators that iterate, or whose input would otherwise be recomputed, cut the
lineage by writing Parquet to the folder named in ``spark.checkpoint.dir``.
That folder is shared by all executors of a cluster, so staged tables survive
the loss of any executor. Where the setting is absent, a local session uses a
folder of its own, and any other one is refused: its executors would write to
their own disks and rows would go missing.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}

_folders: dict[str, str] = {}


def build_session(cpus: int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and ``bench.py`` use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("veriloom")
    for k, v in {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def workspace(spark: SparkSession) -> str:
    """The folder for this application's staged tables, removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or tempfile.mkdtemp(prefix="veriloom-")
        _folders[app] = f"{base.rstrip('/')}/veriloom-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, _folders[app])
    return _folders[app]


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it.

    The result has no lineage: what follows is not recomputed from ``df``, and
    non-deterministic partitioning inside ``df`` is fixed once. An empty input
    gives an empty table with the same schema.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its input has at most half as many.

    For costly work on each row. A table of many files comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def drop(df: DataFrame) -> None:
    """Delete the table that ``stage`` made for ``df``; other staged tables stay."""
    spark = df.sparkSession
    base = _folders.get(spark.sparkContext.applicationId)
    for f in df.inputFiles() if base else []:
        folder = f.rsplit("/", 1)[0]
        if folder.split("://")[-1].split(":", 1)[-1].startswith(base.split("://")[-1].split(":", 1)[-1]):
            _delete(spark, folder)
            return


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application."""
    app = spark.sparkContext.applicationId
    if app in _folders:
        _delete(spark, _folders.pop(app))
