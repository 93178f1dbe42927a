"""Local sessions for tests and benches, and scratch tables; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch between Spark and a kernel while a scratch table is written.
BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512

#: Options of a table's write. Where no native Hadoop library is there, a local folder has permissions set by a process for each file, which
#: shares the executor's memory until it runs; with checksums of its own beside Parquet's there are four for each. Other folders aren't concerned.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession | None = None) -> None:
    """Lets Python workers on this machine import the package, wherever the driver was started. On a cluster it is installed or shipped."""
    environment = (spark or SparkSession.active()).sparkContext.environment
    root, known = str(Path(__file__).resolve().parents[1]), environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def spread(df: DataFrame, per_core: int = 32 << 20) -> DataFrame:
    """The rows of a small input dealt out over all cores. Files are split by row groups, so a small one would be a single task
    however costly its rows are; an input of more than ``per_core`` bytes a core stays as it is, and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * per_core else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints"


def folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a table in the shared folder. All of an application's are deleted when its driver ends."""
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path, files = folder(spark, top)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    # a batch may have 64 MB otherwise, several of which a worker would hold; a smaller setting of the caller's stays
    rows = spark.conf.get(BATCH_ROWS, None)
    try:
        if rows is None or int(rows) > ROWS:
            spark.conf.set(BATCH_ROWS, str(ROWS))
        df.write.options(**PLAIN).option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(BATCH_ROWS) if rows is None else spark.conf.set(BATCH_ROWS, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out
