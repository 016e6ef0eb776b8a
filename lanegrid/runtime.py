"""Session defaults, table access and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lanegrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LANEGRID_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it comes from files in fewer splits with rows than there are cores.

    Inputs that fill all cores with splits of the usual size stay as they are, at no cost.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * split:
        return df
    splits = df.select(F.input_file_name(), F.input_file_block_start()).distinct().count()
    return df.repartition(cores) if splits < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors reach.

    Where none is set, a session in one JVM gets a temporary one; a cluster must name a shared folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = checkpoint.get() if checkpoint.isDefined() else ""
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lanegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000


def small_enough(df: DataFrame, row_bytes: Column) -> bool:
    """Whether ``df`` has few enough rows and bytes to be sent to every executor."""
    rows, size = df.agg(F.count("*"), F.sum(row_bytes)).collect()[0]
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends at most ``rows`` rows at once to Python workers, so that long texts fit their memory; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = int(spark.conf.get(name))
    if set_to <= 0 or set_to > rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Tables written in the shared folder to cut lineage.

    A written table survives the loss of executors and is computed once. ``drop`` removes a
    table that nothing lazy reads any more; what is left goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/lanegrid-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
