"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recallgrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


#: Rows that Spark hands to Python at once, by its default and for tables with whole texts.
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers started on this machine import this package, and keeps their batches small.

    A cluster ships the package with ``--py-files`` instead; an entry that is already there is left alone. A batch of
    Spark's default size holds tens of megabytes of text in the executor and again in its worker, so a tenth of it is
    taken unless the session sets another size.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep) and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)
    return spark


#: Bytes that Spark hands to Python at once, by its default and where single rows have megabytes.
DEFAULT_BYTES, BLOCK_BYTES = "67108864b", "8m"


def few_blocks(spark: SparkSession) -> None:
    """From now on the session hands a few rows of megabytes to Python at once, unless it sets another size: Spark's default
    takes several times its size outside of an executor's heap."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BLOCK_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir in storage that all its machines reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the session has cores, dealt out to all of them before costly work; any other plan,
    and every large table, as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)
