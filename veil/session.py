"""Session defaults. A cluster's own settings always win; these only fill gaps."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "veil", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Rows of processor-heavy work that one task takes, about.
HEAVY_ROWS = 50_000


def spread(df):
    """Give a scan tasks of few and equally many rows before processor-heavy work.

    Short rows shrink in their files, and a row group is never split: a table of few megabytes can hold millions of rows, in as few
    tasks as it has row groups. So the rows are counted, which reads no column. A scan of four splits a core or more is never moved.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= 4 * cores:
        return df
    wanted = max(cores, -(-df.count() // HEAVY_ROWS))
    return df.repartition(wanted) if splits < wanted else df


_OWN_FOLDER: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. A session inside one process may go without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="veil-checkpoint-"))
    return _OWN_FOLDER[0]


def cut_lineage(df, eager: bool = True):
    """Write ``df`` to the shared checkpoint folder and read it back from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=eager)
