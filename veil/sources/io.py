"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.operators.quality import verdicts
from veil.operators.telemetry import keep_latest
from veil.sources import schemas


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S1."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One row per page with nested boxes and elements."""
    return spark.read.schema(schemas.GROUND_TRUTH).json(path)


def truth_boxes(truth: DataFrame) -> DataFrame:
    """One row per truth box with its position in the list; pages without boxes vanish."""
    return truth.select("page_id", "split", F.posexplode("boxes").alias("seq", "_b")).select(
        "page_id", "split", "seq", "_b.category", F.col("_b.token").alias("text"), "_b.x", "_b.y", "_b.w", "_b.h")


def truth_elements(truth: DataFrame) -> DataFrame:
    return truth.select("page_id", "split", F.posexplode("elements").alias("seq", "_e")).select(
        "page_id", "split", "seq", "_e.role", "_e.name", "_e.x", "_e.y", "_e.w", "_e.h", "_e.is_sensitive")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system the path belongs to (local, HDFS, object store)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf).exists(target)


def read_telemetry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: the first source that exists; unreadable records stay visible in ``_corrupt``; no source is no rows."""
    schema = schemas.TELEMETRY + ", _corrupt string"
    for path in paths:
        if path_exists(spark, path):
            return spark.read.schema(schema).option("mode", "PERMISSIVE").option(
                "columnNameOfCorruptRecord", "_corrupt").json(path)
    return spark.createDataFrame([], schema)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.schema(schemas.RUNS).option("multiLine", True).json(path)


def write_run(df: DataFrame, root: str, run_id: str) -> str:
    """A run is written once; an existing one is never touched."""
    path = f"{root}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_scorecard(metrics: DataFrame, path: str) -> str:
    """Metric rows with target and verdict."""
    verdicts(metrics).write.mode("errorifexists").json(path)
    return path


def append_audit(events: DataFrame, path: str) -> str:
    """Append only; retention is a view (:func:`read_audit`), so no writer rewrites another's files."""
    events.write.mode("append").parquet(path)
    return path


def read_audit(spark: SparkSession, path: str, keep: int = 500) -> DataFrame:
    """Newest ``keep`` audit rows."""
    return keep_latest(spark.read.parquet(path), [], keep, ["ts", "event_id"])
