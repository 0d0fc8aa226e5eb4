"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veil.session import checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# A batch waits in the executor's JVM and in the worker, once for each task: 10,000 long texts, the default, take tens of megabytes each.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python of few megabytes, unless the session names a size."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id bigint, text`` of ``df``; other columns cannot clash with what an operator adds.

    Columns that already fit stay as they are, without an alias, so that Spark sees two uses of the result as equal and
    writes an exchange that both need once.
    """
    out = df.select(F.col(id_col), F.col(text_col))
    if out.columns != ["doc_id", "text"]:
        out = out.toDF("doc_id", "text")
    return out if out.schema["doc_id"].dataType == LongType() else out.withColumn("doc_id", F.col("doc_id").cast("long"))


def utf8(col: Column) -> Column:
    """Text as bytes, so that Python reads it without decoding."""
    return col.cast("binary")
