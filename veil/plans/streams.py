"""Registered queries through Structured Streaming: the table is read as a stream to its end, and the sink's rows are returned.

A closing row, a long time after all others, moves the watermark past everything; it is left out of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.plans.registry import query
from veil.plans.runs import RATE
from veil.session import checkpoint_dir
from veil.streaming import streams


def _path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a stream, with the closing row (event_id -1)."""
    source = f"{sf.rstrip(chr(47))}/events.parquet"
    schema = spark.read.parquet(source).schema
    closing = _path(spark, "closing")
    last = spark.read.parquet(source).agg(F.max("ts").alias("ts")).select((F.coalesce("ts", F.lit("2000-01-01").cast("timestamp_ntz")) + F.expr("interval 400 days")).alias("ts"))
    row = last.select(*[{"event_id": F.lit(-1), "ts": F.col("ts")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.parquet(closing)
    both = [spark.readStream.schema(schema).parquet(p) for p in (f"{source}*", closing)]  # a stream reads folders and patterns, not one file
    return both[0].unionByName(both[1])


def _to_end(sdf: DataFrame, label: str) -> DataFrame:
    """Runs an append stream until its input is used up, into a table in the shared folder."""
    spark = sdf.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    out = _path(spark, label)
    try:
        running = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", _path(spark, "offsets")).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(sdf.schema).parquet(out)


@query("stream_rate_limit", RATE.replace("{key}", "user_id").replace("{shrink}", "100"))
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Z3 on the requests of ``rate_limit``."""
    r = _events(spark, sf).selectExpr("user_id AS key", "event_id AS id", "cast(floor(unix_micros(cast(ts as timestamp)) / 100000) as bigint) AS ts_ms")
    return _to_end(streams.rate_limit_stream(r, 2), "rate-limit").where("id >= 0").select("id", "window_start", "count_in_window", "allowed")


@query("stream_loops", """
WITH l AS (SELECT event_id, event_type AS t, lag(event_type, 1) OVER w AS l1, lag(event_type, 2) OVER w AS l2, lag(event_type, 3) OVER w AS l3, lag(event_type, 4) OVER w AS l4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN t = l1 AND t = l2 THEN 'repeat' WHEN t = l2 AND t = l4 AND l1 = l3 THEN 'alternate' END AS loop_kind FROM l""")
def stream_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Runs without an action for a year begin anew, so that none of the table's does."""
    a = _events(spark, sf).selectExpr("user_id AS run_id", "event_id AS step", "ts", "event_type AS kind", "cast(NULL as string) AS target")
    return _to_end(streams.loop_stream(a, idle_ms=365 * 86_400_000), "loops").where("step >= 0").selectExpr("step AS event_id", "loop_kind")


@query("stream_windows", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  count(*) FILTER (event_type = 'error') AS errors, 0::BIGINT AS late FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Z2 by the hour."""
    e = _events(spark, sf).selectExpr("ts", "coalesce(event_type, 'closing') AS event_type", "value")
    totals = streams.telemetry_totals(_to_end(streams.telemetry_stream(e, "1 hour"), "windows"))
    return totals.where("event_type <> 'closing'").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_quota", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS period, user_id AS tenant_id, count(*) AS requests, sum(cast(floor(value) AS BIGINT) % 7)::BIGINT AS steps FROM events GROUP BY 1, 2""")
def stream_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Z5 by the day; a day's state ends with it."""
    r = _events(spark, sf).selectExpr("user_id AS tenant_id", "ts", "cast(floor(value) as bigint) % 7 AS steps")
    used = _to_end(streams.quota_stream(r, "1 day"), "quota").where("tenant_id IS NOT NULL")
    return used.select(F.date_format("period_start", "yyyy-MM-dd").alias("period"), "tenant_id", "requests", "steps")


@query("stream_dedup", """SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each user and type, within a delay as long as the table."""
    e = _events(spark, sf).select("ts", "user_id", "event_type")
    return _to_end(streams.dedup_stream(e, ["user_id", "event_type"], "300 days"), "dedup").where("user_id IS NOT NULL").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
