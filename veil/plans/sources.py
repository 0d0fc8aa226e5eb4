"""Registered queries through the readers and sinks: rows derived from the tables, written, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veil.operators import payloads, regions
from veil.plans.derived import table
from veil.plans.registry import query
from veil.session import checkpoint_dir
from veil.sources import io


def new_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("page_scan", """SELECT page_id, url, length(html) AS n FROM pages""")
def page_scan(spark, sf):
    """S1."""
    return io.read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n"))


@query("truth_scan", """
SELECT cast(l_orderkey AS VARCHAR) AS page_id, CASE WHEN l_orderkey % 3 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n_boxes, sum(l_quantity) AS w, max(l_returnflag) AS role FROM lineitem GROUP BY l_orderkey""")
def truth_scan(spark, sf):
    """Nested boxes and elements, out of JSON."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.lit("email").alias("category"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("l_quantity").cast("double").alias("w"), F.lit(3.0).alias("h"))).alias("boxes"),
        F.array(F.struct(F.max("l_returnflag").alias("role"), F.lit(True).alias("is_sensitive"))).alias("elements"))
    path = new_path(spark, "truth")
    rows.selectExpr("cast(l_orderkey as string) AS page_id", "CASE WHEN l_orderkey % 3 = 0 THEN 'dev' ELSE 'test' END AS split", "boxes", "elements").write.json(path)
    truth = io.read_ground_truth(spark, path)
    boxes = io.truth_boxes(truth).groupBy("page_id", "split").agg(F.count(F.lit(1)).alias("n_boxes"), F.sum("w").alias("w"))
    return boxes.join(io.truth_elements(truth).select("page_id", "role"), "page_id")


@query("telemetry_scan", """
SELECT cast(event_id AS VARCHAR) AS run_id, event_id AS total_ms, CASE WHEN event_id % 10 <> 0 THEN 1 END AS t0, event_id % 10 = 0 AS broken FROM events""")
def telemetry_scan(spark, sf):
    """S3: the first source is not there; unreadable records stay visible."""
    path = new_path(spark, "telemetry")
    line = """CASE WHEN event_id % 10 = 0 THEN concat('{"run_id":"', cast(event_id as string), '","total_ms":', cast(event_id as string), ',"t0":"x"}')
      ELSE to_json(named_struct('run_id', cast(event_id as string), 'total_ms', event_id, 't0', 1)) END AS value"""
    table(spark, sf, "events").selectExpr(line).write.text(path)
    rows = io.read_telemetry(spark, [path + "-missing", path])
    return rows.select("run_id", "total_ms", "t0", F.col("_corrupt").isNotNull().alias("broken"))


@query("run_scan", """
SELECT cast(o_orderkey AS VARCHAR) AS run_id, o_orderstatus = 'F' AS passed, count(l_linenumber) AS n_steps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def run_scan(spark, sf):
    """Runs with their steps."""
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("step"), F.lit("click").alias("kind"))).alias("steps"))
    rows = table(spark, sf, "orders").join(steps, "o_orderkey", "left").selectExpr("cast(o_orderkey as string) AS run_id", "o_orderstatus = 'F' AS passed", "steps")
    path = new_path(spark, "runs")
    # One document a file is what the reader takes; here a file holds a list of runs of one partition.
    rows.groupBy(F.pmod(F.xxhash64("run_id"), F.lit(64)).alias("file")).agg(F.to_json(F.collect_list(F.struct("run_id", "passed", "steps"))).alias("value")).select(
        "value", "file").write.partitionBy("file").text(path)
    return io.read_runs(spark, path).select("run_id", "passed", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("n_steps")).withColumn("n_steps", F.greatest("n_steps", F.lit(0)))


@query("run_sink", """SELECT o_orderkey, o_orderpriority FROM orders""")
def run_sink(spark, sf):
    """A run is written once; the second write is refused."""
    rows, root = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), new_path(spark, "run-sink")
    path = io.write_run(rows, root, "r1")
    try:
        io.write_run(rows.limit(0), root, "r1")
    except Exception as refused:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" not in str(refused):
            raise
        return spark.read.parquet(path)
    raise AssertionError("a run was written twice")


@query("scorecard_sink", """
SELECT event_type AS metric, 'NOT_MEASURED' AS verdict FROM events GROUP BY 1 UNION ALL
SELECT 'p50_total_ms', CASE WHEN avg(value) <= 1200 THEN 'PASSED' ELSE 'FAILED' END FROM events""")
def scorecard_sink(spark, sf):
    """S6."""
    e = table(spark, sf, "events")
    rows = e.groupBy(F.col("event_type").alias("metric")).agg(F.lit(None).cast("double").alias("value")).unionByName(
        e.agg(F.lit("p50_total_ms").alias("metric"), F.avg("value").alias("value")))
    return spark.read.schema("metric string, verdict string").json(io.write_scorecard(rows, new_path(spark, "scorecard")))


@query("audit_log", """SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def audit_log(spark, sf):
    """Two writers append, the view keeps the newest."""
    e, path = table(spark, sf, "events").select("event_id", "ts"), new_path(spark, "audit")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        io.append_audit(e.where(part), path)
    return io.read_audit(spark, path).select("event_id")


@query("surface_detection", """
SELECT c_custkey, 'high_risk_surface' AS category FROM customer WHERE c_custkey % 6 IN (0, 1, 2) OR (c_custkey % 6 = 3 AND c_mktsegment = 'BUILDING')""")
def surface_detection(spark, sf):
    """D8."""
    els = table(spark, sf, "customer").selectExpr(
        "c_custkey", "element_at(array('canvas', 'iframe', 'img', 'img', 'img', 'div'), cast(c_custkey % 6 + 1 as int)) AS tag",
        "CASE c_custkey % 6 WHEN 2 THEN 'Photo ID-Card' WHEN 3 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'x Scanned' ELSE NULL END WHEN 5 THEN 'document' ELSE 'plain' END AS cls")
    return regions.detect_surfaces(els).select("c_custkey", "category")


@query("chat_payloads", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'invalid_message' WHEN 1 THEN 'elements: invalid_name' WHEN 2 THEN 'history: invalid_history_role' WHEN 3 THEN 'invalid_mask_count' WHEN 4 THEN 'unknown_property' END AS reason FROM orders""")
def chat_payloads(spark, sf):
    """V2, the chat contract: elements need no role there."""
    body = """concat('{"protocolVersion":"1.0","message":"', CASE WHEN o_orderkey % 6 = 0 THEN ' ' ELSE o_orderpriority END, '","maskCount":', CASE WHEN o_orderkey % 6 = 3 THEN '-1' ELSE '2' END,
      ',"elements":[{"localId":"el_1","sanitizedName":"', CASE WHEN o_orderkey % 6 = 1 THEN repeat('n', 121) ELSE 'n' END, '"}],"history":[{"role":"', CASE WHEN o_orderkey % 6 = 2 THEN 'system' ELSE 'user' END,
      '","content":"c"}]', CASE WHEN o_orderkey % 6 = 4 THEN ',"goal":"g"' ELSE '' END, '}') AS body"""
    p = table(spark, sf, "orders", heavy=True).selectExpr("o_orderkey", body)
    return payloads.tag_payloads(p, "body", payloads.CHAT).select("o_orderkey", "reason")
