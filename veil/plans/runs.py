"""Queries over events, requests, runs and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import payloads, quality, telemetry
from veil.plans.derived import REQUESTS, TENANTS, derive, plain, table
from veil.plans.registry import query

TENANT_SQL = plain(TENANTS)


def events(spark, sf):
    return table(spark, sf, "events")


def requests(spark, sf):
    return derive(spark, sf, REQUESTS)


@query("latency_percentiles", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN value END) AS p95 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf):
    """A4's percentile by type."""
    from veil.functions.ordered import index_percentile

    return index_percentile(events(spark, sf), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("script_medians", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(CASE WHEN i = floor(n / 2) THEN value END) AS value FROM r GROUP BY user_id""")
def script_medians(spark, sf):
    """A5."""
    return quality.index_percentile(events(spark, sf), "value", 0.5, ["user_id"])


@query("latency_summary", """
WITH t AS (SELECT event_type, cast(floor(value * 10) AS BIGINT) AS total, cast(floor(value) AS BIGINT) AS client, cast(floor(value * 8) AS BIGINT) AS server FROM events),
s AS (SELECT event_type, 'total' AS stage, total AS ms FROM t UNION ALL SELECT event_type, 'client', client FROM t UNION ALL SELECT event_type, 'server', server FROM t UNION ALL SELECT event_type, 'action', greatest(0, total - client - server) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, stage ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY event_type, stage) AS n FROM s)
SELECT event_type, stage, max(CASE WHEN i = least(n - 1, floor(n * 0.5)) THEN ms END)::DOUBLE AS p50, max(CASE WHEN i = least(n - 1, floor(n * 0.95)) THEN ms END)::DOUBLE AS p95 FROM r GROUP BY ALL""")
def latency_summary(spark, sf):
    """A4."""
    t = events(spark, sf).selectExpr("event_type", "cast(floor(value * 10) as bigint) AS total_ms", "cast(floor(value) as bigint) AS client_ms", "cast(floor(value * 8) as bigint) AS server_ms")
    return quality.latency_summary(t, ["event_type"])


@query("latency_cumulative", """
SELECT event_id, sum(cast(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS client_cum FROM events""")
def latency_cumulative(spark, sf):
    """W3."""
    e = events(spark, sf).selectExpr("event_id", "user_id", "ts", "cast(floor(value) as bigint) AS client_ms")
    return telemetry.cumulative(e, "user_id", ["ts", "event_id"], telemetry.day("ts"), {"client_cum": "client_ms"}).select("event_id", "client_cum")


@query("state_transitions", """
SELECT prev, curr, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_type AS curr FROM events) WHERE prev IS NOT NULL GROUP BY ALL""")
def state_transitions(spark, sf):
    """W9."""
    moves = telemetry.transitions(events(spark, sf), "user_id", ["ts", "event_id"], telemetry.day("ts"), "event_type")
    return telemetry.transition_matrix(moves)


@query("loop_detection", """
WITH l AS (SELECT event_id, event_type AS t, lag(event_type, 1) OVER w AS l1, lag(event_type, 2) OVER w AS l2, lag(event_type, 3) OVER w AS l3, lag(event_type, 4) OVER w AS l4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN t = l1 AND t = l2 THEN 'repeat' WHEN t = l2 AND t = l4 AND l1 = l3 THEN 'alternate' END AS loop_kind FROM l""")
def loop_detection(spark, sf):
    """W2."""
    a = events(spark, sf).selectExpr("event_id", "user_id", "ts", "event_type AS kind")
    return telemetry.loops(a, "user_id", ["ts", "event_id"], telemetry.day("ts"), ident=("kind",), cycle=("kind",)).select("event_id", "loop_kind")


@query("state_delta", """
WITH c AS (SELECT user_id, event_id, event_type, cast(floor(value) AS BIGINT) % 40 AS n, lag(event_type) OVER w AS pt, lag(cast(floor(value) AS BIGINT) % 40) OVER w AS pn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS run_id, event_id AS step, event_type <> pt AS url_changed, greatest(0, n - pn) AS added, greatest(0, pn - n) AS removed, n - pn AS scroll_dy,
 CASE WHEN event_type <> pt THEN concat('Page navigated to /', event_type) WHEN n - pn > 5 THEN concat('UI updated: ', cast(n - pn AS VARCHAR), ' new elements rendered') ELSE 'Action executed' END AS outcome FROM c WHERE pn IS NOT NULL""")
def state_delta(spark, sf):
    """W1."""
    c = events(spark, sf).selectExpr("user_id AS run_id", "event_id AS step", "concat('/', event_type) AS url", "cast(floor(value) as bigint) % 40 AS n_elements",
                                     "cast(floor(value) as bigint) % 40 AS scroll_top", "array(event_type) AS local_ids", "cast(NULL as string) AS message")
    return telemetry.state_delta(c).select("run_id", "step", "url_changed", "added", "removed", "scroll_dy", "outcome")


@query("stage_durations", """
SELECT stage, sum(ms)::BIGINT AS ms FROM (SELECT unnest(['capture', 'detection', 'sanitization', 'reasoning', 'validation', 'execution', 'verification']) AS stage, unnest([1, 2, 3, cast(floor(value) AS BIGINT), 5, 6, 7]) AS ms FROM events) GROUP BY stage""")
def stage_durations(spark, sf):
    """W4."""
    t = events(spark, sf).selectExpr("event_id AS run_id", "0L AS t0", "1L AS t1", "3L AS t2", "6L AS t3", "6 + cast(floor(value) as bigint) AS t4",
                                     "11 + cast(floor(value) as bigint) AS t5", "17 + cast(floor(value) as bigint) AS t6", "24 + cast(floor(value) as bigint) AS t7")
    return telemetry.stage_durations(t).groupBy("stage").agg(F.sum("ms").alias("ms"))


RATE = """
WITH RECURSIVE e AS (SELECT {key} AS key, event_id AS id, cast(floor(epoch_us(ts) / ({shrink} * 1000)) AS BIGINT) AS t FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS n FROM e),
f AS (SELECT key, id, n, t, t AS ws, 1::BIGINT AS c FROM o WHERE n = 1 UNION ALL
 SELECT o.key, o.id, o.n, o.t, CASE WHEN o.t - f.ws > 60000 THEN o.t ELSE f.ws END, CASE WHEN o.t - f.ws > 60000 THEN 1 ELSE f.c + 1 END FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
SELECT id, ws AS window_start, c AS count_in_window, c = 1 OR c <= 2 AS allowed FROM f"""


@query("rate_limit", RATE.replace("{key}", "user_id").replace("{shrink}", "100"))
def rate_limit(spark, sf):
    """A hundredfold faster clock, so that windows hold several requests."""
    r = events(spark, sf).selectExpr("user_id AS key", "event_id AS id", "cast(floor(unix_micros(ts) / 100000) as bigint) AS ts_ms")
    return telemetry.rate_limit(r, 2).select("id", "window_start", "count_in_window", "allowed")


@query("rate_limit_hot_key", RATE.replace("{key}", "event_id % 2").replace("{shrink}", "1000"))
def rate_limit_hot_key(spark, sf):
    """W5 with two keys that hold everything: they are dealt out by the hour."""
    r = events(spark, sf).selectExpr("event_id % 2 AS key", "event_id AS id", "cast(floor(unix_micros(ts) / 1000000) as bigint) AS ts_ms")
    return telemetry.rate_limit(r, 2).select("id", "window_start", "count_in_window", "allowed")


@query("audit_retention", """SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def audit_retention(spark, sf):
    """W6 over everything."""
    return telemetry.keep_latest(events(spark, sf).select("event_id", "ts"), [], 500, ["ts", "event_id"]).select("event_id")


@query("recent_requests", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 15""")
def recent_requests(spark, sf):
    """W6 per key."""
    return telemetry.keep_latest(events(spark, sf), ["user_id"], 15, ["ts", "event_id"]).select("user_id", "event_id")


CACHE = """
WITH e AS (SELECT event_id, ts, user_id, concat(event_type, CASE WHEN event_id % 10 = 0 THEN ' no cache' ELSE '' END) AS goal, cast(user_id % 3 AS VARCHAR) AS layout, event_type FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, goal ORDER BY ts, event_id) AS n FROM e)
SELECT event_id, n > 1 AND NOT contains(goal, 'no cache') AS is_hit FROM k"""


def _cache(spark, sf):
    c = events(spark, sf).selectExpr("ts", "event_id AS id", "cast(user_id as string) AS domain", "'/' AS path", "concat(event_type, CASE WHEN event_id % 10 = 0 THEN ' no cache' ELSE '' END) AS goal",
                                     "cast(user_id % 3 as string) AS layout", "'click' AS kind")
    return telemetry.cache_replay(c)


@query("cache_replay", CACHE)
def cache_replay(spark, sf):
    """W8."""
    return _cache(spark, sf).select(F.col("id").alias("event_id"), "is_hit")


@query("cache_savings", f"""
SELECT sum(is_hit::INT)::BIGINT AS hits, sum((NOT is_hit)::INT)::BIGINT AS misses, (sum(is_hit::INT) * 4200)::BIGINT AS tokens_saved, (sum(is_hit::INT) * 11500)::BIGINT AS ms_saved FROM ({CACHE})""")
def cache_savings(spark, sf):
    """A13."""
    return telemetry.cache_savings(_cache(spark, sf))


@query("quota_usage", f"""
WITH t AS ({TENANT_SQL}), u AS (SELECT cast(user_id AS VARCHAR) AS key, count(*) AS n, sum(cast(floor(value) AS BIGINT) % 7)::BIGINT AS s FROM events GROUP BY 1)
SELECT tenant_id, coalesce(n, 0) AS requests, greatest(0, quota - coalesce(s, 0))::BIGINT AS remaining FROM t LEFT JOIN u USING (key)""")
def quota_usage(spark, sf):
    """A12."""
    r = requests(spark, sf).selectExpr("user_id AS tenant_id", "steps")
    return telemetry.tenant_usage(r, derive(spark, sf, TENANTS))


@query("request_status", f"""
WITH t AS ({TENANT_SQL}) SELECT CASE WHEN e.event_id % 17 = 0 THEN 401 WHEN t.key IS NULL THEN 401 WHEN NOT active THEN 403 WHEN remaining <= 0 THEN 429 ELSE 200 END AS status, count(*) AS n
FROM events e LEFT JOIN t ON cast(e.user_id AS VARCHAR) = t.key GROUP BY 1""")
def request_status(spark, sf):
    """J14."""
    r = requests(spark, sf).selectExpr("id", "CASE WHEN id % 17 = 0 THEN '  ' ELSE key END AS key")
    return telemetry.authorize(r, derive(spark, sf, TENANTS)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("latest_tenant", f"""WITH t AS ({TENANT_SQL}) SELECT tenant_id FROM t ORDER BY coalesce(CASE WHEN tenant_id % 2 = 0 THEN remaining END, quota) DESC, tenant_id LIMIT 1""")
def latest_tenant(spark, sf):
    """T6."""
    t = derive(spark, sf, TENANTS).selectExpr("tenant_id", "CASE WHEN tenant_id % 2 = 0 THEN remaining END AS last_used", "quota AS created")
    return telemetry.latest_tenant(t).select("tenant_id")


@query("upsert_latest", """
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(CASE WHEN event_id % 3 = 0 THEN props END, (ts, event_id)) FILTER (event_id % 3 = 0) AS props FROM events GROUP BY ALL""")
def upsert_latest(spark, sf):
    """A NULL never replaces a value."""
    e = events(spark, sf).selectExpr("user_id", "event_type", "ts", "event_id", "value", "CASE WHEN event_id % 3 = 0 THEN props END AS props")
    return telemetry.upsert_latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "props")


@query("layout_signatures", """
WITH e AS (SELECT l_orderkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS seq FROM lineitem)
SELECT l_orderkey AS capture_id, string_agg(concat('button:', lower(l_returnflag), lower(l_linestatus)), '|' ORDER BY seq) AS signature FROM e WHERE seq <= 15 GROUP BY 1""")
def layout_signatures(spark, sf):
    """A14."""
    e = derive(spark, sf, "SELECT l_orderkey AS capture_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS seq, "
               "'button' AS role, concat(' ', l_returnflag, l_linestatus, ' ') AS name FROM {lineitem}")
    return telemetry.layout_signature(e)


@query("layout_drift", """
SELECT user_id, event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM events""")
def layout_drift(spark, sf):
    """W10."""
    c = events(spark, sf).selectExpr("user_id", "event_id", "ts", "event_type AS signature")
    return telemetry.layout_drift(c, "user_id", ["ts", "event_id"], telemetry.day("ts")).select("user_id", "event_id", "changed")


@query("consolidated_steps")
def consolidated_steps(spark, sf):
    """The item comments of an order as step texts."""
    s = table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "l_linenumber AS step", "concat(l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END) AS text")
    return telemetry.consolidate(s).select("run_id", F.size("texts").alias("n_texts"))


@query("evidence_dedup", """
SELECT l_orderkey AS run_id, l_returnflag AS kind, l_linestatus AS summary, min(l_partkey) AS seq FROM lineitem GROUP BY ALL""")
def evidence_dedup(spark, sf):
    """A17."""
    e = table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "1 AS objective_id", "l_returnflag AS kind", "l_linestatus AS summary", "0 AS action_id", "l_partkey AS seq", "true AS verified")
    return telemetry.dedup_evidence(e).select("run_id", "kind", "summary", "seq")


@query("completion_audit", """
WITH e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_custkey AS run_id, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN e.l_orderkey IS NULL THEN 1 ELSE 0 END) = 0 AS satisfied,
 CASE WHEN sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) > 0 THEN 'incomplete' WHEN sum(CASE WHEN e.l_orderkey IS NULL THEN 1 ELSE 0 END) > 0 THEN 'unverified' END AS problem
FROM orders LEFT JOIN e ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def completion_audit(spark, sf):
    """A customer's orders are objectives, returned items the evidence."""
    obj = table(spark, sf, "orders").selectExpr("o_custkey AS run_id", "o_orderkey AS objective_id", "o_orderstatus = 'F' AS completed")
    ev = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_returnflag = 'R' AS verified").join(
        table(spark, sf, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS run_id"), "l_orderkey").selectExpr("run_id", "l_orderkey AS objective_id", "verified")
    return telemetry.completion_audit(obj, ev).select("run_id", "satisfied", "problem")


@query("result_rollup", """
SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, concat('1. [a] (SUCCESS): ', o_orderstatus, chr(10), '2. [b] (', CASE WHEN o_orderkey % 4 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END, '): ', o_orderpriority) AS summary,
  3::BIGINT AS mask_count, 2::BIGINT AS step_count FROM orders""")
def result_rollup(spark, sf):
    """A18."""
    o = table(spark, sf, "orders")
    a = o.selectExpr("o_orderkey AS task_id", "1 AS seq", "'a' AS sub_id", "'success' AS outcome", "o_orderstatus AS summary", "3L AS mask_count", "1L AS step_count")
    b = o.selectExpr("o_orderkey AS task_id", "2 AS seq", "'b' AS sub_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'failure' ELSE 'success' END AS outcome", "o_orderpriority AS summary", "cast(NULL as bigint) AS mask_count", "cast(NULL as bigint) AS step_count")
    return telemetry.rollup_results(a.unionByName(b))


@query("price_comparison", """
WITH p AS (SELECT l_partkey AS query, l_suppkey AS source, cast(floor(l_extendedprice) AS BIGINT) AS price FROM lineitem), s AS (SELECT query, source, min(price) AS price FROM p GROUP BY ALL)
SELECT query, count(*) AS sources, arg_min(source, (price, source)) AS cheapest, max(price) - min(price) AS difference FROM s GROUP BY query HAVING count(*) >= 2""")
def price_comparison(spark, sf):
    """Suppliers as sources of a part."""
    s = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.floor("l_extendedprice")).alias("p"))
    r = s.select(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("source"), F.concat(F.lit("Fare Rs. "), F.format_number("p", 0), F.lit(" only")).alias("summary"))
    return telemetry.compare_prices(r)


@query("payload_digest", """
SELECT o_orderkey, concat('sha256_', sha256(concat('{"goal":"', o_orderpriority, '","items":["a","z', lower(o_orderstatus), '"],"maskCount":', cast(o_orderkey AS VARCHAR), '}'))) AS digest FROM orders""")
def payload_digest(spark, sf):
    """A15; string arrays are sorted before hashing."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderpriority", "array(concat('z', lower(o_orderstatus)), 'a') AS items")
    return telemetry.payload_digest(o, {"maskCount": "o_orderkey", "goal": "o_orderpriority", "items": "items"}).select("o_orderkey", "digest")


@query("digest_mismatches", """SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0""")
def digest_mismatches(spark, sf):
    """Every ninth payload was changed after it was signed."""
    f = {"maskCount": "o_orderkey", "goal": "goal"}
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("goal"))
    signed = telemetry.payload_digest(o, f, "declared").withColumn("goal", F.when(F.col("o_orderkey") % 9 == 0, F.lit("changed")).otherwise(F.col("goal")))
    return telemetry.verify_digest(signed, f).select("o_orderkey")


@query("run_rates", """
WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS k, o_orderstatus = 'F' AS ok, o_orderkey % 5 = 0 AS abst FROM orders)
SELECT 'autonomous_completion' AS metric, sum((k = 0 AND ok)::INT)::BIGINT AS num, sum((k = 0)::INT)::BIGINT AS den FROM r UNION ALL SELECT 'assisted_completion', sum((k = 1 AND ok)::INT), sum((k = 1)::INT) FROM r
UNION ALL SELECT 'safe_failure', sum((k = 2 AND ok)::INT), sum((k = 2)::INT) FROM r UNION ALL SELECT 'incorrect_action', sum((NOT ok)::INT), count(*) FROM r UNION ALL SELECT 'unsafe_action', sum((k = 2)::INT), sum((k = 2)::INT) FROM r
UNION ALL SELECT 'abstention', sum(abst::INT), count(*) FROM r UNION ALL SELECT 'intervention', sum((k = 1)::INT), count(*) FROM r""")
def run_rates(spark, sf):
    """A7."""
    r = table(spark, sf, "orders").selectExpr(
        "element_at(array('expected autonomous success', 'expected user-assisted success', 'expected safe abstention'), cast(o_orderkey % 3 + 1 as int)) AS classification", "o_orderstatus = 'F' AS passed",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'blocked-local-only' ELSE 'complete' END AS terminal_state", "CASE WHEN o_orderkey % 3 = 1 THEN array('confirm_or_deny_modal') ELSE array('click') END AS interactions",
        "array(named_struct('executed', true, 'verified', o_orderstatus = 'F', 'risk', CASE WHEN o_orderkey % 3 = 2 THEN 'blocked' ELSE 'safe' END)) AS steps")
    return quality.run_rates(r).select("metric", "num", "den")


@query("closed_schema_rejects", """SELECT 'unknown_property' AS reason, count(*) AS n FROM events""")
def closed_schema_rejects(spark, sf):
    """V1 over event properties: none of their keys belongs to the contract."""
    return payloads.tag_payloads(events(spark, sf).select("props"), "props").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_keys", """SELECT unnest(json_keys(props)) AS key, count(*) AS n FROM events GROUP BY 1""")
def unknown_keys(spark, sf):
    """X2."""
    out = payloads.unknown_keys(events(spark, sf).select("props"), "props", ["goal"])
    return out.select(F.explode("unknown").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


PAYLOAD = """concat('{"protocolVersion":"', CASE WHEN o_orderkey % 7 = 1 THEN '2.0' ELSE '1.0' END, '","runId":"run_', cast(o_orderkey as string), '","goal":"', CASE WHEN o_orderkey % 7 = 2 THEN '  ' ELSE o_orderpriority END,
  '","screenshot":"data:image/png;base64,AAAA","pageState":{"title":"T","viewport":[1280,', CASE WHEN o_orderkey % 7 = 3 THEN '-1' ELSE '720' END, ']},"elements":[{"localId":"el_1","role":"button","state":["enabled"',
  CASE WHEN o_orderkey % 7 = 4 THEN ',"enabled"' ELSE '' END, ']}', CASE WHEN o_orderkey % 7 = 5 THEN ',{"localId":"el_1","role":"link"}' ELSE '' END, ']', CASE WHEN o_orderkey % 7 = 6 THEN ',"extra":1' ELSE '' END, '}')"""


@query("payload_validation", """
SELECT CASE o_orderkey % 7 WHEN 1 THEN 'unsupported_version' WHEN 2 THEN 'invalid_goal' WHEN 3 THEN 'invalid_viewport' WHEN 4 THEN 'elements: invalid_state' WHEN 5 THEN 'duplicate_localId' WHEN 6 THEN 'unknown_property' ELSE 'valid' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def payload_validation(spark, sf):
    """V1."""
    p = table(spark, sf, "orders", heavy=True).selectExpr(f"{PAYLOAD} AS body")
    return payloads.tag_payloads(p, "body").groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("payload_contradictions", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'elements: contradictory_state' WHEN 1 THEN 'contradictory_manifest' WHEN 2 THEN 'contradictory_manifest' WHEN 3 THEN 'pixels_not_verified' END AS reason FROM orders""")
def payload_contradictions(spark, sf):
    """V1: parts that are fine alone and contradict each other."""
    body = """concat('{"protocolVersion":"1.0","runId":"r', cast(o_orderkey as string), '","goal":"g","screenshot":"data:image/png;base64,AAAA","pageState":{"title":"T","viewport":[1280,720]},
      "elements":[{"localId":"el_1","role":"button","state":["visible","enabled"', CASE WHEN o_orderkey % 6 = 0 THEN ',"disabled"' ELSE '' END, ']}],"redactionManifest":{"manifestVersion":"1.0","totalRegions":',
      cast(o_orderkey % 5 + 1 as string), ',"categoryCounts":{"face":1,"other":7,"piiText":', cast(o_orderkey % 5 + CASE WHEN o_orderkey % 6 = 1 THEN 1 ELSE 0 END as string),
      '},"methodCounts":{"spatialBlur":', cast(o_orderkey % 5 + 1 as string), CASE WHEN o_orderkey % 6 = 2 THEN ',"opaqueBox":2' ELSE '' END, '},"pixelVerificationPerformed":true,"pixelVerificationPassed":',
      CASE WHEN o_orderkey % 6 = 3 THEN 'false' ELSE 'true' END, '}}')"""
    p = table(spark, sf, "orders", heavy=True).selectExpr("o_orderkey", f"{body} AS body")
    return payloads.tag_payloads(p, "body").select("o_orderkey", "reason")


@query("batch_actions", """
SELECT o_orderkey AS page_id, CASE o_orderkey % 8 WHEN 0 THEN 'batchActions: invalid_kind' WHEN 1 THEN 'unknown_target' WHEN 2 THEN 'batchActions: missing_text' WHEN 3 THEN 'batchActions: missing_target'
  WHEN 4 THEN 'batchActions: unknown_property' WHEN 5 THEN 'unknown_target' END AS reason FROM orders""")
def batch_actions(spark, sf):
    """V4: the members of a batch obey the same rules as single actions, and so do destinations."""
    member = """concat('{"actionId":"s","kind":"', CASE o_orderkey % 8 WHEN 0 THEN 'nonsense' WHEN 2 THEN 'type' ELSE 'click' END, '"',
      CASE WHEN o_orderkey % 8 = 3 THEN '' WHEN o_orderkey % 8 = 1 THEN ',"targetLocalId":"el_404"' ELSE ',"targetLocalId":"el_2"' END, CASE WHEN o_orderkey % 8 = 4 THEN ',"tabId":1' ELSE '' END, '}')"""
    body = f"""concat('{{"actionId":"a","kind":"', CASE WHEN o_orderkey % 8 = 5 THEN 'drag_and_drop' ELSE 'batch' END, '","confidence":1,"risk":"safe","rationale":"r","targetLocalId":"el_1","destinationLocalId":"',
      CASE WHEN o_orderkey % 8 = 5 THEN 'el_9' ELSE 'el_2' END, '","batchActions":[{{"actionId":"f","kind":"wait"}},', {member}, ']}}')"""
    o = table(spark, sf, "orders", heavy=True)
    elements = o.selectExpr("o_orderkey AS page_id", "explode(array('el_1', 'el_2')) AS local_id")
    return payloads.tag_actions(o.selectExpr("o_orderkey AS page_id", f"{body} AS proposal"), elements).select("page_id", "reason")


@query("task_requests", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'invalid_max_parallel' WHEN 1 THEN 'invalid_goal' ELSE 'valid' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def task_requests(spark, sf):
    """V3."""
    p = table(spark, sf, "orders").selectExpr("concat('{\"protocolVersion\":\"1.0\",\"goal\":\"', CASE WHEN o_orderkey % 4 = 1 THEN 'x <script>' ELSE o_orderpriority END, '\",\"maxParallel\":', CASE WHEN o_orderkey % 4 = 0 THEN '9' ELSE '2' END, '}') AS body")
    valid, rejects = payloads.validate_requests(p, "body")
    return valid.select(F.lit("valid").alias("reason")).unionByName(rejects.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# A further member of a proposal, and the reason it gives. Every published key occurs, and some that break a rule.
ACTION_PIECES = [
    *[(f'"{k}":{v}', None) for k, v in {
        "objectiveId": '"o_1"', "destinationLocalId": '"el_2"', "expectedState": '"open"', "expectedPostcondition": '{"kind":"scroll_changed","direction":"up"}', "semanticMatchReason": '"same name"',
        "fallbackStrategy": '"pray"', "completionEvidence": '["URL","dream"]', "fileData": '"AA=="', "mimeType": '"text/plain"', "scrollDirection": '"top"', "tabId": "3", "userApproved": "true",
        "pressEnter": "false", "extractedData": '{"a":1}', "extractSchema": '{"a":"string"}', "extractLimit": "5", "containerSelector": '".x"', "extractedItems": "[]", "answerText": '"42"', "reply": '"done"',
        "message": '"m"', "reasoning": '"because"', "thought": '"t"', "userInputPrompt": '"your name"', "inputKey": '"name"', "subTasks": '[{"goal":"g"}]', "coordinates": "[1.5,2]",
        "targetUrl": '"https://a.example"', "createNewTab": "true", "description": '"d"', "targetName": '"Send"', "elementText": '"Send"', "searchResults": "[]"}.items()],
    ('"switchTab":1', "unknown_property"), ('"objectiveId":"a b"', "invalid_objective_id"), ('"reasoning":"see https://a.example"', "invalid_reasoning"), ('"tabId":-1', "invalid_tab_id"),
    ('"mimeType":"text plain"', "invalid_mime_type"), ('"searchResults":"none"', "invalid_search_results"), ('"coordinates":[1]', "invalid_coordinates"), ('"inputKey":""', "invalid_input_key"),
    ('"expectedPostcondition":{"kind":"dreamt"}', "unknown_postcondition_kind"), ('"expectedPostcondition":{"kind":"dialog_visible","state":"x"}', "unknown_postcondition_property"),
    ('"expectedPostcondition":{"kind":"element_count_changed","minimumDelta":0}', "invalid_minimum"), ('"expectedPostcondition":{"kind":"attribute_changed","attributeName":"onclick"}', "invalid_attribute"),
    ('"expectedPostcondition":{"kind":"panel_visible","namePattern":"#main"}', "unsafe_postcondition"), ('"expectedPostcondition":{"kind":"visibility_changed","state":"gone"}', "invalid_visibility"),
]


@query("action_kinds", f"""
SELECT o_orderkey AS page_id, CASE WHEN k = 'batch' AND r IS NULL THEN 'missing_batch' ELSE coalesce(r, CASE WHEN o_orderkey % 7 = 3 AND k = 'click' THEN 'missing_capability' END) END AS reason
FROM (SELECT o_orderkey, [{", ".join(f"'{k}'" for k in payloads.ACTION_KINDS)}][o_orderkey % {len(payloads.ACTION_KINDS)} + 1] AS k,
  [{", ".join(f"'{r}'" if r else "NULL" for _, r in ACTION_PIECES)}][o_orderkey // {len(payloads.ACTION_KINDS)} % {len(ACTION_PIECES)} + 1] AS r FROM orders)""")
def action_kinds(spark, sf):
    """V4: every published kind with every published key."""
    arr = lambda values: "array(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"
    kinds, n = len(payloads.ACTION_KINDS), len(ACTION_PIECES)
    kind = f"element_at({arr(payloads.ACTION_KINDS)}, cast(o_orderkey % {kinds} + 1 as int))"
    piece = f"element_at({arr([p for p, _ in ACTION_PIECES])}, cast(floor(o_orderkey / {kinds}) % {n} + 1 as int))"
    dest = f"CASE WHEN {piece} LIKE '%destination%' THEN '' ELSE ',\"destinationLocalId\":\"el_2\"' END"
    body = f"""concat('{{"actionId":"a","kind":"', {kind}, '","confidence":0.5,"risk":"safe","rationale":"r","targetLocalId":"el_1","textToType":"abc","selectOptionValue":"one","fileName":"a.txt","url":"https://b.example","searchQuery":"q"', {dest}, ',', {piece}, '}}')"""
    o = table(spark, sf, "orders", heavy=True)
    elements = o.selectExpr("o_orderkey AS page_id", "explode(array('el_1', 'el_2')) AS local_id", "CASE WHEN o_orderkey % 7 = 3 THEN array('type', 'select', 'hover', 'drag') END AS caps")
    return payloads.tag_actions(o.selectExpr("o_orderkey AS page_id", f"{body} AS proposal"), elements).select("page_id", "reason")


@query("action_validation", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'unknown_target' WHEN 1 THEN 'missing_text' WHEN 2 THEN 'invalid_target' ELSE 'valid' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def action_validation(spark, sf):
    """V4."""
    o = table(spark, sf, "orders", heavy=True)
    a = o.selectExpr("o_orderkey AS page_id", """concat('{"actionId":"a', cast(o_orderkey as string), '","kind":"', CASE WHEN o_orderkey % 4 = 1 THEN 'type' ELSE 'click' END, '","confidence":0.5,"risk":"safe","rationale":"r","targetLocalId":"',
        CASE o_orderkey % 4 WHEN 0 THEN 'el_9' WHEN 2 THEN '#main > a' ELSE 'el_1' END, '"}') AS proposal""")
    valid, rejects = payloads.validate_actions(a, o.selectExpr("o_orderkey AS page_id", "'el_1' AS local_id"))
    return valid.select(F.lit("valid").alias("reason")).unionByName(rejects.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("action_risk", """
SELECT CASE o_orderkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'protected' WHEN 2 THEN 'safe' WHEN 3 THEN 'blocked' WHEN 4 THEN 'protected' ELSE 'safe' END AS risk_level, count(*) AS n FROM orders GROUP BY 1""")
def action_risk(spark, sf):
    """V5."""
    a = table(spark, sf, "orders").selectExpr(
        "element_at(array('type', 'click', 'hover', 'batch', 'upload_file', 'click'), cast(o_orderkey % 6 + 1 as int)) AS kind", "CASE o_orderkey % 6 WHEN 0 THEN 'Card number' WHEN 1 THEN 'Delete row' WHEN 2 THEN 'Delete row' ELSE 'ok' END AS target_name",
        "false AS user_approved", "'safe' AS risk", "CASE WHEN o_orderkey % 6 = 3 THEN array(named_struct('kind', 'click', 'target', 'submit', 'rationale', ''), named_struct('kind', 'type', 'target', 'card_1', 'rationale', '')) END AS batch")
    return payloads.risk(a).groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_ids", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark, sf):
    """X3 over a table."""
    return payloads.duplicate_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_members", """SELECT o_orderstatus = 'F' AS has_duplicates, count(*) AS n FROM orders GROUP BY 1""")
def duplicate_members(spark, sf):
    """X3 over arrays."""
    o = table(spark, sf, "orders").selectExpr("array('F', o_orderstatus) AS a")
    return payloads.has_duplicates(o, "a").groupBy("has_duplicates").agg(F.count(F.lit(1)).alias("n"))


@query("payload_bytes", """
SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE length(text) > 0""")
def payload_bytes(spark, sf):
    """The decoded size is read off the base64 text."""
    d = table(spark, sf, "documents", heavy=True).filter("length(text) > 0").select("doc_id", F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "utf-8"))).alias("shot"))
    d = d.withColumn("shot", F.regexp_replace("shot", r"\s", ""))
    return payloads.b64_bytes(d, "shot").select("doc_id", "bytes")


@query("wire_projection", """SELECT o_orderkey, o_orderstatus FROM orders""")
def wire_projection(spark, sf):
    """P5."""
    return payloads.wire_projection(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "goal"])


@query("interactive_elements", """SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def interactive_elements(spark, sf):
    """P6."""
    e = table(spark, sf, "lineitem").selectExpr("l_returnflag", "CASE WHEN l_linestatus = 'O' THEN 'button' ELSE 'heading' END AS role")
    return telemetry.interactive(e).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
