"""Ordered analytics, the large-session and hot-key paths included."""

import random

from pyspark.sql import functions as F

from veil.functions.ordered import _code, averaging_median, index_percentile, lagged, order_statistics, running
from veil.operators import chat, payloads, quality, telemetry


def brute_windows(rows):
    out, state = {}, {}
    for key, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, n = state.get(key, (None, 0))
        start, n = (t, 1) if start is None or t - start > 60_000 else (start, n + 1)
        state[key] = (start, n)
        out[i] = (start, n)
    return out


def test_rate_limit_short_and_long_sessions(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.choice([10, 900, 5_000, 20_000, 61_000 if i % 400 == 0 else 700])
        rows.append((i % 2 if i % 7 else 0, i, t))
    df = spark.createDataFrame(rows, "key int, id int, ts_ms long")
    want = brute_windows(rows)
    got = {r.id: (r.window_start, r.count_in_window) for r in telemetry.rate_limit(df, 5).collect()}
    assert got == want


def test_rate_limit_over_years_and_dense_minutes(spark):
    """Keys of text, hours that lead on into the next ones, gaps of months, times before 1970."""
    rnd = random.Random(6)
    rows, i = [], 0
    for key, gaps in (("dense", [1, 2, 40]), ("even", [59_999, 60_000, 60_001]), ("rare", [3_599_000, 90_000_000, 40_000_000_000])):
        t = -700_000_000_000 if key == "rare" else 1_700_000_000_000
        for _ in range(2500 if key == "dense" else 900):
            t += rnd.choice(gaps)
            rows.append((key, i, t))
            i += 1
    df = spark.createDataFrame([*rows, (None, -1, 5), ("x", -2, None)], "who string, id int, at long")
    got = {r.id: (r.window_start, r.count_in_window) for r in telemetry.rate_limit(df, 5, key="who", ts_ms="at").collect()}
    assert got == brute_windows(rows)


def test_rate_limit_of_a_hot_key_is_dealt_by_the_hour(spark):
    """Nine tenths of the requests have one key: its rows are spread like all others."""
    from pyspark.sql import functions as F

    df = spark.range(400_000).selectExpr("CASE WHEN id % 10 < 9 THEN 'hot' ELSE concat('k', id % 1000) END AS key", "id", "1700000000000 + (id * 7919) % 864000000 AS ts_ms")
    hours = df.select("key", F.floor(F.col("ts_ms") / telemetry.HOUR_MS).alias("_b")).repartition(16, "key", "_b")
    sizes = [r["n"] for r in hours.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    found = telemetry.rate_limit(df, 100)
    assert found.count() == 400_000
    bad = found.groupBy("key", "window_start").agg(F.max("count_in_window").alias("m"), F.count("*").alias("n"), F.max("ts_ms").alias("last"), F.min("ts_ms").alias("first"))
    assert bad.where("m <> n OR last - window_start > 60000 OR first <> window_start").count() == 0


def test_running_and_lag_across_buckets(spark):
    rnd = random.Random(9)
    rows = [(rnd.randrange(2), i, rnd.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {r.o: r for r in running(df, ["k"], F.floor(F.col("o") / 13), ["o"], {"s": (F.col("v"), "sum"), "m": (F.col("v"), "max")}).collect()}
    lags = {r.o: r for r in lagged(df, ["k"], F.floor(F.col("o") / 3), ["o"], ["v"], 4).collect()}
    seen = {0: [], 1: []}
    for k, o, v in rows:
        past = seen[k]
        for d in range(1, 5):
            assert lags[o][f"lag{d}_v"] == (past[-d] if len(past) >= d else None)
        past.append(v)
        assert (got[o].s, got[o].m) == (sum(past), max(past))


def test_index_percentile(spark):
    rows = [("a", float(x)) for x in [5, 1, 4, 2, 3, 3, 3]] + [("b", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p95) for r in index_percentile(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (3.0, 5.0), "b": (7.0, 7.0)}


def test_loops(spark):
    kinds = ["a", "a", "a", "b", "a", "b", "a", "wait", "wait", "wait"]
    df = spark.createDataFrame([(1, i, k, "t") for i, k in enumerate(kinds)], "run_id int, ts int, kind string, target string").withColumn("step", F.col("ts"))
    out = [r.loop_kind for r in telemetry.loops(df, ident=("kind", "target"), cycle=("kind", "target")).orderBy("ts").collect()]
    assert out == [None, None, "repeat", None, None, None, "alternate", None, None, None]


def test_consolidate(spark):
    df = spark.createDataFrame([(1, 1, "open page"), (1, 2, "open"), (1, 3, "then open page two"), (1, 4, "done")], "run_id int, step int, text string")
    assert telemetry.consolidate(df).first().texts == ["then open page two", "done"]


def test_completion_audit(spark):
    obj = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, False)], "run_id int, objective_id int, completed boolean")
    ev = spark.createDataFrame([(1, 1, True), (1, 2, False)], "run_id int, objective_id int, verified boolean")
    got = {r.run_id: (r.satisfied, r.problem, list(r.missing)) for r in telemetry.completion_audit(obj, ev).collect()}
    assert got == {1: (False, "unverified", [2]), 2: (False, "incomplete", [1])}


def test_published_detection_score(spark):
    """17 hits and nothing else gives 100 % everywhere; an unmeasured category stays NULL."""
    counts = [("password", 3), ("email", 2), ("phone", 1), ("credit_card", 2), ("cvv", 1), ("national_id", 2), ("token", 3), ("high_risk_surface", 3)]
    df = spark.createDataFrame([(c, n, 0, 0) for c, n in counts] + [("face", 0, 0, 0)], "category string, tp int, fp int, fn int")
    got = {r.category: r for r in quality.pii_metrics(df).collect()}
    assert (got[None].tp, got[None].recall, got[None].precision, got[None].f1) == (17, 100.0, 100.0, 100.0)
    assert got["face"].recall is None and got["face"].f1 is None


def test_published_run_rates(spark):
    rows = [("expected autonomous success", True, "complete", 1)] * 6 + [("expected user-assisted success", True, "complete", 1)] + [
        ("expected safe abstention", True, "blocked-local-only", 0)] * 2 + [("expected protected denial", True, "denied", 0)] * 2 + [("expected verification failure", True, "failed", 0)]
    df = spark.createDataFrame(rows, "classification string, passed boolean, terminal_state string, n int").selectExpr(
        "*", "array('click') AS interactions", "transform(sequence(1, n), i -> named_struct('executed', true, 'verified', true, 'risk', 'safe')) AS steps")
    df = df.withColumn("steps", F.when(F.col("n") > 0, F.col("steps")).otherwise(F.filter("steps", lambda s: F.lit(False))))
    got = {r.metric: (r.num, r.den, r.rate) for r in quality.run_rates(df).collect()}
    assert got["autonomous_completion"] == (6, 6, 100.0) and got["safe_failure"] == (5, 5, 100.0)
    assert got["abstention"] == (2, 12, 17.0) and got["unsafe_action"] == (0, 0, None)


def test_similarity_join_with_copies(spark):
    a = spark.createDataFrame([(1, "flight price from delhi"), (2, "flight price from delhi"), (3, "weather")], "id int, text string")
    b = spark.createDataFrame([(10, "flight price from mumbai"), (11, "flight price from delhi"), (12, "flight price from mumbai")], "id int, text string")
    got = {r.a_id: (r.b_id, round(r.jaccard, 2)) for r in chat.similarity_join(a, b).collect()}
    assert got == {1: (10, 0.6), 2: (10, 0.6)}


def test_reasoning_lines(spark):
    text = "Observation: page open\nObservation: page open\nStrategy: go left\nStrategy: go right\n- Step 2: page open\n<think>"
    df = spark.createDataFrame([(1, 1, text)], "conv_id int, turn int, text string")
    got = [(r.category, r.body) for r in chat.reasoning_lines(df).orderBy("line").collect()]
    assert got == [("Observation", "Page open"), ("Intent & Strategy", "Go left"), ("Strategy Update", "Go right"), ("", "Page open")]


def test_contracts(spark):
    bad = [("{}", "unsupported_version"), ("[1]", "not_an_object"), ("nope", "not_an_object"),
           ('{"protocolVersion":"1.0","message":"hi","extra":1}', "unknown_property"), ('{"protocolVersion":"1.0","message":"<script>x"}', "invalid_message"),
           ('{"protocolVersion":"1.0","message":"hi","maskCount":1.5}', "invalid_mask_count"), ('{"protocolVersion":"1.0","message":"hi","maskCount":null}', "invalid_mask_count"),
           ('{"protocolVersion":"1.0","message":"hi","elements":[{"localId":"#a"}]}', "elements: invalid_local_id"),
           ('{"protocolVersion":"1.0","message":"hi","history":[{"role":"system","content":"x"}]}', "history: invalid_history_role"),
           ('{"protocolVersion":"1.0","message":"hi","maskCount":2,"elements":[{"localId":"a","coarseBounds":[0,0.5,1,1]}]}', None)]
    df = spark.createDataFrame(bad, "j string, want string")
    got = payloads.tag_payloads(df, "j", payloads.CHAT).collect()
    assert [r.reason for r in got] == [r.want for r in got]


def test_similarity_exactly_at_the_threshold(spark):
    from veil.operators import chat

    few, many = " ".join(f"abc{i}" for i in range(7)), " ".join(f"abc{i}" for i in range(70))
    a, b = (spark.createDataFrame([(1, t)], "id int, text string") for t in (few, many))
    assert [r["b_id"] for r in chat.similarity_join(a, b, minimum=0.1).collect()] == [1]


def test_order_statistics_of_any_values(spark):
    rnd = random.Random(5)
    values = {"a": [rnd.uniform(-3, 3) * 10 ** rnd.randrange(-9, 9) for _ in range(301)] + [1e15, -1e300, 0.0, -0.0],
              "b": [7.5] * 40, "c": [float("inf"), 1.0], None: [2.0, -2.0, 0.5, 5e-324]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    places = {"low": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}
    got = {r.k: (r.low, r.mid, r.top) for r in order_statistics(df, ["k"], "v", places).collect()}
    assert got == {k: (sorted(v)[0], sorted(v)[len(v) // 2], sorted(v)[-1]) for k, v in values.items()}
    medians = {r.k: r.median for r in averaging_median(df, ["k"], "v").collect()}
    assert medians["c"] == float("inf") and medians["b"] == 7.5 and medians[None] == (5e-324 + 0.5) / 2
    assert order_statistics(df.limit(0), [], "v", places).collect() == []


def test_order_statistics_of_whole_numbers_and_decimals(spark):
    rnd = random.Random(6)
    whole = [rnd.randrange(-2**62, 2**62) for _ in range(200)] + [2**53, 2**53 + 1, -5, 0]
    df = spark.createDataFrame([(v,) for v in whole], "v bigint")
    at = {f"p{i}": (lambda n, i=i: F.lit(i)) for i in (0, 50, 101, 102, 103, 203)}
    row = order_statistics(df, [], "v", at).first()
    assert [row[f"p{i}"] for i in (0, 50, 101, 102, 103, 203)] == [sorted(whole)[i] for i in (0, 50, 101, 102, 103, 203)]
    near = df.selectExpr("cast(9007199254740992 + pmod(v, 50) / 100 as decimal(30,2)) AS v")
    want = sorted(r.v for r in near.collect())
    row = order_statistics(near, [], "v", at).first()
    assert [row[f"p{i}"] for i in (0, 50, 101, 102, 103, 203)] == [want[i] for i in (0, 50, 101, 102, 103, 203)]


def test_an_outlier_leaves_no_large_step(spark):
    # The children of one prefix are ordered together; most of 20,000 values under one prefix would be one task.
    df = spark.range(20000).selectExpr("id * 1.0D AS v").union(spark.sql("SELECT 1e15D AS v"))
    codes = df.select(F.shiftright(_code("v", "double"), 42).alias("p")).groupBy("p").count()
    assert codes.agg(F.max("count")).first()[0] <= 100
    assert averaging_median(df, [], "v").first().median == 10000.0
