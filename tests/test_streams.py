"""Every stream gives the rows of its batch twin: on its default arguments, and for input in any order within the delay."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veil.operators import scrub, telemetry
from veil.sources import io
from veil.streaming import streams
from tests.conftest import SF

DAY0 = datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture()
def events(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id AS id", "user_id % 3 AS key", "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint) AS ts_ms", "cast(ts as timestamp) AS ts",
        "event_type", "value", "user_id AS tenant_id", "cast(1 as bigint) AS steps")
    path = str(tmp_path / "in")
    e.orderBy("ts").coalesce(1).write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(e.schema).parquet(path)


def run(sdf, name, tmp_path, mode="append"):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return sdf.sparkSession.sql(f"SELECT * FROM {name}")


def in_batches(spark, tmp_path, batches, schema):
    """A stream of one micro-batch a list of rows, and all rows as a table."""
    path = str(tmp_path / "batches")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03d}")
    whole = spark.read.schema(schema).parquet(*[f"{path}/{k:03d}" for k in range(len(batches))])
    return whole, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def shuffled(rows, ts, delay, n, seed=1):
    """``n`` batches; no row comes more than ``delay`` after one that is later than it."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: ts(r) + rng.random() * delay)
    size = -(-len(rows) // n)
    return [rng.sample(b, len(b)) for b in (late[k:k + size] for k in range(0, len(rows), size))]


def state_rows(spark, tmp_path, name):
    """Rows left in all state stores of a query."""
    found = spark.read.format("state-metadata").load(str(tmp_path / name)).collect()
    return found


def last_progress(sdf, name, tmp_path):
    q = sdf.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return sdf.sparkSession.sql(f"SELECT * FROM {name}"), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def requests(n_keys=3, n=400, seed=2):
    rng = random.Random(seed)
    return [(k, k * 10_000 + i, 1_700_000_000_000 + rng.randrange(0, 1_200_000)) for k in range(n_keys) for i in range(n)]


def test_rate_limit_in_any_order_and_state_that_ends(spark, tmp_path):
    rows = requests()
    end = [(None, -1, 1_700_000_000_000 + 86_400_000)]
    batches = [*shuffled(rows, lambda r: r[2], 500_000, 6), end]
    whole, stream = in_batches(spark, tmp_path, batches, "key long, id long, ts_ms long")
    got, left = last_progress(streams.rate_limit_stream(stream, 20), "rl", tmp_path)
    want = {r.id: (r.window_start, r.count_in_window, r.allowed) for r in telemetry.rate_limit(whole.where("key IS NOT NULL"), 20).collect()}
    assert {r.id: (r.window_start, r.count_in_window, r.allowed) for r in got.where("key IS NOT NULL").collect()} == want
    assert got.where("late").count() == 0
    # What is left belongs to the closing row: its minute's size and chunk with their timer.
    assert left <= 6


def test_rate_limit_hot_key_in_one_batch(spark, tmp_path):
    n = 300_000
    base = spark.range(n).selectExpr("7L AS key", "id", "1700000000000 + (id * 7919) % 600000 AS ts_ms")
    path = str(tmp_path / "hot")
    base.coalesce(1).write.parquet(f"{path}/0")
    spark.createDataFrame([(None, -1, 1_700_090_000_000)], "key long, id long, ts_ms long").coalesce(1).write.parquet(f"{path}/1")
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = run(streams.rate_limit_stream(stream, 1000), "hotkey", tmp_path).where("key = 7")
    ticks = sorted((1_700_000_000_000 + (i * 7919) % 600_000 for i in range(n)))
    start, count, starts = None, 0, Counter()
    for t in ticks:
        if start is None or t - start > 60_000:
            start = t
        starts[start] += 1
    assert {r[0]: r[1] for r in got.groupBy("window_start").count().collect()} == dict(starts)
    assert got.where("allowed").count() == 1000 * len(starts) and got.groupBy("window_start").agg(F.max("count_in_window").alias("m"), F.count("*").alias("c")).where("m <> c").count() == 0


def test_rows_of_a_key_wait_together(spark, tmp_path):
    rows = [(1, i, 1_700_000_000_000 + i * 60_000) for i in range(200)]
    _, stream = in_batches(spark, tmp_path, [rows], "key long, id long, ts_ms long")
    _, left = last_progress(streams.rate_limit_stream(stream, 20, delay="1 day"), "tg", tmp_path)
    assert left <= 6  # not a chunk, a size and a timer for each of 200 minutes


def test_late_requests_are_marked(spark, tmp_path):
    t = 1_700_000_000_000
    batches = [[(1, 1, t), (1, 2, t + 1000)], [(1, 3, t + 3_600_000)], [(1, 4, t + 2000), (1, 5, t + 3_600_001)], [(1, 6, t + 2500)], [(None, -1, t + 86_400_000)]]
    _, stream = in_batches(spark, tmp_path, batches, "key long, id long, ts_ms long")
    got = {r.id: (r.late, r.count_in_window, r.allowed) for r in run(streams.rate_limit_stream(stream, 1), "lt", tmp_path).collect()}
    assert got == {1: (False, 1, True), 2: (False, 2, False), 3: (False, 1, True), 5: (False, 2, False), 4: (True, None, None), 6: (True, None, None)}


def actions(seed=3):
    rng = random.Random(seed)
    rows = []
    for run_ in range(4):
        at = DAY0
        for step in range(150):
            at += timedelta(seconds=rng.choice([1, 2, 20, 90]))
            kind = rng.choice(["click", "click", "type", "scroll", "wait"])
            rows.append((f"r{run_}", step, at, kind, rng.choice(["a", "b"]), rng.choice(["x", None]) if kind == "type" else None, None, rng.choice(["up", "down"]) if kind == "scroll" else None, rng.choice([0, 0, 400, None])))
        rows += [(f"r{run_}", 150 + k, at + timedelta(seconds=k + 1), "click", "ab"[k % 2], None, None, None, None) for k in range(6)]
    return rows


ACTION = "run_id string, step long, ts timestamp, kind string, target string, text string, option string, direction string, scroll_dy long"


def test_loops_on_default_arguments(spark, tmp_path):
    end = [(None, 0, DAY0 + timedelta(days=9), "wait", None, None, None, None, None)]
    batches = [*shuffled(actions(), lambda r: r[2].timestamp(), 300, 5), end]
    whole, stream = in_batches(spark, tmp_path, batches, ACTION)
    got, left = last_progress(streams.loop_stream(stream), "lp", tmp_path)
    twin = telemetry.loops(whole.where("run_id IS NOT NULL"), bucket=telemetry.day("ts"))
    want = {(r.run_id, r.step): r.loop_kind for r in twin.collect()}
    assert {(r.run_id, r.step): r.loop_kind for r in got.where("run_id IS NOT NULL").collect()} == want
    kinds = Counter(want.values())
    assert kinds["repeat"] and kinds["alternate"] and got.where("late").count() == 0 and left <= 6
    moved = [r for r in whole.where("kind = 'scroll' AND abs(scroll_dy) > 2").collect()]
    assert moved and all(want[r.run_id, r.step] is None for r in moved)


def test_idle_runs_begin_anew(spark, tmp_path):
    at = [0, 10, 20, 8000, 8010]
    rows = [("r", k, DAY0 + timedelta(seconds=s), "click", "a", None, None, None, None) for k, s in enumerate(at)]
    _, stream = in_batches(spark, tmp_path, [rows, [(None, 0, DAY0 + timedelta(days=1), "wait", None, None, None, None, None)]], ACTION)
    got = {r.step: r.loop_kind for r in run(streams.loop_stream(stream, idle_ms=3_600_000), "idle", tmp_path).where("run_id = 'r'").collect()}
    assert got == {0: None, 1: None, 2: "repeat", 3: None, 4: None}


def test_quota_and_scrub_and_dedup(spark, events, tmp_path):
    batch, stream = events
    want = {r.tenant_id: r.requests for r in batch.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("requests")).collect()}
    got = {r.tenant_id: r.requests for r in run(streams.quota_stream(stream), "qt", tmp_path, "complete").collect()}
    assert got == want
    text = F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@mail.example.com"))
    a = scrub.scrub_free_text(batch.withColumn("text", text), "text").select("id", "text_clean").collect()
    b = run(streams.scrub_stream(stream.withColumn("text", text)).select("id", "text_clean"), "sc", tmp_path).collect()
    assert sorted(a) == sorted(b)
    assert run(streams.dedup_stream(stream.select("ts", "event_type"), ["event_type"], "60 days"), "dd", tmp_path).count() == 5


def test_quota_periods_end(spark, tmp_path):
    rows = [(k % 3, DAY0 + timedelta(days=k), 2) for k in range(40)]
    _, stream = in_batches(spark, tmp_path, [rows[:20], rows[20:], [(None, DAY0 + timedelta(days=900), 0)]], "tenant_id long, ts timestamp, steps long")
    got, left = last_progress(streams.quota_stream(stream, "10 days"), "qp", tmp_path)
    assert got.agg(F.sum("requests"), F.sum("steps")).first()[:] == (40, 80) and left == 1


def test_telemetry_windows_with_late_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(DAY0 + timedelta(seconds=rng.randrange(0, 1500)), rng.choice(["view", "error"]), rng.choice([None, rng.randrange(100) / 4])) for _ in range(900)]
    batches = shuffled(rows, lambda r: r[0].timestamp(), 500, 5)
    after = [(DAY0 + timedelta(seconds=s), "view", 1.0) for s in (5, 6, 65, 66, 67)]
    batches += [[(DAY0 + timedelta(hours=3), "view", None)], after[:3], after[3:], [(DAY0 + timedelta(days=2), "end", None)]]
    whole, stream = in_batches(spark, tmp_path, batches, "ts timestamp, event_type string, value double")
    got, left = last_progress(streams.telemetry_stream(stream), "tm", tmp_path)
    totals = {(r.window_start, r.event_type): (r.n, r.p50, r.p95, r.errors, r.late) for r in streams.telemetry_totals(got).where("event_type <> 'end'").collect()}
    table = spark.createDataFrame([r for b in batches[:5] for r in b] + batches[5], whole.schema)
    want = {(r.window_start, r.event_type): (r.n, r.p50, r.p95, r.errors, {0: 2, 1: 3}.get((r.window_start - DAY0).seconds // 60 if r.event_type == "view" and r.window_start < DAY0 + timedelta(hours=1) else 9, 0))
            for r in telemetry.windows(table).collect()}
    assert totals == want
    assert left <= 4  # of the closing window only


def test_audit(spark, events, tmp_path):
    batch, stream = events
    out, roll = str(tmp_path / "audit"), str(tmp_path / "roll")
    q = streams.audit_stream(stream.selectExpr("id AS event_id", "ts", "event_type AS category"), out, str(tmp_path / "c"), roll).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == batch.count()
    assert spark.read.parquet(roll).agg(F.sum("n")).first()[0] == batch.count()
    assert io.read_audit(spark, out, 7).count() == 7
