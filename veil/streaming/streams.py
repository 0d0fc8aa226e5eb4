"""Structured Streaming twins of the batch jobs.

The stateful ones (Z2-Z4) settle rows in event time: input may come in any order within the watermark's delay and gives the rows of
the batch twin, in micro-batches of any size. Rows of a key wait in the state store as Arrow blobs of at most one input
chunk each, so that a batch with very many rows of one key is never one object; an event-time timer settles the minutes that are over. Rows
that come after their minute (or window) was settled are not dropped: they are returned at once, marked ``late``. State of a key
ends with a timer, too: nothing is left when its window, its run or its tumbling window is over.

They need the RocksDB state store (:data:`ROCKSDB`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veil.functions.urls import free_text_col
from veil.operators.telemetry import LOOP_EXEMPT, WINDOW_MS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_US = 60_000_000
SLICE = 50_000
# Rows of one key that are held at once while its chunks are put in order, about.
OVERLAP = 200_000
# What identifies an action, and what identifies it within a cycle.
IDENT, CYCLE = ("kind", "target", "text", "option", "direction"), ("kind", "target", "text")


def with_event_time(sdf: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """``timestamp_ntz`` cannot carry a watermark; read it in the session zone."""
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _kept_when_late(sdf: DataFrame, ts: Column, delay: str, *cols: Column) -> DataFrame:
    """``cols`` and ``us`` (microseconds) of a stream with a watermark on ``ts``.

    Names start with a letter, as rows reach the processor as named tuples. The watermark counts, but the column that carries it is not passed on, so Spark does not drop late rows before an operator sees them.
    """
    timed = sdf.withColumn("_et", ts.cast("timestamp")).withWatermark("_et", delay)
    return timed.select(*cols, F.unix_micros("_et").alias("us")).where("us IS NOT NULL")


def scrub_stream(sdf: DataFrame, col: str = "text", out: str = "text_clean") -> DataFrame:
    """Stateless."""
    return sdf.withColumn(out, free_text_col(f"`{col}`"))


class TelemetryWindows(StatefulProcessor):
    """Rows, errors, and values with their counts of one tumbling window and type."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n long, errors long")
        self.values = handle.getListState("values", "value double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end, mark, late, more = key[1], timerValues.getCurrentWatermarkInMs() * 1000, 0, False
        n, errors = self.totals.get() if self.totals.exists() else (0, 0)
        for part in filter(len, rows):
            if end <= mark:
                late += len(part)
                continue
            more = True
            n, errors = n + len(part), errors + int(part["is_error"].sum())
            found, counts = np.unique(part["value"].dropna().to_numpy(dtype=np.float64), return_counts=True)
            if len(found):
                self.values.appendList([(float(v), int(c)) for v, c in zip(found, counts)])
        if late:
            yield self._row(key, 0, None, None, 0, late)
        if more:
            self.totals.update((n, errors))
            self.handle.registerTimer(-(-end // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            n, errors = self.totals.get()
            pairs = np.array(list(self.values.get()), dtype=np.float64).reshape(-1, 2) if self.values.exists() else np.zeros((0, 2))
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            ranks, of = np.cumsum(pairs[:, 1]), lambda share: float(pairs[np.searchsorted(ranks, share * ranks[-1] - 1e-9), 0]) if len(pairs) else None
            yield self._row(key, n, of(0.5), of(0.95), errors, 0)
            self.totals.clear()
            self.values.clear()

    @staticmethod
    def _row(key, n, p50, p95, errors, late) -> pd.DataFrame:
        return pd.DataFrame({"start_us": [key[0]], "kind_": [key[2]], "n": [n], "p50": pd.array([p50], dtype="Float64"), "p95": pd.array([p95], dtype="Float64"), "errors": [errors], "late": [late]})

    def close(self) -> None:
        pass


def telemetry_stream(sdf: DataFrame, window: str = "1 minute", delay: str = "10 minutes", kind: str = "event_type",
                     value: str = "value", error: str = "error") -> DataFrame:
    """Per window and type, once the watermark has passed it: rows, exact p50 and p95 (:func:`telemetry.windows`), errors.

    Rows that come later are counted: each batch with some adds a row of its window with their number in ``late`` and zeros elsewhere.
    :func:`telemetry_totals` adds these up.
    """
    timed = _kept_when_late(sdf, F.col("ts"), delay, F.col(kind).cast("string").alias("kind_"), F.col(value).cast("double").alias("value"),
                            F.coalesce(F.col(kind) == error, F.lit(False)).cast("int").alias("is_error"))
    spans = timed.withColumn("_w", F.window(F.timestamp_micros("us"), window))
    keyed = spans.select(F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_w.end").alias("end_us"), "kind_", "value", "is_error")
    found = keyed.groupBy("start_us", "end_us", "kind_").transformWithStateInPandas(
        statefulProcessor=TelemetryWindows(), outputStructType="start_us long, kind_ string, n long, p50 double, p95 double, errors long, late long",
        outputMode="Append", timeMode="EventTime")
    return found.select(F.timestamp_micros("start_us").alias("window_start"), F.col("kind_").alias(kind), "n", "p50", "p95", "errors", "late")


def telemetry_totals(rows: DataFrame, kind: str = "event_type") -> DataFrame:
    """One row per window and type of what :func:`telemetry_stream` returned."""
    return rows.groupBy("window_start", kind).agg(F.sum("n").alias("n"), F.max("p50").alias("p50"), F.max("p95").alias("p95"), F.sum("errors").alias("errors"), F.sum("late").alias("late"))


class InOrder(StatefulProcessor):
    """Settles the rows of a key in the order of ``us`` and ``order``, whole minutes at a time, once the watermark has passed them.

    A part of the input waits as one chunk under its first minute and its number, or, where it has many rows, as several of whole
    minutes each: the more chunks wait, the fewer rows each gets, so that chunks that overlap stay small together. Of a chunk that is
    due in part, the rest waits on in two halves, so a row is written anew a few times only.
    """

    order: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "parts long, waiting long")
        self.chunks = handle.getMapState("chunks", "minute long, at long", "rows binary")
        self.begin(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        settled, made = timerValues.getCurrentWatermarkInMs() * 1000 // MINUTE_US, None
        for part in filter(len, rows):  # a key whose timer is due comes with an empty part
            late = (part["us"] // MINUTE_US < settled).to_numpy()
            if late.any():
                yield self.late(key, part[late])
            if not late.all():
                parts, waiting = made or (self.made.get() if self.made.exists() else (0, 0))
                minutes = self.wait(part[~late], parts, max(1, OVERLAP // max(waiting, 100)))
                made = parts + 1, waiting + len(minutes)
                self.handle.registerTimer((minutes[0] + 1) * MINUTE_US // 1000)
        if made:
            self.made.update(made)

    def wait(self, rows: pd.DataFrame, at: int, least: int) -> list[int]:
        """Writes chunks of ``least`` rows or more and whole minutes; returns their first minutes."""
        rows = rows.sort_values(["us", *self.order], kind="stable")
        minute, i, first = rows["us"].to_numpy() // MINUTE_US, 0, []
        while i < len(minute):
            j = int(np.searchsorted(minute, minute[min(i + least, len(minute)) - 1], side="right"))
            batch = pa.RecordBatch.from_pandas(rows.iloc[i:j], preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            first.append(int(minute[i]))
            self.chunks.updateValue((first[-1], at), (sink.getvalue().to_pybytes(),))
            i = j
        return first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        settled, waiting = mark * 1000 // MINUTE_US, sorted(tuple(c) for c in self.chunks.keys())
        due = [c for c in waiting if c[0] < settled]
        held, n, most = [], 0, OVERLAP
        for i, chunk in enumerate(due):
            held.append(pa.ipc.open_stream(self.chunks.getValue(chunk)[0]).read_all().to_pandas().assign(at_=chunk[1]))
            self.chunks.removeKey(chunk)
            n += len(held[-1])
            if i + 1 < len(due) and n < most:
                continue
            whole = pd.concat(held).sort_values(["us", *self.order, "at_"], kind="stable")
            # Rows before the first minute of the next chunk are complete.
            cut = int(np.searchsorted(whole["us"].to_numpy() // MINUTE_US, due[i + 1][0] if i + 1 < len(due) else settled))
            if cut:
                yield from self.settle(key, whole.iloc[:cut].drop(columns="at_"))
            held, n = [whole.iloc[cut:]], len(whole) - cut
            most = 2 * n + OVERLAP
        if due:
            left = [m for m, _ in waiting[len(due):]]
            for at, rest in held[0].groupby("at_"):
                left += self.wait(rest.drop(columns="at_"), int(at), -(-len(rest) // 2))
            if left:
                self.made.update((self.made.get()[0], len(left)))
                self.handle.registerTimer((min(left) + 1) * MINUTE_US // 1000)
            else:
                self.made.clear()
        ends = self.ends()
        if ends is not None and ends <= mark:
            self.forget()
        elif ends is not None:
            self.handle.registerTimer(ends)

    def close(self) -> None:
        pass


class RateLimiter(InOrder):
    """Window start and count per key; the window is 60 seconds from its first request."""

    order = ["id"]

    def __init__(self, per_min: int):
        self.per_min = per_min

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start long, n long")

    def ends(self) -> int | None:
        # No row that is not late can still fall into the window then.
        return self.window.get()[0] + 2 * WINDOW_MS + 1 if self.window.exists() else None

    def forget(self) -> None:
        self.window.clear()

    def late(self, key, part: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.array([None] * len(part), dtype="Int64")
        return pd.DataFrame({"key": [key[0]] * len(part), "id": part["id"].to_numpy(), "ts_ms": part["us"].to_numpy() // 1000, "window_start": nothing, "count_in_window": nothing, "allowed": pd.array([None] * len(part), dtype="boolean"), "late": True})

    def settle(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ts, ids = rows["us"].to_numpy() // 1000, rows["id"].to_numpy()
        start, n = self.window.get() if self.window.exists() else (None, 0)
        starts, counts, i = np.empty(len(ts), dtype=np.int64), np.empty(len(ts), dtype=np.int64), 0
        while i < len(ts):  # a turn a window, not a row
            if start is None or ts[i] - start > WINDOW_MS:
                start, n = int(ts[i]), 0
            j = int(np.searchsorted(ts, start + WINDOW_MS, side="right"))
            starts[i:j], counts[i:j] = start, n + np.arange(1, j - i + 1)
            n, i = n + j - i, j
        self.window.update((start, n))
        for at in range(0, len(ts), SLICE):
            s = slice(at, at + SLICE)
            yield pd.DataFrame({"key": [key[0]] * len(ts[s]), "id": ids[s], "ts_ms": ts[s], "window_start": starts[s], "count_in_window": counts[s], "allowed": (counts[s] == 1) | (counts[s] <= self.per_min), "late": False})


def rate_limit_stream(sdf: DataFrame, per_min: int, delay: str = "10 minutes") -> DataFrame:
    """Z3: ``sdf(key, id, ts_ms)``. A late request has no window and no verdict."""
    kt = sdf.schema["key"].dataType.simpleString()
    return _kept_when_late(sdf, F.timestamp_millis("ts_ms"), delay, F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id")).groupBy("key").transformWithStateInPandas(
        statefulProcessor=RateLimiter(per_min),
        outputStructType="key string, id long, ts_ms long, window_start long, count_in_window long, allowed boolean, late boolean",
        outputMode="Append", timeMode="EventTime").withColumn("key", F.col("key").cast(kt))


class LoopDetector(InOrder):
    """The last four actions of a run and the time of the last one; a run without an action for ``idle_ms`` begins anew."""

    order = ["step"]

    def __init__(self, idle_ms: int):
        self.idle_us = idle_ms * 1000

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "us array<bigint>, ident array<string>, cycle array<string>")

    def ends(self) -> int | None:
        return (self.recent.get()[0][-1] + self.idle_us) // 1000 + MINUTE_US // 1000 + 1 if self.recent.exists() else None

    def forget(self) -> None:
        self.recent.clear()

    def late(self, key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]] * len(part), "step": part["step"].to_numpy(), "is_loop": pd.array([None] * len(part), dtype="boolean"), "loop_kind": None, "late": True})

    def settle(self, key, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        us, ident, cycle = (list(v) for v in self.recent.get()) if self.recent.exists() else ([], [], [])
        old = len(us)
        us, ident, cycle = np.array([*us, *rows["us"]], dtype=np.int64), np.array([*ident, *rows["ident"]], dtype=object), np.array([*cycle, *rows["cycle"]], dtype=object)
        # How many actions before each one belong to the same stretch.
        fresh = np.append(True, np.diff(us) > self.idle_us)
        behind = np.arange(len(us)) - np.maximum.accumulate(np.where(fresh, np.arange(len(us)), 0))

        def same(what: np.ndarray, a: int, b: int) -> np.ndarray:
            out = np.zeros(len(us), dtype=bool)
            if len(us) > b:
                out[b:] = what[b - a:len(us) - a] == what[:len(us) - b]
            return out & (behind >= b)

        repeat = same(ident, 0, 1) & same(ident, 0, 2)
        alternate = same(cycle, 0, 2) & same(cycle, 0, 4) & same(cycle, 1, 3)
        free = np.append(np.ones(old, dtype=bool), rows["exempt"].to_numpy(dtype=bool))
        looped = (~free & (repeat | alternate))[old:]
        kinds = np.where(looped, np.where(repeat[old:], "repeat", "alternate"), None)
        self.recent.update((us[-4:].tolist(), ident[-4:].tolist(), cycle[-4:].tolist()))
        for at in range(0, len(rows), SLICE):
            s = slice(at, at + SLICE)
            yield pd.DataFrame({"run_id": [key[0]] * len(looped[s]), "step": rows["step"].to_numpy()[s], "is_loop": looped[s], "loop_kind": kinds[s], "late": False})


def loop_stream(sdf: DataFrame, delay: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """``sdf(run_id, step, ts, kind, target)``, and ``text, option, direction, scroll_dy`` where there are such columns."""
    kt = sdf.schema["run_id"].dataType.simpleString()
    sig = lambda cols: F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string") if c in sdf.columns else F.lit(None).cast("string"), F.lit("\u0000")) for c in cols])
    exempt = F.coalesce(F.col("kind").isin(*LOOP_EXEMPT), F.lit(False))
    if "scroll_dy" in sdf.columns:
        exempt = exempt | F.coalesce((F.col("kind") == "scroll") & (F.abs(F.col("scroll_dy")) > 2), F.lit(False))
    return _kept_when_late(sdf, F.col("ts"), delay, F.col("run_id").cast("string").alias("run_id"), F.col("step").cast("long").alias("step"), sig(IDENT).alias("ident"), sig(CYCLE).alias("cycle"), exempt.alias("exempt")).groupBy(
        "run_id").transformWithStateInPandas(
        statefulProcessor=LoopDetector(idle_ms), outputStructType="run_id string, step long, is_loop boolean, loop_kind string, late boolean",
        outputMode="Append", timeMode="EventTime").withColumn("run_id", F.col("run_id").cast(kt))


def quota_stream(sdf: DataFrame, period: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Requests and steps used per tenant; run in update mode. With a ``period`` (``"30 days"``) per tenant and period, whose state ends with it."""
    used = [F.count(F.lit(1)).alias("requests"), F.sum("steps").alias("steps")]
    if period is None:
        return sdf.groupBy("tenant_id").agg(*used)
    spans = with_event_time(sdf, "ts", delay).groupBy(F.window("ts", period), "tenant_id").agg(*used)
    return spans.select(F.col("window.start").alias("period_start"), "tenant_id", "requests", "steps")


def dedup_stream(sdf: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Z6."""
    return with_event_time(sdf, "ts", delay).dropDuplicatesWithinWatermark(keys)


def audit_stream(sdf: DataFrame, path: str, checkpoint: str, rollup: str | None = None):
    """Append to Parquet and, per batch, counts per category under the batch id (a repeat replaces itself)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if rollup:
            batch.groupBy("category").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
                f"{rollup}/batch_id={batch_id}")

    return sdf.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
