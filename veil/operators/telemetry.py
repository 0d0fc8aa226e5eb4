"""Run, tenant, cache and audit analytics.

Running values over a key use :mod:`veil.functions.ordered`, which splits a key by time, so one
busy user or tenant does not end up in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.ordered import lagged, running
from veil.functions.rules import BL, BR, WS
from veil.functions.urls import clean_url_col, free_text_col
from veil.functions.util import first_match, trim_ws

WINDOW_MS = 60_000


def day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def state_delta(captures: DataFrame, clean: bool = False) -> DataFrame:
    """Change against the previous capture of a run.

    ``captures(run_id, step, url, n_elements, scroll_top, local_ids[], message)``. ``added`` and ``removed``
    are the published net counts; ``ids_added`` and ``ids_removed`` compare the element ids themselves.
    """
    cols = ["url", "n_elements", "scroll_top", "local_ids"]
    prev = lagged(captures, ["run_id"], F.floor(F.col("step") / 1000), ["step"], cols).filter("lag1_n_elements IS NOT NULL")
    added = F.greatest(F.lit(0), F.col("n_elements") - F.col("lag1_n_elements"))
    changed = F.coalesce(F.col("url") != F.col("lag1_url"), F.lit(False))
    out = prev.withColumn("url_changed", changed).withColumn("added", added).withColumn(
        "removed", F.greatest(F.lit(0), F.col("lag1_n_elements") - F.col("n_elements"))).withColumn(
        "ids_added", F.size(F.array_except("local_ids", "lag1_local_ids"))).withColumn(
        "ids_removed", F.size(F.array_except("lag1_local_ids", "local_ids"))).withColumn(
        "scroll_dy", F.coalesce("scroll_top", F.lit(0)) - F.coalesce("lag1_scroll_top", F.lit(0)))
    shown = clean_url_col("url") if clean else F.col("url")
    outcome = (F.when(F.col("url_changed"), F.concat(F.lit("Page navigated to "), shown))
               .when(F.col("added") > 5, F.concat(F.lit("UI updated: "), F.col("added"), F.lit(" new elements rendered")))
               .otherwise(F.coalesce("message", F.lit("Action executed"))))
    out = out.withColumn("outcome", outcome)
    if clean:
        out = out.withColumn("outcome", free_text_col("outcome"))
    return out.select("run_id", "step", "url_changed", "added", "removed", "ids_added", "ids_removed", "scroll_dy", "outcome")


# Action kinds that never count as a loop.
LOOP_EXEMPT = ("finish", "wait", "batch", "request_user_input")


def loops(actions: DataFrame, key: str = "run_id", order=("ts", "step"), bucket: Column | None = None,
          ident=("kind", "target", "text", "option", "direction"), cycle=("kind", "target", "text")) -> DataFrame:
    """Add ``is_loop, loop_kind``: the same action three times, or A,B,A,B,A.

    Optional column ``scroll_dy``: a scroll that moved the page is no loop.
    """
    order = list(order)
    sig = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ident])
    cyc = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cycle])
    staged = actions.withColumn("_sig", sig).withColumn("_cyc", cyc)
    prev = lagged(staged, [key], bucket if bucket is not None else F.floor(F.col(order[0]) / 1000), order, ["_sig", "_cyc"], 4)
    exempt = F.col("kind").isin(*LOOP_EXEMPT)
    if "scroll_dy" in actions.columns:
        exempt = exempt | ((F.col("kind") == "scroll") & (F.abs(F.coalesce("scroll_dy", F.lit(0))) > 2))
    repeat = (F.col("_sig") == F.col("lag1__sig")) & (F.col("_sig") == F.col("lag2__sig"))
    alternate = ((F.col("_cyc") == F.col("lag2__cyc")) & (F.col("_cyc") == F.col("lag4__cyc"))
                 & (F.col("lag1__cyc") == F.col("lag3__cyc")))
    kind = F.when(~exempt & F.coalesce(repeat, F.lit(False)), F.lit("repeat")).when(
        ~exempt & F.coalesce(alternate, F.lit(False)), F.lit("alternate"))
    return prev.withColumn("loop_kind", kind).withColumn("is_loop", F.col("loop_kind").isNotNull()).select(
        *actions.columns, "is_loop", "loop_kind")


def cumulative(steps: DataFrame, key: str, order: list[str], bucket: Column, columns: dict[str, str]) -> DataFrame:
    """Running sums; ``columns`` maps an output name to the summed column."""
    return running(steps, [key], bucket, order, {o: (F.col(c), "sum") for o, c in columns.items()})


def cumulative_latency(steps: DataFrame) -> DataFrame:
    return cumulative(steps, "run_id", ["step"], F.floor(F.col("step") / 1000),
                      {"client_cum": "client_ms", "server_cum": "server_ms"})


# Stage names between the eight time marks.
STAGES = ("capture", "detection", "sanitization", "reasoning", "validation", "execution", "verification")


def stage_durations(telemetry: DataFrame) -> DataFrame:
    """One row per stage t0..t7."""
    return telemetry.select("run_id", F.explode(F.array(*[F.struct(
        F.lit(n).alias("stage"), (F.col(f"t{i + 1}") - F.col(f"t{i}")).alias("ms")) for i, n in enumerate(STAGES)])).alias("_s")
    ).select("run_id", "_s.stage", "_s.ms")


def windows(events: DataFrame, window: str = "1 minute", kind: str = "event_type", value: str = "value", error: str = "error") -> DataFrame:
    """Z2 in batch: per tumbling window and type the rows, the smallest values that half and 95 % of the values reach, and errors."""
    at = lambda share: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)")
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), window), kind).agg(
        F.count(F.lit(1)).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.count_if(F.col(kind) == error).alias("errors")).select(
        F.col("window.start").alias("window_start"), kind, "n", "p50", "p95", "errors")


# --- rate limiting --------------------------------------------------------------------

def rate_limit(requests: DataFrame, per_min, key: str = "key", ts_ms: str = "ts_ms", ident: str = "id") -> DataFrame:
    """Add ``window_start, count_in_window, allowed``.

    A window starts at a key's first request and ends with the first request more than 60 seconds
    later, which starts the next one. ``per_min`` is a number or a column name. Requests without a key or time are left out.

    A stretch of requests is a step function from the window start it is entered with to the one it is left with. An hour of a
    key is solved for every start it can be entered with (only its first minute's requests make a difference); functions of ``FAN`` neighbouring
    stretches are composed to one, level by level, and what each stretch is really entered with comes back down the same tree. So
    the requests of a key are dealt out by the hour, whatever their number, and no step holds a key as a whole.
    """
    kt = requests.schema[key].dataType.simpleString()
    stamped = requests.withColumn("_t", F.col(ts_ms).cast("long"))
    ticks = stamped.select(F.col(key).alias("key"), "_t", F.floor(F.col("_t") / HOUR_MS).alias("_b")).where("key IS NOT NULL AND _t IS NOT NULL").distinct()
    steps, states = f"key {kt}, _b long, _entry array<long>, _exit array<long>, _max long", f"key {kt}, _b long, _in long"
    hours = ticks.repartition("key", "_b").select("key", "_b", "_t")
    levels = [_neighbours(hours.sortWithinPartitions("key", "_b", "_t").mapInArrow(_outlines, steps))]
    for _ in range(LEVELS):
        levels.append(_neighbours(levels[-1].sortWithinPartitions("key", "_p", "_b").mapInArrow(_composed, steps)))
    # Above the last level a key has one row for every few months of requests.
    top = levels.pop().withColumn("_p", F.lit(0).cast("long")).withColumn("_in", F.lit(NEVER))
    entered = top.repartition("key").sortWithinPartitions("key", "_b").mapInArrow(_entered, states)
    for level in reversed(levels):
        known = entered.select("key", F.col("_b").alias("_p"), "_in")
        entered = level.join(known, ["key", "_p"]).select("key", "_p", "_b", "_entry", "_exit", "_max", "_in").sortWithinPartitions("key", "_p", "_b").mapInArrow(_entered, states)
    placed = hours.join(entered, ["key", "_b"]).select("key", "_b", "_t", "_in").sortWithinPartitions("key", "_b", "_t").mapInArrow(_starts, f"key {kt}, _t long, window_start long")
    joined = stamped.join(placed.withColumnRenamed("key", key), [key, "_t"])
    w = Window.partitionBy(key, "window_start").orderBy("_t", ident)
    limit = F.col(per_min) if isinstance(per_min, str) else F.lit(per_min)
    return joined.withColumn("count_in_window", F.row_number().over(w)).withColumn(
        "allowed", (F.col("count_in_window") == 1) | (F.col("count_in_window") <= limit)).drop("_t")


HOUR_MS, FAN, LEVELS = 3_600_000, 64, 2
NEVER = -(1 << 62)  # the window start of a key without requests so far
# A stretch that is entered so that its first own window starts after _entry[i - 1] and at _entry[i] or before is left with _exit[i]; a
# window that lasts to _max or longer goes on.
_STEP = {"_b": pa.int64(), "_entry": pa.list_(pa.int64()), "_exit": pa.list_(pa.int64()), "_max": pa.int64()}


def _neighbours(steps: DataFrame) -> DataFrame:
    return steps.select("key", F.floor(F.col("_b") / FAN).alias("_p"), "_b", "_entry", "_exit", "_max").repartition("key", "_p")


class _Sorted:
    """Sorted batches, read by stretches of equal first two columns: a key of any type, and a number."""

    def __init__(self, batches):
        self.batches, self.kind = batches, None

    def __iter__(self):
        held, rest = None, []
        for batch in self.batches:
            self.kind = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            keys = [c.to_pylist() for c in batch.columns[:2]]
            edges = [0, *[i for i in range(1, batch.num_rows) if any(c[i] != c[i - 1] for c in keys)], batch.num_rows]
            for first, end in zip(edges, edges[1:]):
                at = tuple(c[first] for c in keys)
                if held is not None and at != held:
                    yield held, [pa.concat_arrays(c) for c in zip(*rest)]
                    rest = []
                held = at
                rest.append([c.slice(first, end - first) for c in batch.columns[2:]])
        if held is not None:
            yield held, [pa.concat_arrays(c) for c in zip(*rest)]

    def frames(self, rows, types: dict, size: int = 100_000):
        """Rows (key, numbers or arrays of them) as batches of about ``size`` numbers."""
        part, n = [], 0
        for row in rows:
            part.append(row)
            n += sum(len(v) if isinstance(v, np.ndarray) else 1 for v in row[1:])
            if n >= size:
                yield self._batch(part, types)
                part, n = [], 0
        if part:
            yield self._batch(part, types)

    def _batch(self, part, types: dict):
        columns = list(zip(*part))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], self.kind), *[pa.array(c, t) for c, t in zip(columns[1:], types.values())]], ["key", *types])


def _outlines(batches):
    rows = _Sorted(batches)

    def solved():
        for (key, hour), (t,) in rows:
            ts = t.to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(ts, hour * HOUR_MS + WINDOW_MS, side="right"))
            after = np.searchsorted(ts, ts + WINDOW_MS, side="right")
            last = np.where(after < len(ts), after, np.arange(len(ts)))
            while (last[last] != last).any():  # doubling: where the chain of windows from each request ends
                last = last[last]
            leave = ts[last[: first + 1]]
            keep = np.append(leave[1:] != leave[:-1], True)  # only the last entry of a run with one outcome
            yield key, hour, ts[: first + 1][keep], leave[keep], int(ts[-1])

    return rows.frames(solved(), _STEP)


def _led(entry: np.ndarray, leave: np.ndarray, most: int, start):
    """Where a stretch that is entered with window start ``start`` (one or several) is left."""
    at = np.minimum(np.searchsorted(entry, np.asarray(start) + WINDOW_MS, side="right"), len(entry) - 1)
    return np.where(most > np.asarray(start) + WINDOW_MS, leave[at], start)


def _each(columns: list):
    """Of each row: its number and its step function."""
    for b, entry, leave, most in zip(columns[0].to_pylist(), columns[1], columns[2], columns[3].to_pylist()):
        yield b, entry.values.to_numpy(zero_copy_only=False), leave.values.to_numpy(zero_copy_only=False), most


def _composed(batches):
    rows = _Sorted(batches)

    def solved():
        for (key, parent), columns in rows:
            entry = leave = most = None
            for _, e, x, m in _each(columns):
                if entry is None:
                    entry, leave, most = e, x, m
                    continue
                entry, leave, most = np.concatenate([entry, e]), np.concatenate([_led(e, x, m, leave), x]), m
                keep = np.append(leave[1:] != leave[:-1], True)
                entry, leave = entry[keep], leave[keep]
            yield key, parent, entry, leave, most

    return rows.frames(solved(), _STEP)


def _entered(batches):
    rows = _Sorted(batches)

    def solved():
        for (key, _), columns in rows:
            start = columns[4][0].as_py()
            for b, e, x, m in _each(columns):
                yield key, b, start
                start = int(_led(e, x, m, start))

    return rows.frames(solved(), {"_b": pa.int64(), "_in": pa.int64()})


def _starts(batches):
    rows = _Sorted(batches)

    def solved():
        for (key, _), (t, entered) in rows:
            ts, start, i = t.to_numpy(zero_copy_only=False), entered[0].as_py(), 0
            while i < len(ts):  # a turn a window
                if ts[i] - start > WINDOW_MS:
                    start = int(ts[i])
                j = int(np.searchsorted(ts, start + WINDOW_MS, side="right"))
                for at in ts[i:j].tolist():
                    yield key, at, start
                i = j

    return rows.frames(solved(), {"_t": pa.int64(), "window_start": pa.int64()})


# --- retention, replay, upsert ------------------------------------------------------------

def keep_latest(df: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """Newest ``n`` rows per key (or overall). Spark keeps ``n`` per task before it shuffles."""
    newest = [F.desc(c) for c in order]
    if not keys:
        return df.orderBy(*newest).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(
        F.col("_r") <= n).drop("_r")


# Words that ask for a fresh answer; verbs that carry a parameter.
BYPASS = rf"(?i){BL}(?:fresh|re-think|rethink|deep\s*think|no\s*cache|nocache|clear\s*cache){BR}"
PARAMETER = rf"(?i)^(?:please|can you|kindly)?\s*(?:search for|find|lookup|type|enter){WS}+(.+)\z"


def normalize_intent_col(col: Column) -> Column:
    """Lower case without a polite opening or separators."""
    out = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), rf"^(?:please|can you|kindly){WS}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[_\-:*()\[\]/\\]", " "), rf"{WS}+", " "))


def cache_replay(requests: DataFrame) -> DataFrame:
    """Add ``is_hit, param_hit`` for a cache that stores every miss.

    ``requests(ts, id, domain, path, goal, layout, kind)``. A request hits when its key was seen before;
    bypass words force a miss; a parameterised goal may reuse an earlier ``type`` action of the same
    domain and layout. Only "was there an earlier one" matters, so first sights are plain minima and no
    key is ever ordered as a whole.
    """
    keyed = requests.withColumn("_k", F.concat_ws("\u0001", "domain", "path", normalize_intent_col(F.col("goal")), "layout"))
    at = F.struct("ts", "id")
    first = keyed.groupBy("_k").agg(F.min(at).alias("_first"))
    typed = keyed.filter("kind = 'type'").groupBy("domain", "layout").agg(F.min(at).alias("_typed"))
    j = keyed.join(first, "_k").join(typed, ["domain", "layout"], "left")
    bypass = F.coalesce(F.col("goal").rlike(BYPASS), F.lit(False))
    hit = ~bypass & (at > F.col("_first"))
    param = ~bypass & ~hit & F.col("goal").rlike(PARAMETER) & F.coalesce(F.col("_typed") < at, F.lit(False))
    return j.withColumn("is_hit", hit | param).withColumn("param_hit", param).select(*requests.columns, "is_hit", "param_hit")


# What one cache hit saves.
TOKENS_PER_HIT, MS_PER_HIT = 4_200, 11_500


def cache_savings(replay: DataFrame, by=()) -> DataFrame:
    """A13."""
    hits = F.count_if("is_hit")
    return replay.groupBy(*by).agg(hits.alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"),
                                   (hits * TOKENS_PER_HIT).alias("tokens_saved"), (hits * MS_PER_HIT).alias("ms_saved"))


def transitions(states: DataFrame, key: str, order: list[str], bucket: Column, state: str = "state") -> DataFrame:
    """``key, prev, curr, ts``."""
    prev = lagged(states, [key], bucket, order, [state])
    return prev.filter(F.col(f"lag1_{state}").isNotNull()).select(
        key, F.col(f"lag1_{state}").alias("prev"), F.col(state).alias("curr"), *order)


def transition_matrix(moves: DataFrame) -> DataFrame:
    return moves.groupBy("prev", "curr").agg(F.count(F.lit(1)).alias("n"))


# Roles that make up a page's layout signature.
LAYOUT_ROLES = ("input", "button", "textarea", "select", "link")


def interactive(elements: DataFrame) -> DataFrame:
    """P6."""
    return elements.filter(F.col("role").isin(*LAYOUT_ROLES))


def layout_signature(elements: DataFrame, key: str = "capture_id", order: str = "seq", n: int = 15) -> DataFrame:
    """``role:name`` of the first interactive elements, names cut to 20 characters."""
    entry = F.concat(F.col("role"), F.lit(":"), F.substring(trim_ws(F.lower(F.coalesce("name", F.lit("")))), 1, 20))
    first = interactive(elements).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(
        F.col("_r") <= n)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", entry.alias("e")))).alias("_e")).select(
        key, F.array_join(F.transform("_e", lambda x: x["e"]), "|").alias("signature"))


def layout_drift(captures: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Captures whose signature differs from the previous one of the same URL."""
    prev = lagged(captures, [key], bucket, order, ["signature"])
    return prev.withColumn("changed", F.coalesce(F.col("signature") != F.col("lag1_signature"), F.lit(False))).drop("lag1_signature")


def upsert_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: every column's newest non-NULL value; ``first_at`` and ``last_used`` times."""
    at = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest],
        F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_used"))


def consolidate(steps: DataFrame, key: str = "run_id", order: str = "step", text: str = "text") -> DataFrame:
    """``key, texts[]``: a text contained in a kept one is dropped, a longer one replaces the first it contains.

    A run's steps decide in order, so a run is one fold.
    """
    packed = steps.filter(trim_ws(F.col(text)) != "").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), trim_ws(F.col(text)).alias("t")))),
                    lambda x: x["t"]).alias("_t"))
    fold = F.expr("""aggregate(_t, cast(array() as array<string>), (acc, t) ->
        CASE WHEN exists(acc, p -> contains(p, t)) THEN acc
             WHEN exists(acc, p -> contains(t, p)) THEN
               transform(acc, (p, i) -> CASE WHEN i + 1 = array_position(transform(acc, q -> contains(t, q)), true) THEN t ELSE p END)
             ELSE concat(acc, array(t)) END)""")
    return packed.select(key, fold.alias("texts"))


# --- tenants ---------------------------------------------------------------------------------

def authorize(requests: DataFrame, tenants: DataFrame, small_tenants: bool = False) -> DataFrame:
    """Add ``status, error``: 401 without or with an unknown key, 403 inactive, 429 no steps left, 200.

    ``requests(key, ..)``; ``tenants(key, tenant_id, active, remaining)``. ``small_tenants`` broadcasts the
    tenant table; say so only when its size is known.
    """
    side = tenants.select(trim_ws(F.col("key")).alias("_tk"), "tenant_id", "active", "remaining")
    if small_tenants:
        side = F.broadcast(side)
    j = requests.withColumn("_rk", trim_ws(F.col("key"))).join(side, F.col("_rk") == F.col("_tk"), "left")
    missing = F.coalesce(F.col("_rk"), F.lit("")) == ""
    status = (F.when(missing | F.col("_tk").isNull(), 401).when(~F.col("active"), 403).when(F.col("remaining") <= 0, 429).otherwise(200))
    error = (F.when(missing, F.lit("missing_key")).when(F.col("_tk").isNull(), F.lit("invalid_key"))
             .when(~F.col("active"), F.lit("inactive")).when(F.col("remaining") <= 0, F.lit("quota_exhausted")))
    return j.withColumn("status", status).withColumn("error", error).select(*requests.columns, "tenant_id", "status", "error")


def tenant_usage(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests and steps per tenant, remaining quota floored at zero."""
    used = requests.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("steps").alias("_steps"))
    return tenants.join(used, "tenant_id", "left").select(
        "tenant_id", F.coalesce("requests", F.lit(0)).alias("requests"),
        F.greatest(F.lit(0), F.col("quota") - F.coalesce("_steps", F.lit(0))).alias("remaining"))


def latest_tenant(tenants: DataFrame) -> DataFrame:
    """The most recently used tenant; never-used ones count by creation."""
    return tenants.orderBy(F.desc(F.coalesce("last_used", "created")), "tenant_id").limit(1)


# --- objectives, evidence, results --------------------------------------------------------------

def completion_audit(objectives: DataFrame, evidence: DataFrame) -> DataFrame:
    """``run_id, satisfied, problem, missing[]``: objectives not completed, else without verified evidence."""
    proven = evidence.filter("verified").select("run_id", "objective_id").distinct().withColumn("_ok", F.lit(True))
    j = objectives.join(proven, ["run_id", "objective_id"], "left")
    part = j.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("completed"), F.col("objective_id")))).alias("_open"),
        F.array_sort(F.collect_list(F.when(F.col("_ok").isNull(), F.col("objective_id")))).alias("_bare"))
    missing = F.when(F.size("_open") > 0, F.col("_open")).otherwise(F.col("_bare"))
    return part.select("run_id", (F.size(missing) == 0).alias("satisfied"), F.when(
        F.size("_open") > 0, F.lit("incomplete")).when(F.size("_bare") > 0, F.lit("unverified")).alias("problem"),
        missing.alias("missing"))


def dedup_evidence(evidence: DataFrame, keep: int = 100, order: str = "seq") -> DataFrame:
    """First of each (objective, kind, summary, action), newest ``keep`` per run."""
    rest = [c for c in evidence.columns if c not in ("run_id", "objective_id", "kind", "summary", "action_id")]
    one = evidence.groupBy("run_id", "objective_id", "kind", "summary", "action_id").agg(
        F.min_by(F.struct(*rest), order).alias("_w")).select(
        "run_id", "objective_id", "kind", "summary", "action_id", *[F.col(f"_w.{c}").alias(c) for c in rest])
    return keep_latest(one, ["run_id"], keep, [order]).select(*evidence.columns)


def rollup_results(results: DataFrame) -> DataFrame:
    """``results(task_id, seq, sub_id, outcome, summary, mask_count, step_count)`` -> one row per task.

    A task has a handful of sub-results, so its numbered summary fits one row.
    """
    line = F.struct("seq", "sub_id", "outcome", "summary")
    agg = results.groupBy("task_id").agg(
        F.bool_or(F.col("outcome") == "failure").alias("_bad"), F.sum(F.coalesce("mask_count", F.lit(0))).alias("mask_count"),
        F.sum(F.coalesce("step_count", F.lit(1))).alias("step_count"), F.array_sort(F.collect_list(line)).alias("_l"))
    numbered = F.transform("_l", lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". ["), x["sub_id"], F.lit("] ("), F.upper(x["outcome"]), F.lit("): "), x["summary"]))
    return agg.select("task_id", F.when(F.col("_bad"), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                      F.when(F.size("_l") == 1, F.col("_l")[0]["summary"]).otherwise(F.array_join(numbered, "\n")).alias("summary"),
                      "mask_count", "step_count")


def compare_prices(results: DataFrame) -> DataFrame:
    """``results(query, source, summary)``: first amount per source, cheapest source, difference."""
    raw = first_match(F.col("summary"), rf"(?i)(?:₹|Rs\.?|INR){WS}*([\d,]+)", 1)
    priced = results.withColumn("price", F.expr("try_cast(NULL as bigint)")).withColumn(
        "_raw", F.replace(raw, F.lit(","), F.lit(""))).withColumn("price", F.expr("try_cast(_raw as bigint)"))
    return priced.filter("price IS NOT NULL").groupBy("query").agg(
        F.count(F.lit(1)).alias("sources"), F.min_by("source", F.struct("price", "source")).alias("cheapest"),
        (F.max("price") - F.min("price")).alias("difference")).filter("sources >= 2")


# --- digests --------------------------------------------------------------------------------------

def payload_digest(df: DataFrame, fields: dict[str, str], out: str = "digest") -> DataFrame:
    """SHA-256 over canonical JSON: listed fields only, keys sorted, string arrays sorted.

    ``fields`` maps the JSON key to a column; nested structs are expected with sorted fields.
    """
    parts = []
    for name in sorted(fields):
        col = F.col(fields[name])
        dtype = df.schema[fields[name]].dataType.simpleString() if fields[name] in df.columns else ""
        parts.append((F.array_sort(col) if dtype == "array<string>" else col).alias(name))
    text = F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    return df.withColumn(out, F.concat(F.lit("sha256_"), F.sha2(text, 256)))


def verify_digest(df: DataFrame, fields: dict[str, str], declared: str = "declared") -> DataFrame:
    """Rows whose declared digest is missing, malformed or wrong."""
    made = payload_digest(df, fields, "_actual")
    ok = F.coalesce(F.col(declared).startswith("sha256_") & (F.col(declared) == F.col("_actual")), F.lit(False))
    return made.filter(~ok).drop("_actual")
