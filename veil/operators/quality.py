"""Scoring against ground truth, scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.ordered import averaging_median
from veil.functions.ordered import index_percentile as _index_percentile
from veil.functions.util import half_up, safe_div
from veil.operators.match import coverage, detection_pairs, element_pairs, greedy_match, preserved, surfaces_covered

# The scored categories.
SCORED = ("password", "email", "phone", "credit_card", "cvv", "national_id", "token", "face", "high_risk_surface")


def one_row(values: dict[str, DataFrame]) -> DataFrame:
    """Single numbers from several DataFrames (one row, one column each) side by side, as doubles."""
    rows = reduce(DataFrame.unionByName, [
        df.toDF("_v").select(F.lit(name).alias("_n"), F.col("_v").cast("double").alias("_v")) for name, df in values.items()])
    return rows.agg(*[F.max(F.when(F.col("_n") == name, F.col("_v"))).alias(name) for name in values])


def size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def filter_split(pages: DataFrame, gt: DataFrame, split: str = "all", key: str = "page_id") -> DataFrame:
    """Pages of a split; pages without annotation stay."""
    if split == "all":
        return pages
    marks = gt.select(key, F.col("split").alias("_split"))
    return pages.join(marks, key, "left").filter(F.col("_split").isNull() | (F.col("_split") == split)).drop("_split")


def split_overlap(gt: DataFrame, key: str = "page_id", a: str = "dev", b: str = "held-out") -> DataFrame:
    """Keys in both splits; must be empty."""
    return gt.filter(F.col("split") == a).select(key).intersect(gt.filter(F.col("split") == b).select(key))


def rates(tp: Column, fp: Column, fn: Column, digits: int = 1) -> dict[str, Column]:
    """Recall, precision and F1 in percent; NULL where nothing was there to find."""
    recall = safe_div(tp * 100.0, tp + fn)
    precision = F.when(tp + fp > 0, tp * 100.0 / (tp + fp)).when(tp + fn > 0, F.lit(0.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(
        precision.isNotNull() & recall.isNotNull(), F.lit(0.0))
    return {"recall": half_up(recall, digits), "precision": half_up(precision, digits), "f1": half_up(f1, digits)}


def count_outcomes(dets: DataFrame, gt: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """``tp, fp, fn`` per group from the three tables; counts only, so nothing large is joined."""
    def n(df, name):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.lit(name).alias("_k"), "_n")

    every = reduce(DataFrame.unionByName, [n(dets, "d"), n(gt, "g"), n(matches, "m")])
    agg = [F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_n"))), F.lit(0)).alias(f"_{k}") for k in "dgm"]
    total = every.groupBy(*by).agg(*agg)
    return total.select(*by, F.col("_m").alias("tp"), (F.col("_d") - F.col("_m")).alias("fp"),
                        (F.col("_g") - F.col("_m")).alias("fn"))


def pii_metrics(outcomes: DataFrame) -> DataFrame:
    """A1: ``category, tp, fp, fn, recall, precision, f1``; category NULL is the total."""
    total = outcomes.groupingSets([["category"], []], "category").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return total.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def score_detections(dets: DataFrame, gt: DataFrame, pooled: bool = False) -> DataFrame:
    """J3 -> M4 -> A1. ``pooled`` matches across pages, as a single pool per category."""
    if pooled:
        dets, gt = _pool(dets), _pool(gt)
    keys = ["page_id", "category"]
    matches = greedy_match(detection_pairs(dets, gt), keys)
    return pii_metrics(count_outcomes(dets, gt, matches, ["category"]))


def _pool(df: DataFrame) -> DataFrame:
    """One page for all, sequence numbers made global by (page, seq) order."""
    # 10^18 to a page: no sequence number reaches the next page's.
    seq = F.col("page_order").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col("seq").cast("decimal(19,0)")
    return df.withColumn("seq", seq).withColumn("page_id", F.lit(0))


def element_metrics(els: DataFrame, gt: DataFrame) -> DataFrame:
    """A2: one row: recall, precision, role accuracy, averaging median overlap of matched boxes."""
    pairs = element_pairs(els, gt)
    matches = greedy_match(pairs, ["page_id"], carry=("iou", "role_ok"))
    one = one_row({"tp": size(matches), "_roles": matches.agg(F.sum(F.col("role_ok").cast("long"))),
                   "_iou": averaging_median(matches, [], "iou"), "_e": size(els), "_g": size(gt)})
    return one.select(
        F.col("tp").cast("long").alias("tp"), (F.col("_e") - F.col("tp")).cast("long").alias("fp"),
        (F.col("_g") - F.col("tp")).cast("long").alias("fn"),
        half_up(safe_div(F.col("tp") * 100.0, F.col("_g")), 1).alias("recall"),
        half_up(safe_div(F.col("tp") * 100.0, F.col("_e")), 1).alias("precision"),
        half_up(safe_div(F.col("_roles") * 100.0, F.col("tp")), 1).alias("role_accuracy"),
        half_up(F.col("_iou"), 2).alias("median_iou"))


def _area(default_w: float = 0.1, default_h: float = 0.05) -> Column:
    """Box area; a missing or zero side counts as the default side."""
    def side(c, d):
        return F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(d)).otherwise(F.col(c))

    return side("w", default_w) * side("h", default_h)


def redaction_metrics(masks: DataFrame, gt_boxes: DataFrame, els: DataFrame, gt_safe: DataFrame) -> DataFrame:
    """A3: one row: coverage, under-masked boxes, mask to sensitive area, safe controls kept."""
    _, missed = coverage(masks, gt_boxes)
    one = one_row({
        "under_masked": size(missed), "total": size(gt_boxes), "_sa": gt_boxes.agg(F.sum(F.greatest(F.lit(0.0001), _area()))),
        "_ma": masks.agg(F.sum(_area())), "safe_kept": size(preserved(els, gt_safe)), "safe_total": size(gt_safe)})
    return one.select(
        half_up(safe_div((F.col("total") - F.col("under_masked")) * 100.0, F.col("total")), 1).alias("coverage"),
        F.col("under_masked").cast("long").alias("under_masked"), half_up(safe_div(F.col("_ma"), F.col("_sa")), 2).alias("area_ratio"),
        half_up(safe_div(F.col("safe_kept") * 100.0, F.col("safe_total")), 1).alias("safe_pct"),
        F.col("safe_kept").cast("long").alias("safe_kept"), F.col("safe_total").cast("long").alias("safe_total"))


def index_percentile(df: DataFrame, col: str, p: float, keys=()) -> DataFrame:
    """A5: ``sorted[min(n - 1, floor(n * p))]``; ``p = 0.5`` is the script median."""
    return _index_percentile(df, list(keys), col, {"value": p})


def latency_summary(telemetry: DataFrame, keys=()) -> DataFrame:
    """A4: p50 and p95 of total, client and server time, p50 of the action remainder."""
    ms = {c: F.coalesce(c, F.lit(0)) for c in ("total_ms", "client_ms", "server_ms")}
    base = telemetry.select(*keys, *[v.alias(k) for k, v in ms.items()])
    stages = base.select(*keys, F.explode(F.array(
        *[F.struct(F.lit(s).alias("stage"), c.cast("double").alias("ms")) for s, c in (
            ("total", F.col("total_ms")), ("client", F.col("client_ms")), ("server", F.col("server_ms")),
            ("action", F.greatest(F.lit(0), F.col("total_ms") - F.col("client_ms") - F.col("server_ms"))))])).alias("_s")
    ).select(*keys, "_s.stage", "_s.ms")
    return _index_percentile(stages, [*keys, "stage"], "ms", {"p50": 0.50, "p95": 0.95})


def redaction_manifest(regions: DataFrame) -> DataFrame:
    """Per capture: counts by source group and method, and a map by category."""
    group = (F.when((F.col("category") == "face") | (F.col("source") == "face_model"), F.lit("face"))
             .when((F.col("source") == "surface_detector") | F.col("category").isin("high_risk_surface", "uninspectable"),
                   F.lit("surface"))
             .when(F.col("source") == "dom_semantic", F.lit("dom_input")).otherwise(F.lit("pii_text")))
    blurred = F.col("method").isin("gaussian_blur", "spatial_blur")
    small = regions.withColumn("_g", group).groupBy("capture_id", "_g", F.coalesce("category", F.lit("other")).alias("category"),
                                                    blurred.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    by_cat = small.groupBy("capture_id", "category").agg(F.sum("n").alias("n")).groupBy("capture_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    counts = small.groupBy("capture_id").agg(
        F.sum("n").alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("_g") == g, F.col("n"))), F.lit(0)).alias(g) for g in ("pii_text", "dom_input", "face", "surface")],
        F.coalesce(F.sum(F.when(~F.col("_b"), F.col("n"))), F.lit(0)).alias("opaque"),
        F.coalesce(F.sum(F.when(F.col("_b"), F.col("n"))), F.lit(0)).alias("blurred"))
    return counts.join(by_cat, "capture_id")


def run_rates(runs: DataFrame) -> DataFrame:
    """``metric, num, den, rate``; rates over nothing are NULL.

    ``runs(classification, passed, terminal_state, interactions[], steps[struct<executed, verified, risk>], scenario_id)``.
    """
    safe = F.col("classification").isin("expected safe abstention", "expected protected denial", "expected verification failure")
    kinds = {"autonomous_completion": F.col("classification") == "expected autonomous success",
             "assisted_completion": F.col("classification") == "expected user-assisted success", "safe_failure": safe}

    def n(cond):
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    def steps(pred):
        return F.coalesce(F.sum(F.size(F.filter(F.coalesce("steps", F.array().cast(runs.schema["steps"].dataType)), pred))), F.lit(0))

    aggs = [e for k, c in kinds.items() for e in (n(c & F.col("passed")).alias(f"{k}_n"), n(c).alias(f"{k}_d"))]
    aggs += [
        steps(lambda s: s["executed"] & ~s["verified"]).alias("incorrect_action_n"), steps(lambda s: s["executed"]).alias("incorrect_action_d"),
        steps(lambda s: s["executed"] & (s["risk"] == "blocked")).alias("unsafe_action_n"),
        steps(lambda s: s["risk"].isin("protected", "blocked")).alias("unsafe_action_d"),
        n(F.col("terminal_state").isin("awaiting-user-confirmation", "blocked-local-only")).alias("abstention_n"),
        F.count(F.lit(1)).alias("abstention_d"),
        n(F.array_contains("interactions", "confirm_or_deny_modal")).alias("intervention_n"), F.count(F.lit(1)).alias("intervention_d")]
    one = runs.agg(*aggs)
    names = [*kinds, "incorrect_action", "unsafe_action", "abstention", "intervention"]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_n").cast("long").alias("num"),
                              F.col(f"{m}_d").cast("long").alias("den")) for m in names])
    return one.select(F.explode(rows).alias("_r")).select("_r.*").withColumn(
        "rate", half_up(safe_div(F.col("num") * 100.0, F.col("den")), 0))


def privacy_gate(leaks: DataFrame, n_canaries: int, masks: DataFrame, gt_boxes: DataFrame, els: DataFrame, gt_safe: DataFrame) -> DataFrame:
    """One row: leaks, canaries checked, surfaces covered and total, safe controls kept and total."""
    one = one_row({
        "leaks": size(leaks), "covered": size(surfaces_covered(masks, gt_boxes)),
        "total": size(gt_boxes.filter("category = 'high_risk_surface'")), "safe_kept": size(preserved(els, gt_safe)),
        "safe_total": size(gt_safe)})
    return one.select(*[F.col(c).cast("long").alias(c) for c in one.columns]).withColumn("checked", F.lit(n_canaries))


# Scorecard targets, (metric, comparison, target).
TARGETS = (
    ("element_recall", ">=", 95.0), ("element_precision", ">=", 95.0), ("pii_recall", ">=", 98.0),
    ("pii_precision", ">=", 95.0), ("region_coverage", ">=", 100.0), ("under_masked", "<=", 0.0),
    ("peak_memory_mb", "<", 350.0), ("cpu_pct", "<", 15.0), ("p50_total_ms", "<=", 1200.0),
)


def verdicts(metrics: DataFrame, targets=TARGETS) -> DataFrame:
    """``metric, value, target, verdict``; a value that was not measured can never pass."""
    t = F.create_map(*[x for m, op, v in targets for x in (F.lit(m), F.struct(F.lit(op).alias("op"), F.lit(v).alias("v")))])
    rule = F.try_element_at(t, F.col("metric"))
    ok = (F.when(rule["op"] == ">=", F.col("value") >= rule["v"]).when(rule["op"] == "<=", F.col("value") <= rule["v"])
          .when(rule["op"] == "<", F.col("value") < rule["v"]))
    return metrics.select("metric", "value", rule["v"].alias("target"), F.when(F.col("value").isNull(), F.lit("NOT_MEASURED")).when(
        ok, F.lit("PASSED")).otherwise(F.lit("FAILED")).alias("verdict"))


def fusion_summary(cands: DataFrame, by=("capture_id",)) -> DataFrame:
    """A10: candidates by provenance and the mean agreement of the fused ones."""
    return cands.groupBy(*by).agg(
        *[F.count_if(F.col("provenance") == p).alias(p) for p in ("dom", "vision", "fused")],
        half_up(F.avg("agreement"), 3).alias("mean_agreement"))


def page_scorecard(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: assessable and covered regions, latency, peak and median heap.

    ``regions(page_id, assessable, covered)``; ``pages(page_id, latency_ms, heap_mb)`` has one row per sample.
    """
    cover = regions.groupBy("page_id").agg(F.count_if("assessable").alias("assessable"),
                                           F.count_if(F.col("assessable") & F.col("covered")).alias("covered"))
    peak = pages.groupBy("page_id").agg(F.max("latency_ms").alias("latency_ms"), F.max("heap_mb").alias("peak_heap_mb"))
    mid = _index_percentile(pages, ["page_id"], "heap_mb", {"median_heap_mb": 0.5})
    joined = peak.join(mid, "page_id", "left").join(cover, "page_id", "left")
    return joined.withColumn("coverage", half_up(safe_div(F.col("covered") * 100.0, F.col("assessable")), 1))

