"""Boxes and regions.

Columns of a box: ``x, y, w, h``. Capture metadata: ``capture_id, viewport_w, viewport_h, screen_w,
screen_h, scroll_x, scroll_y``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.blocking import dealt, iou, touching_boxes
from veil.functions.ordered import running
from veil.functions.rules import CATEGORY_PRECEDENCE
from veil.functions.spans import spans_col
from veil.operators.match import decide_by_rank

META = ["viewport_w", "viewport_h", "screen_w", "screen_h", "scroll_x", "scroll_y"]


def _round(c: Column) -> Column:
    return F.floor(c + 0.5)


def visible(regions: DataFrame, width: Column | float, height: Column | float) -> DataFrame:
    """Boxes larger than one pixel that touch the capture."""
    w = F.lit(width) if not isinstance(width, Column) else width
    h = F.lit(height) if not isinstance(height, Column) else height
    return regions.filter((F.col("w") > 1) & (F.col("h") > 1) & (F.col("x") + F.col("w") > 0)
                          & (F.col("y") + F.col("h") > 0) & (F.col("x") < w) & (F.col("y") < h))


def _with_meta(df: DataFrame, meta: DataFrame | None) -> DataFrame:
    return df if meta is None or set(META) <= set(df.columns) else df.join(meta, "capture_id")


def to_screenshot(boxes: DataFrame, meta: DataFrame | None, pad: float = 4) -> DataFrame:
    """Add ``sx_x, sx_y, sx_w, sx_h``: viewport box scaled, padded, clamped to the screenshot, rounded."""
    df = _with_meta(boxes, meta)
    out = {}
    for lo, size, screen, view in (("x", "w", "screen_w", "viewport_w"), ("y", "h", "screen_h", "viewport_h")):
        scale = F.col(screen) / F.col(view)
        raw = F.col(lo) * scale - pad
        begin = F.greatest(F.lit(0.0), raw)
        end = F.least(F.col(screen).cast("double"), raw + F.col(size) * scale + 2 * pad)
        length = F.greatest(F.lit(0.0), end - begin)
        out[f"sx_{lo}"] = _round(F.when(length > 0, begin).otherwise(F.lit(0.0)))
        out[f"sx_{size}"] = _round(length)
    return df.withColumns(out)


def to_viewport(boxes: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Add ``vp_*``: a screenshot box on the viewport scale, rounded."""
    df = _with_meta(boxes, meta)
    return df.withColumns({f"vp_{c}": _round(F.col(c) / (F.col(f"screen_{d}") / F.col(f"viewport_{d}")))
                           for c, d in (("x", "w"), ("y", "h"), ("w", "w"), ("h", "h"))})


def doc_to_viewport(boxes: DataFrame, meta: DataFrame | None) -> DataFrame:
    df = _with_meta(boxes, meta)
    return df.withColumns({"vp_x": F.col("x") - F.col("scroll_x"), "vp_y": F.col("y") - F.col("scroll_y"),
                           "vp_w": F.col("w"), "vp_h": F.col("h")})


def coarse_bounds(boxes: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Add ``bounds``: x, y, w, h as shares of the viewport, two decimals, within 0..1."""
    df = _with_meta(boxes, meta)

    def share(c, d):
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.floor(F.col(c) / F.col(d) * 100 + 0.5) / 100))

    return df.withColumn("bounds", F.array(share("x", "viewport_w"), share("y", "viewport_h"),
                                           share("w", "viewport_w"), share("h", "viewport_h")))


def pad_box(boxes: DataFrame, pad: float = 0.01) -> DataFrame:
    """Mask box: a normalised box padded on all sides and clamped to the page."""
    x, y = F.greatest(F.lit(0.0), F.col("x") - pad), F.greatest(F.lit(0.0), F.col("y") - pad)
    return boxes.withColumns({"mx": x, "my": y, "mw": F.least(1 - x, F.col("w") + 2 * pad),
                              "mh": F.least(1 - y, F.col("h") + 2 * pad)})


def vertical_bucket(boxes: DataFrame, viewport_h, viewport_w) -> DataFrame:
    bucket = (F.when(F.col("y") + F.col("h") <= 0, F.lit("above")).when(F.col("y") >= F.lit(viewport_h), F.lit("below"))
              .otherwise(F.lit("in_view")))
    return boxes.withColumn("bucket", bucket).withColumn("in_viewport", (F.col("bucket") == "in_view") & (
        F.col("x") + F.col("w") > 0) & (F.col("x") < F.lit(viewport_w)))


def scroll_metrics(pages: DataFrame) -> DataFrame:
    """From ``scroll_top, scroll_height, client_height``: limits, distances and flags."""
    top = F.greatest(F.lit(0), _round(F.col("scroll_top")))
    height = F.greatest(F.col("viewport_h"), _round(F.col("scroll_height")))
    limit = F.greatest(F.lit(0), height - F.greatest(F.lit(1), _round(F.col("client_height"))))
    return pages.withColumns({
        "max_scroll_top": limit, "scrollable_below": top < limit - 2, "scrollable_above": top > 2,
        "pixels_below": F.greatest(F.lit(0), limit - top), "pixels_above": top})


def validate_geometry(regions: DataFrame, width, height) -> DataFrame:
    """Add ``is_valid, reason``; columns ``space, x, y, w, h`` may hold NaN, infinities and NULL."""
    nums = [F.col(c) for c in ("x", "y", "w", "h")]
    broken = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in nums])
    x, y, w, h = nums
    reason = (
        F.when(~F.col("space").eqNullSafe("screenshotPixel"), F.lit("wrong_space"))
        .when(broken, F.lit("non_finite"))
        .when((w <= 0) | (h <= 0), F.lit("non_positive"))
        .when((w <= 1) & (h <= 1), F.lit("degenerate"))
        .when((x + w <= 0) | (y + h <= 0) | (x >= F.lit(width)) | (y >= F.lit(height)), F.lit("outside")))
    return regions.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def detect_surfaces(elements: DataFrame) -> DataFrame:
    """Canvas, iframe and document images as whole-surface detections."""
    cls = F.lower(F.coalesce("cls", F.lit("")))
    scanned = cls.contains("scanned") | cls.contains("document") | cls.contains("id-card")
    hit = F.col("tag").isin("canvas", "iframe") | ((F.col("tag") == "img") & scanned)
    return elements.filter(hit).withColumn("category", F.lit("high_risk_surface"))


def surface_regions(surfaces: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Everything not verified as inspected is masked, unknown status included."""
    seen = (F.coalesce("status", F.lit("")) == "inspected_same_origin") & ~F.coalesce("uninspectable", F.lit(True))
    return to_screenshot(surfaces.filter(~seen), meta, pad=2).filter("sx_w > 1 AND sx_h > 1").withColumns({
        "category": F.lit("high_risk_surface"), "source": F.lit("surface_detector"), "method": F.lit("opaque_mask"),
        "label": F.concat(F.lit("HIGH_RISK_SURFACE: "), F.upper(F.coalesce("surface_type", F.lit("UNKNOWN_SURFACE"))))})


def text_regions(nodes: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Measured span rectangles, else a measured fallback box, else (no measurement) the node box; merged.

    ``nodes(capture_id, node_id, text, x, y, w, h, ranges)`` with ``ranges``
    ``array<struct<category, rects array<struct<x,y,w,h>>, fallback struct<x,y,w,h>>>`` or NULL.
    """
    def box(b):
        return [F.col(f"{b}.{c}").alias(c) for c in ("x", "y", "w", "h")]

    keep = ["capture_id", "node_id"]
    measured = nodes.filter(F.coalesce(F.size("ranges"), F.lit(0)) > 0)
    ranges = measured.select(*keep, F.explode("ranges").alias("r"))
    exact = ranges.filter(F.size("r.rects") > 0).select(*keep, F.col("r.category").alias("category"),
                                                        F.explode("r.rects").alias("b"))
    exact = to_screenshot(exact.select(*keep, "category", *box("b")), meta, pad=0)
    loose = ranges.filter((F.coalesce(F.size("r.rects"), F.lit(0)) <= 0) & F.col("r.fallback").isNotNull()).select(
        *keep, F.col("r.category").alias("category"), F.col("r.fallback").alias("b"))
    loose = to_screenshot(loose.select(*keep, "category", *box("b")), meta, pad=4)
    bare = nodes.filter((F.coalesce(F.size("ranges"), F.lit(0)) <= 0) & F.col("text").isNotNull())
    # Captures show the same texts again and again; each is searched once.
    found = bare.select("text").distinct().select("text", F.explode(spans_col("text")["category"]).alias("category"))
    bare = to_screenshot(bare.select(*keep, "text", "x", "y", "w", "h").join(found, "text").drop("text"), meta, pad=2)
    cols = ["capture_id", "category", *[F.col(f"sx_{c}").alias(c) for c in ("x", "y", "w", "h")]]
    every = reduce(DataFrame.unionByName, [d.filter("sx_w > 1 AND sx_h > 1").select(*cols) for d in (exact, loose, bare)])
    return merge_boxes(every).withColumns({"source": F.lit("text_pii_regex"), "method": F.lit("opaque_mask")})


def reconcile_faces(faces: DataFrame, images: DataFrame, meta: DataFrame | None, cell: float = 256.0) -> DataFrame:
    """Public faces leave, avatars without a model face join.

    ``faces(capture_id, face_id, x, y, w, h)`` in viewport pixels; ``images(capture_id, image_id, x, y, w, h,
    is_avatar, is_public)``. A face fully inside a public image leaves unless a private avatar overlaps it;
    an avatar (16 pixels at least) is added unless some face covers more than half of it.
    """
    f = faces.select("capture_id", "face_id", *[F.col(c).alias(f"l{c}") for c in "xywh"])
    g = images.select("capture_id", "image_id", "is_avatar", "is_public", *[F.col(c).alias(f"r{c}") for c in "xywh"])
    near = touching_boxes(f, g, ["capture_id"], cell)
    inside = ((F.col("lx") >= F.col("rx")) & (F.col("ly") >= F.col("ry"))
              & (F.col("lx") + F.col("lw") <= F.col("rx") + F.col("rw"))
              & (F.col("ly") + F.col("lh") <= F.col("ry") + F.col("rh")))
    over = ((F.col("lx") < F.col("rx") + F.col("rw")) & (F.col("lx") + F.col("lw") > F.col("rx"))
            & (F.col("ly") < F.col("ry") + F.col("rh")) & (F.col("ly") + F.col("lh") > F.col("ry")))
    flags = near.groupBy("capture_id", "face_id").agg(
        F.max(F.col("is_public") & ~F.col("is_avatar") & inside).alias("_pub"),
        F.max(F.col("is_avatar") & over).alias("_priv"))
    kept = faces.join(flags, ["capture_id", "face_id"], "left").filter(
        ~(F.coalesce("_pub", F.lit(False)) & ~F.coalesce("_priv", F.lit(False)))).select(
        "capture_id", F.col("face_id").alias("region_id"), "x", "y", "w", "h", F.lit("model").alias("origin"))
    avatars = to_screenshot(images.filter("is_avatar AND w >= 16 AND h >= 16"), meta, pad=4).filter(
        "sx_w > 1 AND sx_h > 1")
    shot = to_screenshot(faces, meta, pad=4).select(
        "capture_id", "face_id", *[F.col(f"sx_{c}").cast("double").alias(f"r{c}") for c in "xywh"])
    left = avatars.select("capture_id", "image_id", *[F.col(f"sx_{c}").cast("double").alias(f"l{c}") for c in "xywh"])
    pairs = touching_boxes(left, shot, ["capture_id"], cell)
    ix = F.greatest(F.lit(0.0), F.least(F.col("lx") + F.col("lw"), F.col("rx") + F.col("rw")) - F.greatest("lx", "rx"))
    iy = F.greatest(F.lit(0.0), F.least(F.col("ly") + F.col("lh"), F.col("ry") + F.col("rh")) - F.greatest("ly", "ry"))
    covered = pairs.filter(ix * iy > 0.5 * F.col("lw") * F.col("lh")).select("capture_id", "image_id").distinct()
    added = avatars.join(covered, ["capture_id", "image_id"], "left_anti").select(
        "capture_id", F.concat(F.lit("face_dom_"), F.col("image_id").cast("string")).alias("region_id"),
        "x", "y", "w", "h", F.lit("avatar").alias("origin"))
    return kept.withColumn("region_id", F.col("region_id").cast("string")).unionByName(added)


def union_detections(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def run_detectors(detectors: dict, disable=()) -> DataFrame:
    """Union of all detectors that are not switched off. ``detectors`` maps a name to a DataFrame."""
    return union_detections(*[
        df.withColumn("detector", F.lit(name)) for name, df in detectors.items() if name not in set(disable)])


def reconcile_masks(regions: DataFrame, rendered: DataFrame) -> DataFrame:
    """Regions without a good mask, masks without a region.

    ``rendered(capture_id, region_id, success, failure_reason)``.
    """
    a = regions.select("capture_id", "region_id").withColumn("_want", F.lit(True))
    b = rendered.select("capture_id", "region_id", "success", "failure_reason").withColumn("_have", F.lit(True))
    problem = (F.when(F.col("_have").isNull(), F.lit("not_rendered")).when(F.col("_want").isNull(), F.lit("unknown_region"))
               .when(~F.col("success"), F.coalesce("failure_reason", F.lit("unknown render failure"))))
    return a.join(b, ["capture_id", "region_id"], "full_outer").withColumn("problem", problem).filter(
        "problem IS NOT NULL").select("capture_id", "region_id", "problem")


# --- folds ---------------------------------------------------------------------

def precedence(category: Column) -> Column:
    order = F.array(*[F.lit(c) for c in CATEGORY_PRECEDENCE])
    at = F.array_position(order, category)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(CATEGORY_PRECEDENCE)))


def secret_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s \-_().]", "")


def fuse_by_secret(dets: DataFrame, key: str = "page_id") -> DataFrame:
    """M1: one row per page and secret; the most specific category, then the earliest, wins.

    A plain aggregation, so a secret repeated a billion times shrinks before it is shuffled.
    Secrets shorter than three characters never merge.
    """
    rest = [c for c in dets.columns if c not in (key, "seq")]
    keyed = dets.withColumn("_k", secret_key(F.col("text"))).withColumn(
        "_k", F.when(F.length("_k") >= 3, F.col("_k")))
    merged = keyed.filter("_k IS NOT NULL").groupBy(key, "_k").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct(*rest), F.struct(precedence(F.col("category")), F.col("seq"))).alias("_w")).select(
        key, "seq", *[F.col(f"_w.{c}").alias(c) for c in rest])
    return merged.unionByName(keyed.filter("_k IS NULL").select(key, "seq", *rest)).select(*dets.columns)


def _pieces(regions: DataFrame, keys: list[str], order: list[str], cell: float) -> DataFrame:
    """``*keys, _b``: the boxes between two cuts."""
    band = F.floor(F.col("x") / cell)
    reach = running(regions, keys, band, order, {"_reach": (F.col("x") + F.col("w"), "max")}, exclusive=True)
    cut = reach.withColumn("_cut", F.when(F.col("_reach").isNull() | (F.col("x") > F.col("_reach")), 1).otherwise(0))
    # Equal boxes are interchangeable, but the one that cuts has to come first.
    pieces = running(cut, keys, band, [*order, F.desc("_cut")], {"_piece": (F.col("_cut"), "sum")})
    return pieces.groupBy(*keys, "_piece").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "w", "h"))).alias("_b")).select(*keys, "_b")


# Boxes of a group up to which one row holds them all.
SMALL = 64


def _by_group(regions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``*keys, _small, _b``: boxes by group, as one row for up to ``blocking.HOT`` of them. ``_small``: at most ``SMALL``, and nothing is NULL."""
    marked = dealt(regions, keys, order)
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in [*keys, *order]])
    return marked.groupBy(*keys, "_part", "_hot").agg(F.collect_list(F.struct(*order)).alias("_b"), F.bool_or(gap).alias("_gap")).select(
        *keys, (~F.col("_hot") & ~F.col("_gap") & (F.size("_b") <= SMALL)).alias("_small"), F.array_sort("_b").alias("_b"))


def merge_boxes(regions: DataFrame, keys=("capture_id", "category"), cell: float = 1.0) -> DataFrame:
    """M2: sort by x then y; each box joins the previous merged box when they touch, else starts a new one.

    Only the last merged box is looked at, so this is a fold, not a closure. A group of at most ``SMALL`` boxes is folded as it is.
    In others a box that begins to the right of everything before it can join nothing: the fold is cut there, and every piece
    between two cuts is folded on its own. The cuts are running values over bands of ``cell`` width, so a crowded capture is never
    scanned by one task.
    """
    keys, order = list(keys), ["x", "y", "w", "h"]
    grouped = _by_group(regions.select(*keys, *order), keys, order)
    large = grouped.filter("NOT _small").select(*keys, F.explode_outer("_b").alias("_x")).select(*keys, "_x.*")
    grouped = grouped.filter("_small").select(*keys, "_b").unionByName(_pieces(large, keys, order, cell))
    merged = F.expr("""
        aggregate(slice(_b, 2, size(_b)), named_struct('done', cast(array() as array<struct<x:double,y:double,w:double,h:double>>),
                      'x', cast(_b[0].x as double), 'y', cast(_b[0].y as double), 'w', cast(_b[0].w as double), 'h', cast(_b[0].h as double)),
          (a, c) -> CASE WHEN c.x <= a.x + a.w AND c.x + c.w >= a.x AND c.y <= a.y + a.h AND c.y + c.h >= a.y
            THEN named_struct('done', a.done, 'x', least(a.x, cast(c.x as double)), 'y', least(a.y, cast(c.y as double)),
                 'w', greatest(a.x + a.w, cast(c.x + c.w as double)) - least(a.x, cast(c.x as double)),
                 'h', greatest(a.y + a.h, cast(c.y + c.h as double)) - least(a.y, cast(c.y as double)))
            ELSE named_struct('done', concat(a.done, array(named_struct('x', a.x, 'y', a.y, 'w', a.w, 'h', a.h))),
                 'x', cast(c.x as double), 'y', cast(c.y as double), 'w', cast(c.w as double), 'h', cast(c.h as double)) END,
          a -> concat(a.done, array(named_struct('x', a.x, 'y', a.y, 'w', a.w, 'h', a.h))))""")
    return grouped.select(*keys, F.explode(merged).alias("_m")).select(*keys, "_m.x", "_m.y", "_m.w", "_m.h")


def fuse_spatial(dets: DataFrame, key: str = "page_id") -> DataFrame:
    """M3: fold detections in order; same secret, or overlap of 0.8 of the smaller box, joins the first kept one.

    A more specific category replaces the kept detection. The order inside one page decides the result,
    so a page is one fold; pages are independent.
    """
    cols = ["seq", "category", "text", "x", "y", "w", "h"]
    typed = dets.select(key, F.col("seq").cast("long").alias("seq"), "category", "text", *[
        F.col(c).cast("double").alias(c) for c in "xywh"]).withColumn("_k", secret_key(F.col("text"))).withColumn(
        "_p", precedence(F.col("category")))
    packed = typed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "category", "text", "x", "y", "w", "h", "_k", "_p"))).alias("_d"))
    item = ("struct<seq:bigint,category:string,text:string,x:double,y:double,w:double,h:double,_k:string,_p:bigint>")
    merged = ("named_struct('seq', k.seq, 'category', d.category, 'text', coalesce(d.text, k.text), 'x', coalesce(d.x, k.x), "
              "'y', coalesce(d.y, k.y), 'w', coalesce(d.w, k.w), 'h', coalesce(d.h, k.h), '_k', CASE WHEN d.text IS NULL THEN k._k ELSE d._k END, '_p', d._p)")
    same = ("((length(d._k) >= 3 AND d._k = k._k) OR coalesce("
            "greatest(0D, least(d.x + d.w, k.x + k.w) - greatest(d.x, k.x)) * greatest(0D, least(d.y + d.h, k.y + k.h) - greatest(d.y, k.y)) > 0 "
            "AND greatest(0D, least(d.x + d.w, k.x + k.w) - greatest(d.x, k.x)) * greatest(0D, least(d.y + d.h, k.y + k.h) - greatest(d.y, k.y)) "
            ">= 0.8 * least(d.w * d.h, k.w * k.h) AND d.x IS NOT NULL AND d.y IS NOT NULL AND d.w IS NOT NULL AND d.h IS NOT NULL "
            "AND k.x IS NOT NULL AND k.y IS NOT NULL AND k.w IS NOT NULL AND k.h IS NOT NULL, false))")
    fold = F.expr(f"""
        aggregate(_d, cast(array() as array<{item}>), (acc, d) ->
          get(transform(array(coalesce(array_position(transform(acc, k -> {same}), true), 0)), at ->
            CASE WHEN at = 0 THEN concat(acc, array(named_struct('seq', d.seq, 'category', d.category, 'text', d.text, 'x', d.x, 'y', d.y,
                                                       'w', d.w, 'h', d.h, '_k', d._k, '_p', cast(d._p as bigint))))
                 ELSE transform(acc, (k, i) -> CASE WHEN i + 1 = at AND d._p < k._p THEN {merged} ELSE k END) END), 0))""")
    return packed.select(key, F.explode(fold).alias("_o")).select(key, *[F.col(f"_o.{c}") for c in cols])


def nms(dets: DataFrame, threshold: float = 0.35, cell: float = 0.25) -> DataFrame:
    """M5: keep a box unless a kept box of higher score in the same capture overlaps it above the threshold.

    Overlaps come from a grid join, so only neighbours meet; who stays is decided rank by rank on that
    sparse graph. ``dets(capture_id, det_id, x, y, w, h, score)``.
    """
    def side(p):
        return dets.select("capture_id", F.col("det_id").alias(f"{p}id"), F.col("score").alias(f"{p}score"),
                           *[F.col(c).alias(f"{p}{c}") for c in "xywh"])

    pairs = touching_boxes(side("l"), side("r"), ["capture_id"], cell)
    better = (F.col("lscore") > F.col("rscore")) | ((F.col("lscore") == F.col("rscore")) & (F.col("lid") < F.col("rid")))
    clash = pairs.filter(better & (iou(*[F.col(f"l{c}") for c in "xywh"], *[F.col(f"r{c}") for c in "xywh"]) > threshold))
    edges = clash.select("capture_id", F.col("lid").alias("winner"), F.col("rid").alias("loser"))
    dropped = decide_by_rank(edges, ["capture_id"])
    return dets.join(dropped.withColumnRenamed("node", "det_id"), ["capture_id", "det_id"], "left_anti")
