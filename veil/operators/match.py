"""Matching detections, elements and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.blocking import by_size, close_boxes, containing_text, dealt, iou, touch, touching_boxes
from veil.functions.rules import WS
from veil.session import cut_lineage

def _boxes(p: str) -> list[Column]:
    return [F.col(f"{p}{c}") for c in "xywh"]


def _group(keys) -> Column:
    """All keys as one column that is never NULL, so that rows of a NULL key meet, too."""
    return F.struct(*keys) if keys else F.lit(0)


def _jump(todo: DataFrame, decided: DataFrame, node: list[str]) -> DataFrame:
    """Follow every pointer once: ``state`` where the node pointed at is decided, else the pointer of that node.

    ``todo(_k, *node, _p_*, _odd, _free)``: the node stays if and only if the node ``_p_*`` stays, or, with ``_odd``,
    if and only if that one goes. A node without a pointer points at itself.
    """
    at = [f"_p_{n}" for n in node]
    known = todo.select("_k", *[F.col(n).alias(p) for n, p in zip(node, at)], F.when(F.col("_free"), True).alias("_st"),
                        *[F.col(p).alias(f"_n{p}") for p in at], F.col("_odd").alias("_nodd"))
    known = known.unionByName(decided.select("_k", *[F.col(n).alias(p) for n, p in zip(node, at)], F.col("state").alias("_st"),
                                             *[F.col(n).alias(f"_n_p_{n}") for n in node], F.lit(False).alias("_nodd")))
    joined = todo.join(known, ["_k", *at])
    rest = [c for c in todo.columns if c not in ("_k", *at, "_odd", "_free")]
    return joined.select("_k", *rest, *[F.col(f"_n{p}").alias(p) for p in at], (F.col("_odd") != F.col("_nodd")).alias("_odd"),
                         F.coalesce(F.when(F.col("_free"), True), F.col("_st") != F.col("_odd")).alias("state"))


# Pairs of a group up to which one row holds them all.
SMALL = 64


def _settled_small(pairs: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """``*keys, _small, left, right, score, *carry``: the chosen pairs of groups of at most ``SMALL`` pairs, all pairs of other groups, each once."""
    cols = ["left", "right", "score", *carry]
    best = F.max(F.struct("score", *carry)).alias("_b")
    typed = pairs.select(*keys, "left", "right", F.col("score").cast("double").alias("score"), *carry)
    once = dealt(typed, keys, ["left", "right"]).repartition(*keys, "_part").groupBy(*keys, "_part", "_hot", "left", "right").agg(best)
    # The order in which the pairs of a group are gone through; the number of pairs is that of the last one.
    group = Window.partitionBy(*keys, "_part")
    ranked = once.select(*keys, "_part", "_hot", "left", "right", "_b.*").withColumn(
        "_at", F.row_number().over(group.orderBy("left", F.desc("score"), "right")))
    packed = ranked.groupBy(*keys, "_part", "_hot").agg(F.sort_array(F.collect_list(F.struct("_at", *cols))).alias("_p")).withColumn(
        "_small", ~F.col("_hot") & (F.size("_p") <= SMALL))
    none = F.array().cast(packed.schema["_p"].dataType)
    clash = lambda p, a: a["left"].eqNullSafe(p["left"]) | a["right"].eqNullSafe(p["right"])
    chosen = F.aggregate("_p", none, lambda acc, p: F.when(F.exists(acc, lambda a: clash(p, a)), acc).otherwise(F.concat(acc, F.array(p))))
    return packed.select(*keys, "_small", F.explode_outer(F.when(F.col("_small") & (F.size("_p") > 1), chosen).otherwise(F.col("_p"))).alias("_c")).select(
        *keys, "_small", *[F.col(f"_c.{c}").alias(c) for c in cols])


def greedy_match(pairs: DataFrame, keys=("page_id",), pooled: bool = False, carry=()) -> DataFrame:
    """M4: lefts choose in order, each its best right still free; ties go to the lowest right.

    ``pairs(*keys, left, right, score, *carry)`` holds only pairs with a positive score; of a repeated pair the best counts.
    Groups of at most ``SMALL`` pairs are one row each, and their pairs are gone through in order. All larger groups are settled together in
    distributed rounds: a pair is chosen when no pair before it with the same left or right is; one that is first at its left and at
    its right is chosen and the others there go. A pair with a single pair before it is its opposite, so it points there, and pointers
    double each round: a chain of n pairs takes about log2(n) rounds, not n. Each round is written to the checkpoint folder; a group of
    more than ``HOT`` pairs is never one row or one task.
    """
    wanted = [] if pooled else list(keys)
    if not wanted:
        pairs = pairs.withColumn("_all", F.lit(0))
    keys, out = wanted or ["_all"], [*wanted, "left", "right", "score", *carry]
    settled = cut_lineage(_settled_small(pairs, keys, list(carry)))
    small, large = settled.filter("_small").select(*out), settled.filter("NOT _small")
    if large.isEmpty():
        return small
    todo = large.select(_group(keys).alias("_k"), "left", "right", "score", *carry, F.col("left").alias("_p_left"), F.col("right").alias("_p_right"),
                        F.lit(False).alias("_odd"))
    steps: list[DataFrame] = []
    while True:
        at_left = Window.partitionBy("_k", "left").orderBy(F.desc("score"), "right")
        at_right = Window.partitionBy("_k", "right").orderBy("left")
        ranked = todo.withColumns({"_nl": F.row_number().over(at_left), "_fl": F.first("right").over(at_left)}).withColumns(
            {"_nr": F.row_number().over(at_right), "_fr": F.first("left").over(at_right)})
        one = (F.col("_nl") + F.col("_nr") == 3) & (F.col("_p_left") == F.col("left")) & (F.col("_p_right") == F.col("right"))
        pointed = ranked.select(
            "_k", "left", "right", "score", *carry, F.when(one & (F.col("_nl") == 1), F.col("_fr")).otherwise(F.col("_p_left")).alias("_p_left"),
            F.when(one & (F.col("_nr") == 1), F.col("_fl")).otherwise(F.col("_p_right")).alias("_p_right"),
            (F.col("_odd") | one).alias("_odd"), (F.col("_nl") + F.col("_nr") == 2).alias("_free"))
        if steps:
            jumped = _jump(pointed, reduce(DataFrame.unionByName, [s.filter("state IS NOT NULL") for s in steps]), ["left", "right"])
        else:  # No pointer leads far yet, and most pairs are settled without one.
            jumped = pointed.withColumn("state", F.when(F.col("_free"), True)).drop("_free")
        taken = F.coalesce(F.col("state"), F.lit(False))
        for side in ("right", "left"):
            jumped = jumped.withColumn(f"_{side}", F.max(taken).over(Window.partitionBy("_k", side)))
        steps.append(cut_lineage(jumped.withColumn("state", F.when(F.col("state").isNull() & (F.col("_left") | F.col("_right")), False).otherwise(
            F.col("state"))).drop("_left", "_right")))
        todo = steps[-1].filter("state IS NULL").drop("state")
        if todo.isEmpty():
            break
    found = reduce(DataFrame.unionByName, [s.filter("state") for s in steps])
    return found.select(*[F.col(f"_k.{k}").alias(k) for k in wanted], "left", "right", "score", *carry).unionByName(small)


def decide_by_rank(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, node`` of the nodes that lose to a node that stays.

    ``edges(*keys, winner, loser)``: the winner always ranks above the loser. A node without a winner stays and its losers go; a node
    with one winner is that one's opposite and points at it. Rounds and pointers as in ``greedy_match``, for groups of any size.
    """
    every = cut_lineage(edges.select(_group(keys).alias("_k"), "winner", "loser"))
    # Most nodes lose to one that nothing beats: they go first, and only what is left needs pointers.
    free = every.join(every.select("_k", F.col("loser").alias("winner")).distinct(), ["_k", "winner"], "left_anti")
    first = cut_lineage(free.select("_k", F.col("loser").alias("node")).distinct().withColumn("state", F.lit(False)))
    left = every.join(free.select("_k", "winner").distinct(), ["_k", "winner"], "left_anti")
    for end in ("winner", "loser"):
        left = left.join(first.select("_k", F.col("node").alias(end)), ["_k", end], "left_anti")
    left = cut_lineage(left.distinct())
    todo = left.select("_k", F.explode(F.array("winner", "loser")).alias("node")).distinct().select(
        "_k", "node", F.col("node").alias("_p_node"), F.lit(False).alias("_odd"))
    steps = [first]
    while not left.isEmpty():
        before = left.groupBy("_k", F.col("loser").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("winner").alias("_w"))
        one = F.coalesce((F.col("_n") == 1) & (F.col("_p_node") == F.col("node")), F.lit(False))
        pointed = todo.join(before, ["_k", "node"], "left").select(
            "_k", "node", F.when(one, F.col("_w")).otherwise(F.col("_p_node")).alias("_p_node"), (F.col("_odd") | one).alias("_odd"),
            F.col("_n").isNull().alias("_free"))
        jumped = cut_lineage(_jump(pointed, reduce(DataFrame.unionByName, [s.select("_k", "node", "state").filter("state IS NOT NULL") for s in steps]),
                                   ["node"]))
        beaten = left.join(jumped.filter("state").select("_k", F.col("node").alias("winner")), ["_k", "winner"], "left_semi").select(
            "_k", F.col("loser").alias("node")).distinct().withColumn("_out", F.lit(True))
        steps.append(cut_lineage(jumped.join(beaten, ["_k", "node"], "left").withColumn(
            "state", F.when(F.col("state").isNull() & F.col("_out"), False).otherwise(F.col("state"))).drop("_out")))
        todo = steps[-1].filter("state IS NULL").drop("state")
        for end in ("winner", "loser"):
            left = left.join(todo.select("_k", F.col("node").alias(end)), ["_k", end], "left_semi")
        left = cut_lineage(left)
    # Nodes that are left without an edge stay.
    gone = reduce(DataFrame.unionByName, [s.filter("NOT state").select("_k", "node") for s in steps])
    return gone.select(*[F.col(f"_k.{k}") for k in keys], "node")


# --- candidates ------------------------------------------------------------------

def drop_unmeasured(gt_boxes: DataFrame, categories) -> DataFrame:
    """Ground truth of categories no detector ran for is not scored. ``categories`` is a short list."""
    # A box without a category was not left out by anyone; it stays.
    return gt_boxes.filter(~F.coalesce(F.col("category").isin(*categories), F.lit(False))) if categories else gt_boxes


def attach_truth(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """Annotation by page key, else by page id."""
    by_key = truth.select(F.col("page_key").alias("page_key"), F.struct(*truth.columns).alias("_a"))
    by_id = truth.select(F.col("page_key").cast("string").alias("_pid"), F.struct(*truth.columns).alias("_b"))
    joined = pages.join(by_key, "page_key", "left").join(
        by_id, F.col("page_id").cast("string") == F.col("_pid"), "left")
    rest = [c for c in truth.columns if c != "page_key"]
    return joined.select(*pages.columns, *[F.coalesce(f"_a.{c}", f"_b.{c}").alias(c) for c in rest])


def _folded(c: str) -> Column:
    return F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))


def _contained(a: str, b: str) -> Column:
    """Either text holds the other; an empty one holds nothing."""
    return (F.col(a) != "") & (F.col(b) != "") & (F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def detection_pairs(dets: DataFrame, gt: DataFrame, cell: float = 0.25) -> DataFrame:
    """Scored (detection, truth) pairs of one page and category.

    Overlap of 0.4 scores ``1 + overlap``; text containment either way at least 1.5; a pair where
    neither side has a box or a text scores 1, and pairs off in order. Columns: ``page_id, category, seq,
    text, x, y, w, h`` on both sides. Result: ``page_id, category, left, right, score``.
    """
    keys = ["page_id", "category"]

    def side(df, p):
        return df.select(*keys, F.col("seq").alias(f"{p}seq"), _folded("text").alias(f"{p}text"),
                         *[F.col(c).alias(f"{p}{c}") for c in "xywh"])

    a, b = side(dets, "l"), side(gt, "r")
    boxes = {p: " AND ".join(f"{p}{c} IS NOT NULL" for c in "xywh") for p in "lr"}
    by_box, by_text = iou(*_boxes("l"), *_boxes("r")) + 1.0, F.lit(1.5)
    few, many_a, many_b = by_size(a, b, keys)
    boxed = F.expr(f"{boxes['l']} AND {boxes['r']}") & touch(cell) & (iou(*_boxes("l"), *_boxes("r")) >= 0.4)
    score = F.greatest(F.when(boxed, by_box), F.when(_contained("ltext", "rtext"), by_text))
    small = a.join(few, keys).withColumn("score", score).filter("score IS NOT NULL").select(*keys, "lseq", "rseq", "score")
    overlap = touching_boxes(many_a.filter(boxes["l"]), many_b.filter(boxes["r"]), keys, cell).filter(iou(*_boxes("l"), *_boxes("r")) >= 0.4).select(
        *keys, "lseq", "rseq", by_box.alias("score"))
    at, bt = many_a.select(*keys, "lseq", "ltext"), many_b.select(*keys, "rseq", "rtext")
    both_ways = [containing_text(at, bt, keys, "ltext", "rtext"), containing_text(bt, at, keys, "rtext", "ltext")]
    texts = [d.select(*keys, "lseq", "rseq", by_text.alias("score")) for d in both_ways]
    order_a, order_b = Window.partitionBy(*keys).orderBy("lseq"), Window.partitionBy(*keys).orderBy("rseq")
    none_a = a.filter("lx IS NULL AND ltext = ''").withColumn("_n", F.row_number().over(order_a))
    none_b = b.filter("rx IS NULL AND rtext = ''").withColumn("_n", F.row_number().over(order_b))
    blind = none_a.join(none_b, [*keys, "_n"]).select(*keys, "lseq", "rseq", F.lit(1.0).alias("score"))
    every = reduce(DataFrame.unionByName, [small, overlap, *texts, blind])
    return every.groupBy(*keys, F.col("lseq").alias("left"), F.col("rseq").alias("right")).agg(F.max("score").alias("score"))


def element_pairs(els: DataFrame, gt: DataFrame, cell: float = 0.25) -> DataFrame:
    """``2 * overlap + same role + name containment``, for pairs with overlap 0.4 or a name match, above 0.5."""
    keys = ["page_id"]

    def side(df, p):
        return df.select("page_id", F.col("seq").alias(f"{p}seq"), _folded("name").alias(f"{p}name"),
                         F.lower(F.coalesce("role", F.lit(""))).alias(f"{p}role"), *[F.col(c).alias(f"{p}{c}") for c in "xywh"])

    a, b = side(els, "l"), side(gt, "r")
    cols = ["page_id", *[f"{p}{c}" for p in "lr" for c in ("seq", "name", "role", "x", "y", "w", "h")]]
    alike, name = iou(*_boxes("l"), *_boxes("r")) >= 0.4, _contained("lname", "rname")
    few, many_a, many_b = by_size(a, b, keys)
    small = a.join(few, keys).filter((F.expr("lx IS NOT NULL AND rx IS NOT NULL") & touch(cell) & alike) | name)
    near = touching_boxes(many_a.filter("lx IS NOT NULL"), many_b.filter("rx IS NOT NULL"), keys, cell).filter(alike)
    names = [containing_text(many_a, many_b, keys, "lname", "rname"), containing_text(many_b, many_a, keys, "rname", "lname")]
    every = reduce(DataFrame.unionByName, [d.select(*cols) for d in (small, near, *names)]).dropDuplicates(["page_id", "lseq", "rseq"])
    overlap = F.coalesce(iou(*_boxes("l"), *_boxes("r")), F.lit(0.0))
    same = (F.col("lrole") == F.col("rrole")).cast("double")
    return every.withColumn("iou", overlap).withColumn("score", F.col("iou") * 2 + same + name.cast("double")).filter(
        "score > 0.5").select("page_id", F.col("lseq").alias("left"), F.col("rseq").alias("right"), "score", "iou",
                              (same == 1.0).alias("role_ok"))


def coverage(masks: DataFrame, gt_boxes: DataFrame, cell: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """``(covered, under_masked)`` truth boxes; a mask covers by overlap 0.3 or by enclosing within 0.05."""
    b = gt_boxes.select("page_id", F.col("seq").alias("rseq"), *[F.col(c).alias(f"r{c}") for c in "xywh"])
    m = masks.select("page_id", *[F.col(c).alias(f"l{c}") for c in "xywh"])
    near = close_boxes(m, b, ["page_id"], cell, slack=0.05)
    lx, ly, lw, lh, rx, ry, rw, rh = [*_boxes("l"), *_boxes("r")]
    encloses = ((lx <= rx + 0.05) & (lx + lw >= rx + rw - 0.05) & (ly <= ry + 0.05) & (ly + lh >= ry + rh - 0.05))
    hit = near.filter((iou(lx, ly, lw, lh, rx, ry, rw, rh) >= 0.3) | encloses).select(
        "page_id", F.col("rseq").alias("seq")).distinct()
    return gt_boxes.join(hit, ["page_id", "seq"], "left_semi"), gt_boxes.join(hit, ["page_id", "seq"], "left_anti")


def preserved(els: DataFrame, gt_safe: DataFrame) -> DataFrame:
    """Safe truth controls whose name some extracted element contains, or the other way round."""
    a = els.select("page_id", _folded("name").alias("_ln"))
    b = gt_safe.select("page_id", "seq", _folded("name").alias("_rn"))
    few, many_b, many_a = by_size(b, a.distinct(), ["page_id"])
    small = b.join(few, ["page_id"]).filter(_contained("_ln", "_rn"))
    hits = reduce(DataFrame.unionByName, [d.select("page_id", "seq") for d in (
        small, containing_text(many_a, many_b, ["page_id"], "_ln", "_rn"), containing_text(many_b, many_a, ["page_id"], "_rn", "_ln"))]).distinct()
    return gt_safe.join(hits, ["page_id", "seq"], "left_semi")


def surfaces_covered(masks: DataFrame, gt_boxes: DataFrame) -> DataFrame:
    """Surface truth boxes with a mask whose corner is within 0.05."""
    surf = gt_boxes.filter("category = 'high_risk_surface'")

    def corner(df, p, *extra):
        return df.select("page_id", *extra, F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"),
                         F.lit(0.0).alias(f"{p}w"), F.lit(0.0).alias(f"{p}h"))

    near = close_boxes(corner(masks, "l").distinct(), corner(surf, "r", F.col("seq")), ["page_id"], 0.25, slack=0.05)
    hit = near.filter((F.abs(F.col("lx") - F.col("rx")) < 0.05) & (F.abs(F.col("ly") - F.col("ry")) < 0.05)).select(
        "page_id", "seq").distinct()
    return surf.join(hit, ["page_id", "seq"], "left_semi")


def fuse_perception(dom: DataFrame, visual: DataFrame, mode: str = "fused", cell: float = 0.25) -> DataFrame:
    """Element view, visual view, or both fused where boxes overlap by 0.25.

    ``dom(capture_id, dom_id, role, name, x, y, w, h)``; ``visual(capture_id, vis_id, role, x, y, w, h,
    edge_confidence)``. Both box sets are ``x, y, w, h``; convert ``[ymin, xmin, ymax, xmax]`` at read.
    """
    def cents(c):
        return F.floor(c * 100 + 0.5) / 100

    vname = F.concat(F.lit("[VISUAL_"), F.upper("role"), F.lit("_"), F.col("vis_id").cast("string"), F.lit("]"))
    null_id, null_d = F.lit(None).cast("long"), F.lit(None).cast("double")

    def dom_rows(df, conf):
        return df.select("capture_id", F.lit("dom").alias("provenance"), "role", "name", F.col("dom_id").cast("long").alias("dom_id"),
                         null_id.alias("vis_id"), F.lit(conf).alias("confidence"), null_d.alias("agreement"))

    def vis_rows(df, scale):
        conf = F.col("edge_confidence") if scale is None else cents(F.col("edge_confidence") * scale)
        return df.select("capture_id", F.lit("vision").alias("provenance"), "role", vname.alias("name"), null_id.alias("dom_id"),
                         F.col("vis_id").cast("long").alias("vis_id"), conf.alias("confidence"), null_d.alias("agreement"))

    if mode == "dom-only":
        return dom_rows(dom, 0.85)
    if mode == "vision-only":
        return vis_rows(visual, None)
    a = dom.select("capture_id", F.col("dom_id").alias("left"), *[F.col(c).alias(f"l{c}") for c in "xywh"])
    b = visual.select("capture_id", F.col("vis_id").alias("right"), *[F.col(c).alias(f"r{c}") for c in "xywh"])
    # An element takes its best free proposal whatever the overlap and is unmatched below 0.25, so
    # pairs below 0.25 never decide anything.
    pairs = close_boxes(a, b, ["capture_id"], cell).withColumn("score", iou(*_boxes("l"), *_boxes("r"))).filter(
        "score >= 0.25").select("capture_id", "left", "right", "score")
    matched = greedy_match(pairs, ["capture_id"])
    linked = dom.join(matched.select("capture_id", F.col("left").alias("dom_id"), F.col("right").alias("_v"),
                                     F.col("score").alias("_i")), ["capture_id", "dom_id"], "left")
    roles = visual.select("capture_id", F.col("vis_id").alias("_v"), F.col("role").alias("_vr"))
    fused = linked.filter("_v IS NOT NULL").join(roles, ["capture_id", "_v"])
    same = F.lower("role") == F.lower("_vr")
    conf = F.least(F.lit(1.0), cents(F.lit(0.75) + F.col("_i") * 0.2 + F.when(same, 0.05).otherwise(0.0)))
    both = fused.select("capture_id", F.lit("fused").alias("provenance"), "role", "name",
                        F.col("dom_id").cast("long").alias("dom_id"), F.col("_v").cast("long").alias("vis_id"),
                        conf.alias("confidence"), (F.floor(F.col("_i") * 1000 + 0.5) / 1000).alias("agreement"))
    alone = dom_rows(linked.filter("_v IS NULL"), 0.80)
    unseen = vis_rows(visual.join(matched.select("capture_id", F.col("right").alias("vis_id")),
                                  ["capture_id", "vis_id"], "left_anti"), 0.7)
    return both.unionByName(alone).unionByName(unseen)


# --- candidate scoring -------------------------------------------------------------

def normalize(col: Column) -> Column:
    """Lower case, everything but letters, digits, ``_`` and ``-`` to blanks, squashed."""
    out = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), rf"[^a-z0-9{WS[1:-1]}_-]", " ")
    return F.trim(F.regexp_replace(out, rf"{WS}+", " "))


def tokens(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda t: t != "")


def fuzzy(a: Column, b: Column) -> Column:
    """Equal, one a prefix (four characters at least) of the other, or a small edit distance."""
    la, lb = F.length(a), F.length(b)
    allowed = F.when(F.greatest(la, lb) >= 6, F.lit(2)).otherwise(F.lit(1))
    near = (F.abs(la - lb) <= 3) & (la >= 3) & (lb >= 3) & (
        ((la >= 4) & F.startswith(b, a)) | ((lb >= 4) & F.startswith(a, b)) | (F.levenshtein(a, b) <= allowed))
    return (a == b) | near


# Words that mean the same control, and names that say nothing.
SYNONYMS = {
    "chatbox": ("chat", "message", "ask", "follow-up", "followup", "prompt", "reply", "question", "input", "textbox",
                "searchbox", "textarea", "conversation", "say"),
    "chat": ("chatbox", "message", "ask", "follow-up", "followup", "prompt", "reply", "question", "input", "textbox",
             "conversation", "say"),
    "message": ("chat", "chatbox", "ask", "reply", "say", "text", "input", "prompt"),
    "searchbox": ("search", "find", "query", "filter", "input", "textbox"),
    "search": ("searchbox", "find", "query", "filter", "lookup", "input"),
    "input": ("chatbox", "searchbox", "field", "box", "textbox", "textarea", "prompt", "ask"),
}
GENERIC_NAMES = ("button", "link", "click", "press", "submit", "generic", "input", "field", "select", "item", "control")


def _fuzzy_vocabulary(a: DataFrame, b: DataFrame, block_key: str) -> DataFrame:
    """Fuzzy pairs ``at, bt`` of different tokens of one block.

    Tokens are counted once per block; pairs meet on shared deletion variants (up to two letters
    dropped) or on a shared four-letter prefix, which covers every fuzzy pair exactly.
    """
    def vocabulary(df, p):
        return df.select(block_key, F.col("token").alias(f"{p}t")).distinct()

    def keyed(df, p):
        t = F.col(f"{p}t")
        at = F.sequence(F.lit(1), F.length(t))
        drop = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
        one = F.transform(at, lambda i: drop(t, i))
        two = F.when(F.length(t) >= 4, F.flatten(F.transform(one, lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s)), lambda i: drop(s, i))))).otherwise(F.array().cast("array<string>"))
        prefix = F.when(F.length(t) >= 4, F.array(F.concat(F.lit("^"), F.substring(t, 1, 4)))).otherwise(
            F.array().cast("array<string>"))
        variants = F.when(F.length(t) >= 3, F.array_distinct(F.concat(F.array(t), one, two, prefix))).otherwise(F.array(t))
        return df.withColumn("_k", F.explode(variants))

    va, vb = keyed(vocabulary(a, "a"), "a"), keyed(vocabulary(b, "b"), "b")
    return va.join(vb, [block_key, "_k"]).select(block_key, "at", "bt").distinct().filter(fuzzy(F.col("at"), F.col("bt")))


# Parts that the rows of one side of a class are dealt into; the other side's rows are in each of them.
DEALT = 16


def fuzzy_join(a: DataFrame, b: DataFrame, block_key: str) -> DataFrame:
    """U15 as a join: ``a_id, b_id, distance`` of all rows whose tokens are a fuzzy pair of one block.

    Rows of like tokens give all their pairs; :func:`fuzzy_classes` says the same in as many rows as there are rows and pairs of tokens.
    The pairs grow with the square of a block, so a class is no one task: its rows are dealt into ``DEALT`` parts.
    """
    pairs = _fuzzy_vocabulary(a, b, block_key).withColumn("distance", F.levenshtein("at", "bt"))
    left = a.select(block_key, F.col("token").alias("at"), F.col("id").alias("a_id"), F.pmod(F.xxhash64("id"), F.lit(DEALT)).cast("int").alias("_part"))
    right = b.select(block_key, F.col("token").alias("bt"), F.col("id").alias("b_id"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"))
    return left.join(pairs, [block_key, "at"]).repartition(block_key, "bt", "_part").join(right, [block_key, "bt", "_part"]).select("a_id", "b_id", "distance")


def fuzzy_classes(a: DataFrame, b: DataFrame, block_key: str) -> DataFrame:
    """U15 as a join of classes ``kind, id, class_id, distance``; a class is the rows of one side with one token of one block.

    ``kind`` ``a`` and ``b``: row ``id`` of that side is in the class named by its smallest id, ``class_id``. ``pair``: class ``id`` of
    ``a`` and class ``class_id`` of ``b`` are a fuzzy pair, and so is each row of the one with each row of the other.
    """
    def classes(df):
        return df.groupBy(block_key, "token").agg(F.min("id").alias("class_id"))

    def members(df, of, kind):
        d, c = df.alias("d"), of.alias("c")
        same = F.col(f"d.{block_key}").eqNullSafe(F.col(f"c.{block_key}")) & F.col("d.token").eqNullSafe(F.col("c.token"))
        return d.join(c, same).select(F.lit(kind).alias("kind"), "d.id", "c.class_id", F.lit(None).cast("int").alias("distance"))

    ca, cb = classes(a), classes(b)
    left, right = (c.select(block_key, F.col("token").alias(f"{p}t"), F.col("class_id").alias(f"{p}_id")) for c, p in ((ca, "a"), (cb, "b")))
    pairs = _fuzzy_vocabulary(a, b, block_key).join(left, [block_key, "at"]).join(right, [block_key, "bt"]).select(
        F.lit("pair").alias("kind"), F.col("a_id").alias("id"), F.col("b_id").alias("class_id"), F.levenshtein("at", "bt").alias("distance"))
    return pairs.unionByName(members(a, ca, "a")).unionByName(members(b, cb, "b"))


def score_candidates(elements: DataFrame, requests: DataFrame, key: str = "page_id") -> DataFrame:
    """Every element of a page against the page's requests: ``score, disqualified, exact_name``.

    ``elements(key, local_id, role, name, state[], caps[], container, heading, in_dialog)``;
    ``requests(key, request_id, intent, phrase, tokens[], role_hint, context, dialog_open)``. Requests of a
    page are few (what a user asked there); both sides share the page key.
    """
    els = elements.withColumn("_name", normalize(F.col("name"))).withColumn("_toks", tokens(F.col("name"))).withColumn(
        "_head", normalize(F.col("heading"))).withColumn("_cont", normalize(F.col("container")))
    req = requests.withColumn("_phrase", normalize(F.col("phrase"))).withColumn("_want", F.when(
        F.size("tokens") > 0, F.col("tokens")).otherwise(tokens(F.col("phrase")))).withColumn(
        "_ctx", normalize(F.col("context")))
    j = els.join(req, key)
    name, phrase, want, toks = F.col("_name"), F.col("_phrase"), F.col("_want"), F.col("_toks")
    has = lambda c: F.array_contains("caps", c)
    needed = (F.when(F.col("intent").isin("click", "dismiss"), has("click")).when(F.col("intent") == "type", has("type"))
              .when(F.col("intent") == "select", has("select")).when(F.col("intent") == "hover", has("hover") | has("click"))
              .when(F.col("intent") == "drag_and_drop", has("drag") | has("click"))
              .when(F.col("intent") == "upload_file", has("upload") | has("type")).otherwise(F.lit(True)))
    unable = (F.size("caps") > 0) & ~needed
    disabled = F.array_contains("state", "disabled")
    both = (name != "") & (phrase != "")
    by_name = (
        F.when(both & (name == phrase), 100)
        .when(both & (F.startswith(name, phrase) | F.startswith(phrase, name)), 65)
        .when((phrase != "") & F.contains(name, phrase), 50)
        .when(both & fuzzy(F.replace(name, F.lit(" "), F.lit("")), F.replace(phrase, F.lit(" "), F.lit(""))), 80)
        .otherwise(0))
    synonyms = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])

    def resolved(t):
        """struct(token found in the element or NULL, exact?)."""
        syn = F.get(F.filter(F.coalesce(F.try_element_at(synonyms, t), F.array().cast("array<string>")), lambda s: F.exists(
            F.col("_toks"), lambda e: fuzzy(s, e))), F.lit(0))
        near = F.get(F.filter(F.col("_toks"), lambda e: fuzzy(t, e)), F.lit(0))
        exact = F.array_contains(F.col("_toks"), t)
        return F.struct(F.when(exact, t).otherwise(F.coalesce(syn, near)).alias("m"), exact.alias("e"))

    j = j.withColumn("_res", F.when((F.size(want) > 0) & (F.size(toks) > 0), F.transform(want, resolved)))
    hits = F.filter("_res", lambda r: r["m"].isNotNull())
    n_exact, n_all, n_want = F.size(F.filter("_res", lambda r: r["e"])), F.size(hits), F.size(want)
    ratio = n_all / n_want
    by_token = F.when(F.col("_res").isNull(), 0).when(n_exact == n_want, 40).when(n_all == n_want, 35).when(
        ratio >= 0.5, F.floor(ratio * 30 + 0.5)).otherwise(0)
    places = F.transform(F.concat(F.filter(hits, lambda r: r["e"]), F.filter(hits, lambda r: ~r["e"])),
                         lambda r: F.array_position(F.col("_toks"), r["m"]))
    rising = F.forall(F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(1))), lambda x, y: F.struct(
        x.alias("x"), y.alias("y"))), lambda p: p["y"].isNull() | (p["y"] > p["x"])) & (F.get(places, F.lit(0)) > 0)
    in_order = F.when((n_all > 1) & rising, 15).otherwise(0)
    asked = (phrase != "") | (n_want > 0)

    def mentions(c):
        return ((phrase != "") & F.contains(c, phrase)) | F.exists(want, lambda t: F.contains(c, t))

    by_context = F.when(asked & mentions(F.col("_head")), 70).when(asked & mentions(F.col("_cont")), 55).otherwise(0)
    by_role = (F.when(F.coalesce("role_hint", F.lit("")) == "", 0).when(F.col("role") == F.col("role_hint"), 20)
               .when(F.col("role").isin("button", "link") & F.col("role_hint").isin("button", "link"), -5).otherwise(-25))
    by_qualifier = (F.when(F.coalesce("context", F.lit("")) == "", 0).when(
        (F.col("_cont") != "") & (F.col("_ctx") != ""), F.when(F.contains("_cont", F.col("_ctx")), 80).otherwise(-50)).otherwise(-20))
    by_dialog = F.when(F.col("dialog_open"), F.when(F.col("in_dialog"), 25).otherwise(-20)).otherwise(0)
    generic = F.when(name.isin(*GENERIC_NAMES) & (phrase != "") & ~phrase.isin(*GENERIC_NAMES), -30).otherwise(0)
    total = F.greatest(F.lit(0), by_name + F.coalesce(by_token, F.lit(0)) + F.coalesce(in_order, F.lit(0)) + by_context + by_role
                       + by_qualifier + by_dialog + generic)
    score = F.when(unable | disabled, 0).when(~asked, 50).otherwise(total)
    return j.withColumn("score", score.cast("int")).select(
        key, "request_id", "local_id", "role", "name", F.col("_name").alias("norm_name"), "score",
        (F.coalesce("context", F.lit("")) != "").alias("has_context"), (F.col("score") == 0).alias("disqualified"))


def rank_candidates(scored: DataFrame, threshold: int = 35, key: str = "page_id") -> DataFrame:
    """Candidates at or above the threshold, best first; equal scores keep element order."""
    w = Window.partitionBy(key, "request_id").orderBy(F.desc("score"), "local_id")
    return scored.filter(~F.col("disqualified") & (F.col("score") >= threshold)).withColumn("rank", F.row_number().over(w))


def ambiguity(ranked: DataFrame, key: str = "page_id") -> DataFrame:
    """Best candidate per request and whether the runner-up makes it ambiguous."""
    top = ranked.filter("rank <= 2").groupBy(key, "request_id").agg(*[
        F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2)
        for c in ("local_id", "score", "norm_name", "has_context")])
    gap = F.col("score1") - F.col("score2")
    close = (gap < 15) & (F.col("score1") >= 50) & (F.col("score2") >= 50)
    twins = (F.col("norm_name1") == F.col("norm_name2")) & ~F.col("has_context1") & (gap == 0)
    unclear = F.coalesce(close | twins, F.lit(False))
    return top.select(key, "request_id", F.col("local_id1").alias("best"), F.col("score1").alias("score"), F.when(
        unclear, F.lit("ambiguous_match")).otherwise(F.lit("unambiguous_match")).alias("status"))


# --- top-k ---------------------------------------------------------------------------

def top_elements(elements: DataFrame, n: int = 80, key: str = "page_id") -> DataFrame:
    """View, dialog and role points; then height on the page, then id."""
    role = (F.when(F.col("role").isin("input", "textarea", "select"), 40).when(F.col("role") == "button", 35)
            .when(F.col("is_primary_nav"), 30).when(F.col("role").isin("link", "tab", "menuitem"), 25).otherwise(5))
    points = F.when(F.col("in_viewport"), 100).otherwise(0) + F.when(F.col("in_dialog"), 30).otherwise(0) + role
    w = Window.partitionBy(key).orderBy(F.desc("points"), "y", "local_id")
    return elements.withColumn("points", points).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_payload(elements: DataFrame, n: int = 180, key: str = "page_id") -> DataFrame:
    """Dialog first, then role class, then in view, then height; original order on ties."""
    role = (F.when(F.col("role").isin("input", "textarea", "select"), 4).when(F.col("role") == "button", 3)
            .when(F.col("role").isin("tab", "menuitem"), 2).otherwise(1))
    seen = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    w = Window.partitionBy(key).orderBy(F.desc(F.col("in_dialog").cast("int")), F.desc(role), F.desc(seen.cast("int")), "y",
                                        "local_id")
    return elements.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
