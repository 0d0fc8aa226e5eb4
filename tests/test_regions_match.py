"""Geometry, folds and matching, the large-group paths included."""

import random

from pyspark.sql import functions as F

from veil.functions import blocking
from veil.operators import match, regions

META = "1000.0 viewport_w, 500.0 viewport_h, 2000.0 screen_w, 1000.0 screen_h, 0.0 scroll_x, 0.0 scroll_y"


def test_screenshot_box(spark):
    df = spark.sql(f"SELECT 100.0 x, 50.0 y, 200.0 w, 40.0 h, {META}")
    r = regions.to_screenshot(df, None, 4).first()
    assert (r.sx_x, r.sx_y, r.sx_w, r.sx_h) == (196, 96, 408, 88)


def test_merge_looks_only_at_the_last_box(spark):
    boxes = [(1, "c", 10.0, 10.0, 50.0, 20.0), (1, "c", 40.0, 15.0, 60.0, 30.0), (1, "c", 200.0, 200.0, 50.0, 50.0),
             # Touches the first merged box but not the one before it.
             (2, "c", 0.0, 0.0, 100.0, 10.0), (2, "c", 10.0, 50.0, 10.0, 10.0), (2, "c", 20.0, 5.0, 10.0, 10.0)]
    df = spark.createDataFrame(boxes, "capture_id int, category string, x double, y double, w double, h double")
    out = regions.merge_boxes(df).collect()
    assert sorted((r.x, r.w, r.h) for r in out if r.capture_id == 1) == [(10.0, 90.0, 35.0), (200.0, 50.0, 50.0)]
    assert len([r for r in out if r.capture_id == 2]) == 3


def random_boxes(n, seed, groups=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(groups), i, rnd.random() * 3, rnd.random() * 3, 0.3 + rnd.random(), 0.3 + rnd.random(), rnd.random()) for i in range(n)]


def iou(a, b):
    ix = max(0.0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    iy = max(0.0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    inter = ix * iy
    return inter / (a[4] * a[5] + b[4] * b[5] - inter)


def brute_nms(boxes, thr):
    kept = []
    for b in sorted(boxes, key=lambda r: (-r[6], r[1])):
        if all(k[0] != b[0] or iou(b, k) <= thr for k in kept):
            kept.append(b)
    return {b[1] for b in kept}


NMS = "capture_id int, det_id int, x double, y double, w double, h double, score double"


def test_nms(spark):
    boxes = random_boxes(120, 1)
    df = spark.createDataFrame(boxes, NMS)
    assert {r.det_id for r in regions.nms(df).collect()} == brute_nms(boxes, 0.35)
    assert regions.nms(df.limit(0)).collect() == []


def counted_rounds(monkeypatch):
    calls = []
    monkeypatch.setattr(match, "cut_lineage", lambda df, cut=match.cut_lineage: calls.append(1) or cut(df))
    return calls


def test_nms_chain_takes_few_rounds(spark, monkeypatch):
    # Each box overlaps the next one only, and every box waits for the one before it.
    boxes = [(0, i, 0.4 * i, 0.0, 1.0, 1.0, 1000.0 - i) for i in range(300)]
    calls = counted_rounds(monkeypatch)
    kept = {r.det_id for r in regions.nms(spark.createDataFrame(boxes, NMS)).collect()}
    assert kept == brute_nms(boxes, 0.35) == set(range(0, 300, 2))
    assert len(calls) <= 3 + 3 * 10


def brute_greedy(pairs):
    used, out = set(), {}
    for left in sorted({p[1] for p in pairs}):
        best = max(((s, -r) for _, x, r, s in pairs if x == left and r not in used), default=None)
        if best:
            used.add(-best[1])
            out[left] = -best[1]
    return out


def test_greedy_match_page_and_pool(spark):
    rnd = random.Random(3)
    pairs = [(0, a, b, float(rnd.randrange(1, 6))) for a in range(25) for b in range(25) if rnd.random() < 0.25]
    df = spark.createDataFrame(pairs + pairs[:9], "page_id int, left int, right int, score double")
    want = brute_greedy(pairs)
    for out in (match.greedy_match(df), match.greedy_match(df, pooled=True)):
        assert [r for r in out.collect() if want[r.left] != r.right] == [] and out.count() == len(want)
    none = match.greedy_match(df.limit(0))
    assert none.columns == ["page_id", "left", "right", "score"] and none.count() == 0
    nulls = spark.createDataFrame([(None, *p[1:]) for p in pairs], df.schema)
    assert {r.left: r.right for r in match.greedy_match(nulls).collect()} == want


def test_greedy_match_chain_takes_few_rounds(spark, monkeypatch):
    # Left i would rather have what left i - 1 gets: each waits for the one before it.
    pairs = [(0, i, r, s) for i in range(300) for r, s in ((i - 1, 2.0), (i, 1.0)) if i or r == 0]
    calls = counted_rounds(monkeypatch)
    out = match.greedy_match(spark.createDataFrame(pairs, "page_id int, left int, right int, score double"))
    assert {r.left: r.right for r in out.collect()} == brute_greedy(pairs)
    assert len(calls) <= 12


def test_greedy_match_random_graphs(spark):
    rnd = random.Random(11)
    pairs = [(g, a, b, float(rnd.randrange(1, 4))) for g in range(6) for a in range(18) for b in range(max(0, a - 3), a + 3) if rnd.random() < 0.6]
    out = match.greedy_match(spark.createDataFrame(pairs, "page_id int, left int, right int, score double")).collect()
    for g in range(6):
        assert {r.left: r.right for r in out if r.page_id == g} == brute_greedy([p for p in pairs if p[0] == g])


def test_fuse_spatial_and_secret(spark):
    rows = [(1, 1, "token", "4532-0150", 0.0, 0.0, 1.0, 1.0), (1, 2, "credit_card", "4532 0150", 5.0, 5.0, 1.0, 1.0),
            (1, 3, "email", None, 0.1, 0.0, 0.8, 1.0), (1, 4, "phone", "ab", None, None, None, None), (1, 5, "phone", "ab", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id int, seq int, category string, text string, x double, y double, w double, h double")
    fused = regions.fuse_by_secret(df.select("page_id", "seq", "category", "text")).collect()
    assert sorted((r.seq, r.category) for r in fused) == [(1, "credit_card"), (3, "email"), (4, "phone"), (5, "phone")]
    spatial = {r.seq: r.category for r in regions.fuse_spatial(df).collect()}
    # The card replaced the token and moved its box, so the email no longer overlaps it.
    assert spatial == {1: "credit_card", 3: "email", 4: "phone", 5: "phone"}


def test_detection_pairs(spark):
    cols = "page_id int, category string, seq int, text string, x double, y double, w double, h double"
    dets = spark.createDataFrame([(1, "email", 0, "A@B.co ", 0.1, 0.1, 0.2, 0.1), (1, "email", 1, None, None, None, None, None), (1, "phone", 2, "x", 0.9, 0.9, 0.1, 0.1)], cols)
    gt = spark.createDataFrame([(1, "email", 0, "a@b.co", 0.8, 0.8, 0.1, 0.1), (1, "email", 1, None, None, None, None, None), (1, "phone", 2, None, 0.9, 0.9, 0.1, 0.1)], cols)
    got = sorted((r.category, r.left, r.right, round(r.score, 3)) for r in match.detection_pairs(dets, gt).collect())
    assert got == [("email", 0, 0, 1.5), ("email", 1, 1, 1.0), ("phone", 2, 2, 2.0)]


def test_candidates(spark):
    els = spark.sql("""SELECT 1 page_id, * FROM VALUES (1, 'link', 'View Details', array('enabled'), array('click'), 'Problem A17 row', CAST(NULL AS STRING), false),
        (2, 'link', 'View Details', array('enabled'), array('click'), 'Problem B22 row', CAST(NULL AS STRING), false),
        (3, 'button', 'Submit', array('disabled'), array('click'), '', CAST(NULL AS STRING), false) AS t(local_id, role, name, state, caps, container, heading, in_dialog)""")
    req = spark.sql("""SELECT 1 page_id, * FROM VALUES (1, 'click', 'view details', cast(array() as array<string>), 'link', 'A17', false),
        (2, 'click', 'view details', cast(array() as array<string>), 'link', CAST(NULL AS STRING), false), (3, 'click', 'submit', cast(array() as array<string>), 'button', CAST(NULL AS STRING), false)
        AS t(request_id, intent, phrase, tokens, role_hint, context, dialog_open)""")
    out = {r.request_id: (r.best, r.status) for r in match.ambiguity(match.rank_candidates(match.score_candidates(els, req))).collect()}
    assert out == {1: (1, "unambiguous_match"), 2: (1, "ambiguous_match")}


def test_fuzzy(spark):
    pairs = [("knwo", "know", False), ("pass", "password", False), ("pass", "passwor", True), ("ab", "ac", False), ("submit", "sumbit", True), ("cat", "dog", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(match.fuzzy(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_boxes_without_a_category_are_measured(spark):
    boxes = spark.createDataFrame([(1, "face"), (2, None), (3, "email")], "id int, category string")
    assert {r["id"] for r in match.drop_unmeasured(boxes, ["face"]).collect()} == {2, 3}


def test_pooled_sequence_numbers_stay_apart(spark):
    from veil.operators import quality

    rows = spark.createDataFrame([(0, 1_000_000), (1, 0)], "page_order int, seq bigint").selectExpr("*", "7 AS page_id")
    assert quality._pool(rows).select("seq").distinct().count() == 2


def test_fuzzy_classes_say_what_all_pairs_say(spark):
    words = ["gizmo", "gizmos", "gear", "ear", "plate", "late", "", None, "ab"]
    rows = [(i, i % 3 if i % 50 else None, words[i % len(words)]) for i in range(300)]
    a = spark.createDataFrame(rows, "id long, blk long, token string")
    b = a.selectExpr("id + 1000 AS id", "blk", "substr(token, 1 + cast(id % 2 AS int)) AS token")
    got = match.fuzzy_classes(a, b, "blk").collect()
    of = {(r.kind, r.id): r.class_id for r in got if r.kind != "pair"}
    pairs = {(r.id, r.class_id): r.distance for r in got if r.kind == "pair"}
    full = {(x, y): pairs[of["a", x], of["b", y]] for k, x in of if k == "a" for j, y in of if j == "b" and (of["a", x], of["b", y]) in pairs}
    assert full == {(r.a_id, r.b_id): r.distance for r in match.fuzzy_join(a, b, "blk").collect()}
    assert len(of) == 600 and len(got) < 1000 < len(full)


def test_text_regions_search_each_text_once(spark):
    nodes = spark.range(40).selectExpr("id % 4 AS capture_id", "id AS node_id", "CASE id % 5 WHEN 4 THEN NULL ELSE concat('call u', id % 2, '@mail.example.com') END AS text",
                                       "cast(20 * id AS double) AS x", "1D AS y", "5D AS w", "5D AS h",
                                       "cast(NULL AS array<struct<category:string,rects:array<struct<x:double,y:double,w:double,h:double>>,fallback:struct<x:double,y:double,w:double,h:double>>>) AS ranges")
    meta = spark.range(4).selectExpr("id AS capture_id", "1280D AS viewport_w", "720D AS viewport_h", "1280D AS screen_w", "720D AS screen_h", "0D AS scroll_x", "0D AS scroll_y")
    got = regions.text_regions(nodes, meta)
    assert "Aggregate [text" in got._jdf.queryExecution().optimizedPlan().toString()
    # A node for each box: none is near another, and nodes without text have none.
    assert got.where("category = 'email'").count() == 32


def test_small_and_large_groups_pair_alike(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(p, i, "a", rng.choice(["", "v1", "v12", "go v1", "V1", None]), rng.choice(["x", "y"]),
             *[None if rng.random() < 0.1 else rng.randint(0, 20) / 10 for _ in range(2)], *[None if rng.random() < 0.1 else rng.randint(-1, 12) / 10 for _ in range(2)])
            for p in range(6) for i in range(3 + 9 * (p % 3))]
    df = spark.createDataFrame(rows, "page_id int, seq int, category string, name string, role string, x double, y double, w double, h double").withColumn("text", F.col("name"))
    left, right = df, df.filter("seq % 2 = 0").withColumn("x", F.col("x") + 0.1)

    def results():
        hit, missed = match.coverage(left, right)
        found = [match.element_pairs(left, right), match.detection_pairs(left, right), match.preserved(right, left), hit, missed]
        return [sorted(map(tuple, d.collect()), key=repr) for d in found]

    monkeypatch.setattr(blocking, "FEW", 0)  # all groups by cells and grams
    by_cells = results()
    for few in (12, 1000):
        monkeypatch.setattr(blocking, "FEW", few)
        assert results() == by_cells
    assert all(by_cells)
    # Groups of few rows meet by their key alone: no row of theirs is dealt out by cell or gram.
    dealt = []
    for name in ("touching_boxes", "containing_text"):
        monkeypatch.setattr(match, name, lambda a, b, *rest, f=getattr(match, name): dealt.append(a.count() + b.count()) or f(a, b, *rest))
    match.element_pairs(left, right)
    match.preserved(right, left)
    assert dealt == [0] * 5
