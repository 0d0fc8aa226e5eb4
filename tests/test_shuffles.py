"""Boxes are shuffled once, and small groups of them are merged without running values; results do not depend on either."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from veil.functions import blocking
from veil.operators import match, regions
from veil.plans.derived import BOX_ROWS, BOXES


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_are_numbered_before_their_columns_are_made(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3]), *(rnd.choice([None, *range(90)]) for _ in range(2)), rnd.choice([None, 1, 2]), *(float(rnd.randrange(4)) for _ in range(4))) for _ in range(200)]
    lineitem = spark.createDataFrame(rows + rows[:20], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                     "l_extendedprice double, l_discount double, l_tax double").selectExpr("*", "timestamp '2020-01-01' AS l_shipdate")
    old, new = (spark.sql(sql, lineitem=lineitem) for sql in (BOXES, BOX_ROWS))
    assert old.schema == new.schema and sorted(map(repr, old.collect())) == sorted(map(repr, new.collect()))
    plan = _plan(new)
    assert plan.index("concat(") < plan.index("Window")  # printed from the last step down


def test_small_groups_of_boxes_merge_without_running_values(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.randrange(9), rnd.choice("ab"), *(float(rnd.randrange(12)) for _ in range(4))) for _ in range(400)]
    rows += [(None, "a", 1.0, 1.0, 2.0, 2.0), (3, "a", None, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "capture_id int, category string, x double, y double, w double, h double")
    rows_in = []
    with monkeypatch.context() as m:
        m.setattr(regions, "running", lambda df, *a, run=regions.running, **k: rows_in.append(df.count()) or run(df, *a, **k))
        regions.merge_boxes(df.dropna())
    assert rows_in == [0, 0]
    got = sorted(map(repr, regions.merge_boxes(df).collect()))
    for small, hot in ((0, 10**6), (20, 10**6), (5, 10)):
        monkeypatch.setattr(regions, "SMALL", small)
        monkeypatch.setattr(blocking, "HOT", hot)
        assert sorted(map(repr, regions.merge_boxes(df).collect())) == got


def test_small_groups_of_pairs_are_chosen_without_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(6)]), rnd.randrange(5), rnd.randrange(5), float(rnd.randrange(1, 5))) for _ in range(150)]
    df = spark.createDataFrame(rows, "page_id int, left int, right int, score double").withColumn("role_ok", F.col("score") > 2)
    cuts = []
    monkeypatch.setattr(match, "cut_lineage", lambda x, cut=match.cut_lineage: cuts.append(1) or cut(x))
    got = sorted(map(repr, match.greedy_match(df, carry=("role_ok",)).collect()))
    assert len(cuts) == 1 and len(got) > 20
    for small, hot in ((0, 10**6), (12, 20)):
        monkeypatch.setattr(match, "SMALL", small)
        monkeypatch.setattr(blocking, "HOT", hot)
        assert sorted(map(repr, match.greedy_match(df, carry=("role_ok",)).collect())) == got
