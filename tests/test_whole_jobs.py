"""Queries do the whole job their names promise, on rows of the tests' own."""

from __future__ import annotations

from collections import Counter

import duckdb

from __spark_entry__ import oracle_sql, queries


def _both(spark, tmp_path, name, **tables):
    """Rows of a query, and of its SQL, as counts of dictionaries."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries()[name](spark, str(tmp_path))
    rel = con.execute(oracle_sql()[name])
    at = [c[0] for c in rel.description]
    assert sorted(at) == sorted(df.columns)
    want = Counter(frozenset(zip(at, r, strict=True)) for r in rel.fetchall())
    return Counter(frozenset(r.asDict().items()) for r in df.collect()), want


def test_fuzzy_tokens_gives_every_pair_of_rows(spark, tmp_path):
    words = ["gizmo", "gizmos", "gear", "ear", "plate", "late"]
    part = spark.createDataFrame([(i, f"old {words[i % 6]} LARGE", i % 3 if i % 20 else None) for i in range(120)], "p_partkey long, p_name string, p_size int")
    got, want = _both(spark, tmp_path, "fuzzy_tokens", part=part)
    assert got == want
    rows = {i: (words[i % 6], i % 3) for i in range(120) if i % 20}
    ids = {(dict(r)["a_id"], dict(r)["b_id"]) for r in got}
    for i, (token, block) in rows.items():  # every row of a word meets every other row of it that keeps its first letter
        assert {j for j, (t, k) in rows.items() if t == token and k == block and j % 2 == 0} <= {b for a, b in ids if a == i}


def test_privacy_gate_says_which_surfaces_are_covered(spark, tmp_path):
    # Boxes of one order, at (part % 60, supplier % 40); a part of remainder 2 by 4 is a token, which truth calls a surface.
    places = {1: [(2, 0), (1, 0), (3, 0)], 2: [(1, 9), (3, 9), (5, 9), (7, 9), (1, 9), (3, 9), (18, 9)], 3: [(58, 30)], 4: [(1, 1)]}
    rows = [(o, p, s, n, 10.0, 5.0, 0.0, 0.0) for o, at in places.items() for n, (p, s) in enumerate(at, 1)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                     "l_discount double, l_tax double").selectExpr("*", "timestamp '2020-01-01' AS l_shipdate")
    got, want = _both(spark, tmp_path, "privacy_gate", lineitem=lineitem)
    # The seventh box of order 2 has its mask seven hundredths to the right, and no other mask there.
    assert got == want == Counter([frozenset({"leaks": 0, "checked": 2, "covered": 2, "total": 3, "safe_kept": 12, "safe_total": 12}.items())])
