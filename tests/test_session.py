"""Processor-heavy scans get tasks of few rows, however small their files are."""

from veil import session
from veil.plans.derived import table


def test_a_small_file_of_many_rows_is_spread(spark, tmp_path):
    n = 12 * session.HEAVY_ROWS
    spark.range(n).selectExpr("id % 7 AS o_orderkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    df = table(spark, str(tmp_path), "orders", heavy=True)
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == n and len(sizes) == 12 and max(sizes) < 1.1 * session.HEAVY_ROWS
