"""Exact deduplication (operator 2) by sorting contents. DataFrame functions only.

Texts are equal when they are after deleting blank, tab, line feed, vertical tab, form feed and return. The
normalised texts are sorted: Spark samples splitters, deals the rows into ranges of (first characters, digest)
and sorts every range outside memory, so equal texts lie side by side; neighbours are compared in full, and in
each run of equals the first row by (most code points in the original, smallest id) stays.

A group with more than a thousandth of the rows (so there are at most a thousand) would fill a range of its own. The
groups' sizes, counted by digest with partial sums before the shuffle, show these; their rows are dealt over
``pieces`` ranges each, and size and winner come from the count.

Null text counts as empty, a null id sorts behind all others, and of repeated rows exactly one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm.common import texts, written

BLANKS = r"[\x20\x09-\x0D]+"
HEAD = 24


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, "").alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), F.col("doc_id"))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    many = max(1000, docs.select(id_col).count() // 1000)
    hot = written(sizes.where(F.col("n") > many).select("digest", F.col("n").alias("hot_n"), F.col("first.doc_id").alias("hot_id")), "hot-groups")

    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn("head", F.substring("body", 1, HEAD)).withColumn(
        "piece", F.when(F.col("hot_n").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(pieces))).otherwise(F.lit(0)))
    # Ranges of these three hold whole runs, so the window needs no further exchange.
    placed = dealt.repartitionByRange("head", "digest", "piece")
    run = Window.partitionBy("head", "digest", "piece", "body").orderBy(F.desc("size"), F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    judged = placed.select(
        "doc_id", "digest", "hot_n", "hot_id", F.row_number().over(run).alias("place"),
        F.first("doc_id").over(whole).alias("run_id"), F.count(F.lit(1)).over(whole).alias("run_n"))
    keep = F.when(F.col("hot_n").isNotNull(), F.col("hot_id")).otherwise(F.col("run_id"))
    return judged.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("hot_n", "run_n").alias("group_size"),
        ((F.col("place") == 1) & F.col("run_id").eqNullSafe(keep)).alias("kept"), F.col("digest").alias("text_sha256"))
