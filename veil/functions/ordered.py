"""Running values over a hot key, without one task per key.

A key is split into buckets of its order column. Each bucket is scanned on its own; what the
earlier buckets contribute is one row per bucket, so the second pass is small however many
rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FNS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.greatest(before, here) if kind == "max" else F.least(before, here)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, values: dict[str, tuple[Column, str]],
            exclusive: bool = False) -> DataFrame:
    """Add running aggregates ``{name: (column, 'sum'|'max'|'min'|'count')}`` in ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``. With ``exclusive`` the current row is left out.
    """
    staged = df.withColumn("_bkt", bucket)
    for name, (col, _) in values.items():
        staged = staged.withColumn(f"_v_{name}", col)
    part = staged.groupBy(*keys, "_bkt").agg(
        *[_FNS[kind](f"_v_{name}").alias(f"_p_{name}") for name, (_, kind) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*keys, "_bkt", *[
        (F.sum if kind in ("sum", "count") else _FNS[kind])(f"_p_{name}").over(earlier).alias(f"_c_{name}")
        for name, (_, kind) in values.items()])
    here = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if exclusive else 0)
    joined = staged.join(carry, [*keys, "_bkt"], "left")
    out = joined.select(*df.columns, *[
        _combine(kind, F.col(f"_c_{name}"), _FNS[kind](f"_v_{name}").over(here)).alias(name)
        for name, (_, kind) in values.items()])
    return out


def lagged(df: DataFrame, keys: list[str], bucket: Column, order: list[str], cols: list[str], depth: int = 1) -> DataFrame:
    """Add ``lag1_<col> .. lag<depth>_<col>``: the values of the previous rows of the key.

    ``order`` are ascending column names that order the rows of a key completely.
    """
    staged = df.withColumn("_bkt", bucket)
    here = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    back = Window.partitionBy(*keys, "_bkt").orderBy(*[F.desc(c) for c in order])
    row = F.struct(*order, *[c for c in cols if c not in order])
    tails = staged.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= depth).groupBy(*keys, "_bkt").agg(
        F.array_sort(F.collect_list(row)).alias("_tail"))
    # Every bucket has a row, so the last `depth` buckets hold the last `depth` rows.
    before = F.flatten(F.collect_list("_tail").over(
        Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(-depth, -1)))
    carry = tails.select(*keys, "_bkt", before.alias("_before"))
    joined = staged.join(carry, [*keys, "_bkt"], "left").withColumn("_rn", F.row_number().over(here))
    adds = []
    for i in range(1, depth + 1):
        at = F.size("_before") - (F.lit(i) - F.col("_rn"))
        for c in cols:
            adds.append(F.when(F.col("_rn") > i, F.lag(c, i).over(here)).when(
                at >= 1, F.try_element_at("_before", F.when(at >= 1, at).otherwise(F.lit(1)))[c]).alias(f"lag{i}_{c}"))
    return joined.select(*df.columns, *adds)


def _code(value: str, kind: str) -> Column:
    """A long that never decreases with the value: the number itself, or the bits of a double in the order of their values."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(value).cast("long")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double")).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact values at places of the sorted list, per key: a place is a function of the number of values, counted from 0.

    A radix selection: equal values are counted first and the counts summed by the value's highest 22 and 43 bits. The
    place is looked up among the highest bits, then among the next 21 bits below the ones found, then among the values below
    those. Each step orders the children of one prefix, at most 4 million rows whatever values a key has; an outlier takes
    one prefix of its own. ``keys`` may be empty; rows of a NULL key form one key; NULL values do not count.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    leaf = df.filter(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    leaf = leaf.withColumn("_c", _code("_x", df.schema[value].dataType.simpleString())).select(
        "_g", "_x", "_n", F.shiftright("_c", 42).alias("_p1"), F.shiftright("_c", 21).alias("_p2"))
    second = leaf.groupBy("_g", "_p1", "_p2").agg(F.sum("_n").alias("_n"))
    first = second.groupBy("_g", "_p1").agg(F.sum("_n").alias("_n"))

    def before(part, by):
        return F.sum("_n").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")

    def holding(rows):
        return rows.filter("_at >= _before AND _at < _before + _n")

    total = F.sum("_n").over(Window.partitionBy("_g"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_total")).cast("long").alias("at")) for name, place in places.items()]))
    found = holding(first.select("_g", "_p1", "_n", before(["_g"], "_p1").alias("_before"), total.alias("_total")).withColumn("_w", wanted).withColumn(
        "_at", F.col("_w.at"))).select("_g", "_p1", F.col("_w.name").alias("_name"), (F.col("_at") - F.col("_before")).alias("_at"))
    for rows, prefix, by in ((second, "_p1", "_p2"), (leaf, "_p2", "_x")):
        below = rows.select("_g", prefix, by, "_n").join(found, ["_g", prefix])
        found = holding(below.withColumn("_before", before(["_g", "_name"], by))).select(
            "_g", by, "_name", (F.col("_at") - F.col("_before")).alias("_at"))
    return found.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == n, F.col("_x"))).alias(n) for n in places]).select(
        *[F.col(f"_g.{k}") for k in keys], *places)


def index_percentile(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact ``sorted[min(n - 1, floor(n * p))]`` per key; ``keys`` may be empty."""
    return order_statistics(df, keys, value, {
        name: lambda n, p=p: F.least(n - 1, F.floor(n * F.lit(p)).cast("long")) for name, p in shares.items()})


def averaging_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key: of an even number of values the mean of the two in the middle."""
    two = order_statistics(df, keys, value, {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2)})
    return two.select(*keys, ((F.col("_lower") + F.col("_upper")) / 2).alias(name))
