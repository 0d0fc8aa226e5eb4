"""Exact blocking for joins on geometry and containment, so no group ever meets as all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """Intersection over union of two ``x, y, w, h`` boxes; 0 when there is no area."""
    ix = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = ix * iy
    union = F.greatest(F.lit(0.0), aw * ah) + F.greatest(F.lit(0.0), bw * bh) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _cells(df: DataFrame, x, y, w, h, cell: float, slack: float, prefix: str) -> DataFrame:
    def span(lo, size):
        first = F.floor((lo - slack) / cell)
        return F.sequence(first, F.greatest(first, F.floor((lo + F.greatest(size, F.lit(0.0)) + slack) / cell)))

    return (df.withColumn(f"_{prefix}gx", F.explode_outer(span(F.col(x), F.col(w))))
            .withColumn(f"_{prefix}gy", F.explode_outer(span(F.col(y), F.col(h)))))


def _met(a: DataFrame, b: DataFrame, left_on: list[str], right_on: list[str], keys: list[str]) -> DataFrame:
    """``a`` joined with ``b``, the keys of ``b`` left out. By names, as both sides may come from one table."""
    own = {k: f"_right_{k}" for k in keys}
    cond = [F.col(x) == F.col(own.get(y, y)) for x, y in zip(left_on, right_on)]
    return a.join(b.withColumnsRenamed(own), cond).drop(*own.values())


def touching_boxes(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 0.25, slack: float = 0.0,
                   lbox=("lx", "ly", "lw", "lh"), rbox=("rx", "ry", "rw", "rh")) -> DataFrame:
    """Pairs whose boxes touch within ``slack``, each exactly once.

    Boxes meet in the grid cells they cover; of the shared cells only the one that holds the
    corner of the overlap reports the pair. Only boxes that are near each other are paired.
    """
    a = _cells(left, *lbox, cell, slack, "l")
    b = _cells(right, *rbox, cell, slack, "r")
    joined = _met(a, b, [*keys, "_lgx", "_lgy"], [*keys, "_rgx", "_rgy"], keys)
    owner_x = F.floor((F.greatest(F.col(lbox[0]), F.col(rbox[0])) - slack) / cell)
    owner_y = F.floor((F.greatest(F.col(lbox[1]), F.col(rbox[1])) - slack) / cell)
    return joined.filter((F.col("_lgx") == owner_x) & (F.col("_lgy") == owner_y)).drop("_lgx", "_lgy", "_rgx", "_rgy")


# Rows of a group on one side up to which the other side meets them all: fewer pairs than cells or grams, and no key but the group's.
FEW = 16


def by_size(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(few, left_many, right_many)``: ``right`` in groups of at most ``FEW`` of its rows, and both sides in all larger groups."""
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    many = sizes.filter(F.col("_n") > FEW).select(*keys)
    return right.join(sizes.filter(F.col("_n") <= FEW).select(*keys), keys, "left_semi"), *[d.join(many, keys, "left_semi") for d in (left, right)]


# Rows of a group from which on they are never taken to one task together.
HOT = 100_000


def dealt(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Add ``_hot``, true in groups of more than ``HOT`` rows, and ``_part``, which splits those by ``by`` and is 0 elsewhere.

    The list of such groups is at most a row for every ``HOT`` rows, so it is sent to all tasks. Rows of a NULL key are one group.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > HOT).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    marked = df.join(F.broadcast(large), same, "left").select(*df.columns, F.coalesce("_hot", F.lit(False)).alias("_hot"))
    return marked.withColumn("_part", F.when(F.col("_hot"), F.xxhash64(*by)).otherwise(F.lit(0).cast("long")))


def touch(cell: float = 0.25, slack: float = 0.0, lbox=("lx", "ly", "lw", "lh"), rbox=("rx", "ry", "rw", "rh")) -> Column:
    """Whether two boxes share a cell of the grid, without making the cells."""
    def ends(lo, size):
        first = F.floor((F.col(lo) - slack) / cell)
        return first, F.greatest(first, F.floor((F.col(lo) + F.greatest(F.col(size), F.lit(0.0)) + slack) / cell))

    def meet(k):
        (l0, l1), (r0, r1) = ends(lbox[k], lbox[k + 2]), ends(rbox[k], rbox[k + 2])
        return (l0 <= r1) & (r0 <= l1)

    return meet(0) & meet(1)


def close_boxes(left: DataFrame, right: DataFrame, keys: list[str], cell: float = 0.25, slack: float = 0.0) -> DataFrame:
    """The pairs of :func:`touching_boxes`; only groups with many boxes on the right are cut into cells."""
    few, left_many, right_many = by_size(left, right, keys)
    return left.join(few, keys).filter(touch(cell, slack)).unionByName(touching_boxes(left_many, right_many, keys, cell, slack))


GRAM = 4


def _needle_key(text: Column) -> Column:
    return F.substring(text, 1, GRAM)


def _hay_keys(text: Column) -> Column:
    """Every substring of length one to ``GRAM``: a contained needle's key is among them."""
    def grams(n):
        return F.when(F.length(text) >= n, F.transform(
            F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))

    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(n), none) for n in range(1, GRAM + 1)])))


def containing_text(needles: DataFrame, hays: DataFrame, keys: list[str], needle: str, hay: str,
                    gram: int | None = None) -> DataFrame:
    """Pairs where the hay's text contains the needle's text; texts are short (names, tokens).

    The needle is looked up by its first characters among the substrings of the hay, so pairs
    form only where those already agree; the full test follows. ``gram`` says that every needle
    has at least that many characters, which makes the lookup sharper.
    """
    if gram is None:
        a = needles.filter(F.length(needle) > 0).withColumn("_g", _needle_key(F.col(needle)))
        b = hays.filter(F.length(hay) > 0).withColumn("_h", F.explode_outer(_hay_keys(F.col(hay))))
    else:
        a = needles.withColumn("_g", F.substring(needle, 1, gram))
        b = hays.filter(F.length(hay) >= gram).withColumn("_h", F.explode_outer(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length(hay) - (gram - 1)), lambda i: F.substring(F.col(hay), i, F.lit(gram))))))
    joined = _met(a, b, [*keys, "_g"], [*keys, "_h"], keys)
    return joined.filter(F.contains(F.col(hay), F.col(needle))).drop("_g", "_h")
