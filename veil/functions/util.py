"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.rules import WS


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A filter or field asked of a plain column is moved below it, and Spark repeats the column's expression for each place that
    names it; nothing is moved below a generator.
    """
    both = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode_outer(F.array(both)).alias("_settled")).select(*df.columns, *[F.col("_settled")[n].alias(n) for n in columns])


def trim_ws(col: Column) -> Column:
    """Trim the wide white-space class on both ends."""
    return F.regexp_replace(col, rf"^{WS}+|{WS}+\z", "")


def squash_ws(col: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, rf"{WS}+", " "))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def any_contains(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def half_up(col: Column, digits: int) -> Column:
    """Round half up through ``floor``, the same arithmetic every engine agrees on."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / scale


def safe_div(num: Column, den: Column) -> Column:
    """NULL, never a made-up 100 %, when the denominator is zero."""
    return num / F.nullif(den, F.lit(0))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL."""
    return F.get(all_matches(text, pattern, group), F.lit(0))


def first_n_distinct(items: Column, n: int) -> Column:
    return F.slice(F.array_distinct(items), 1, n)


def replace_matches(text: Column, pattern: str, body) -> Column:
    """Every match goes through ``body``; the text between matches stays as it is."""
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(gaps, all_matches(text, pattern), lambda g, m: F.concat(
        g, F.when(m.isNull(), F.lit("")).otherwise(body(m))))
    return F.array_join(pieces, "")
