"""Helpers for expressions kept as Spark SQL text.

The span rules make large expressions. Written as SQL they are parsed inside the JVM
in one call, instead of one Python-to-JVM call per node, and they nest inside lambdas.
Every helper takes and returns SQL text.
"""

from __future__ import annotations

from itertools import count

_names = count()


def fresh(prefix: str = "v") -> str:
    """A lambda variable name nobody else uses."""
    return f"{prefix}_{next(_names)}"


def lit(pattern: str) -> str:
    """A raw string literal; quotes become regex escapes, so only use it for patterns."""
    return "r'" + pattern.replace('\\"', '"').replace("'", r"\x27").replace('"', r"\x22") + "'"


def text(value: str) -> str:
    """A plain string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names(values) -> str:
    return ", ".join(text(v) for v in values)


def let(value: str, body) -> str:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable."""
    v = fresh()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def rlike(value: str, pattern: str) -> str:
    return f"rlike({value}, {lit(pattern)})"


def replace_all(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {lit(pattern)}, {text(by)})"


def case(*branches: tuple[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {whens} ELSE {otherwise} END"


def replace_matches(value: str, pattern: str, body) -> str:
    """Every match goes through ``body``; the text between matches stays."""
    g, m = fresh("g"), fresh("m")
    return (
        f"array_join(zip_with(split({value}, {lit(pattern)}, -1), regexp_extract_all({value}, {lit(pattern)}, 0), "
        f"({g}, {m}) -> concat({g}, CASE WHEN {m} IS NULL THEN '' ELSE {body(m)} END)), '')"
    )
