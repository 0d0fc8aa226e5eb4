"""Checksum expressions: Luhn and Verhoeff, as folds over digit positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions import text_sql as S
from veil.functions.rules import WS_CHARS

# The Verhoeff base permutation and the dihedral inverses.
_BASE_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
_INVERSE = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten, the group the scheme is defined on."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - b - 5) % 5 if b < 5 else (a - b) % 5


def _permutation_rows() -> list[int]:
    row, rows = list(range(10)), []
    for _ in range(8):
        rows.extend(row)
        row = [_BASE_PERMUTATION[d] for d in row]
    return rows


def _array(values) -> str:
    return "array(" + ", ".join(str(v) for v in values) + ")"


_PRODUCT = _array(_dihedral(a, b) for a in range(10) for b in range(10))
_PERMUTED = _array(_permutation_rows())


def _digits(value: str) -> str:
    return f"regexp_replace({value}, {S.lit(f'[{WS_CHARS}-]')}, '')"


def luhn_sql(value: str) -> str:
    """13-19 digits after dropping blanks and dashes, Luhn sum divisible by ten. Never NULL."""
    def check(t):
        a, i = S.fresh("a"), S.fresh("i")
        digit = f"(ascii(substring({t}, length({t}) - {i}, 1)) - 48)"
        step = f"{a} + CASE WHEN {i} % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
        total = f"aggregate(sequence(0, length({t}) - 1), 0, ({a}, {i}) -> {step})"
        return f"coalesce(CASE WHEN rlike({t}, r'^\\d{{13,19}}\\z') THEN {total} % 10 = 0 END, false)"

    return S.let(_digits(value), check)


def _verhoeff_state(t: str, offset: int) -> str:
    a, i = S.fresh("a"), S.fresh("i")
    digit = f"(ascii(substring({t}, length({t}) - {i}, 1)) - 48)"
    moved = f"get({_PERMUTED}, (({i} + {offset}) % 8) * 10 + {digit})"
    return f"aggregate(sequence(0, length({t}) - 1), 0, ({a}, {i}) -> get({_PRODUCT}, {a} * 10 + {moved}))"


def verhoeff_sql(value: str) -> str:
    return f"coalesce(CASE WHEN rlike({value}, r'^\\d+\\z') THEN {_verhoeff_state(value, 0)} = 0 END, false)"


def twelve_digit_id_sql(value: str) -> str:
    """Twelve digits, first 2-9, not one repeated digit, Verhoeff-valid."""
    def check(t):
        shape = f"rlike({t}, r'^[2-9]\\d{{11}}\\z') AND NOT rlike({t}, r'^(\\d)\\1{{11}}\\z')"
        return f"coalesce(CASE WHEN {shape} THEN {_verhoeff_state(t, 0)} = 0 END, false)"

    return S.let(_digits(value), check)


def verhoeff_digit_sql(value: str) -> str:
    """The digit that makes ``value`` Verhoeff-valid when appended; NULL for non-digits."""
    return f"CASE WHEN rlike({value}, r'^\\d+\\z') THEN get({_array(_INVERSE)}, {_verhoeff_state(value, 1)}) END"


def luhn_ok(col_name: str) -> Column:
    return F.expr(luhn_sql(col_name))


def twelve_digit_id_ok(col_name: str) -> Column:
    return F.expr(twelve_digit_id_sql(col_name))


def verhoeff_ok(col_name: str) -> Column:
    return F.expr(verhoeff_sql(col_name))


def verhoeff_digit(col_name: str) -> Column:
    return F.expr(verhoeff_digit_sql(col_name))
