"""Span expressions: where a rule matches, computed inside the JVM.

Offsets come from two built-ins: ``split`` gives the text between the matches and
``regexp_extract_all`` the matches themselves; folding both yields ``(start, end)``.
No Python touches the text, and a cheap guard keeps most rows away from the
expensive pattern. Everything here takes and returns SQL text (see ``text_sql``);
the ``*_col`` functions wrap it as columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.functions import checks
from veil.functions import text_sql as S
from veil.functions.rules import BIRTH_LABEL, MAYBE_SENSITIVE, RULES, Rule

MATCH_TYPE = "array<struct<start:int,end:int,text:string>>"
# `start, rule_seq` first, so that sorting the array gives the documented span order.
SPAN_TYPE = "array<struct<start:int,rule_seq:int,end:int,category:string,confidence:double>>"
NO_SPANS = f"cast(array() as {SPAN_TYPE})"


def match_ranges(text: str, pattern: str, group: int = 0) -> str:
    """``array<struct<start,end,text>>`` of every match, 0-based, end exclusive.

    With ``group`` the range is that capture, located by its first occurrence inside
    the whole match; a match whose capture is empty yields nothing.
    """
    a, x = S.fresh("a"), S.fresh("x")
    pat = S.lit(pattern)
    gap, hit, cap = f"{x}.`0`", f"{x}.`1`", f"{x}.`2`"
    at = f"{a}.pos + length({gap})" + (f" + instr({hit}, {cap}) - 1" if group else "")
    found = f"array(named_struct('start', {at}, 'end', {at} + length({cap}), 'text', {cap}))"
    step = (
        f"named_struct('pos', {a}.pos + length({gap}) + coalesce(length({hit}), 0), "
        f"'out', CASE WHEN length({cap}) > 0 THEN concat({a}.out, {found}) ELSE {a}.out END)"
    )
    none = f"cast(array() as {MATCH_TYPE})"

    def fold(whole):
        part = f"regexp_extract_all({text}, {pat}, {group})" if group else whole
        return (
            f"CASE WHEN size({whole}) = 0 THEN {none} ELSE aggregate(zip_with(split({text}, {pat}, -1), "
            f"zip_with({whole}, {part}, (h, c) -> named_struct('hit', h, 'cap', c)), "
            f"(g, m) -> named_struct('0', g, '1', m.hit, '2', m.cap)), "
            f"named_struct('pos', 0, 'out', {none}), ({a}, {x}) -> {step}, {a} -> {a}.out) END"
        )

    # Splitting is only worth its second pass over the text when something was found.
    return S.let(f"regexp_extract_all({text}, {pat}, 0)", fold)


def _accept(rule: Rule, text: str, x: str) -> str | None:
    if rule.check == "luhn":
        return checks.luhn_sql(f"{x}.text")
    if rule.check == "verhoeff":
        return checks.twelve_digit_id_sql(f"{x}.text")
    if rule.check == "eight_digits":
        return f"length(regexp_replace({x}.text, r'\\D', '')) >= 8"
    if rule.check == "eight_chars":
        return f"length({x}.text) >= 8"
    if rule.check == "birth_label":
        begin = f"greatest(0, {x}.start - 40)"
        return S.rlike(f"substring({text}, {begin} + 1, {x}.start - {begin})", BIRTH_LABEL)
    return None


def guard_sql(text: str, guard: str) -> str:
    plain = not any(c in guard for c in r"\[](){}.*+?|^$")
    return f"contains({text}, {S.text(guard)})" if plain else S.rlike(text, guard)


def rule_spans(text: str, rule: Rule) -> str:
    """Spans of one rule, before any look at the other rules' spans."""
    found = match_ranges(text, rule.pattern, rule.group)
    if rule.check:
        x = S.fresh("x")
        found = f"filter({found}, {x} -> {_accept(rule, text, x)})"
    x = S.fresh("x")
    shaped = (
        f"transform({found}, {x} -> named_struct('start', {x}.start, 'rule_seq', {rule.seq}, 'end', {x}.end, "
        f"'category', '{rule.category}', 'confidence', {rule.confidence}D))"
    )
    return f"CASE WHEN {guard_sql(text, rule.guard)} THEN {shaped} ELSE {NO_SPANS} END"


def all_spans(text: str, rules=RULES, public_handles: bool = False, prefilter: bool = False) -> str:
    """All rules over one text, in rule order; never NULL.

    A rule marked ``skip_covered`` drops its spans that an earlier span contains.
    The result is ordered by start, then rule. ``prefilter`` skips texts without any
    of ``[0-9@+]``; that is faster but loses phrase-only hits, so it is off.
    """
    active = [r for r in rules if not (public_handles and r.handle)]
    groups = ", ".join(
        f"named_struct('skip', {str(r.skip_covered).lower()}, 'spans', {rule_spans(text, r)})" for r in active)
    a, g, x, m = (S.fresh(p) for p in "agxm")
    covered = f"exists({a}, {m} -> {m}.start <= {x}.start AND {m}.end >= {x}.end)"
    fold = f"concat({a}, filter({g}.spans, {x} -> NOT ({g}.skip AND {covered})))"
    # Most rules find nothing, so only those that do are folded.
    hit = f"filter(array({groups}), {g} -> size({g}.spans) > 0)"
    spans = f"sort_array(aggregate({hit}, {NO_SPANS}, ({a}, {g}) -> {fold}))"
    wanted = f"{text} IS NOT NULL" + (f" AND rlike({text}, '[0-9@+]')" if prefilter else "")
    if len(active) > 1 and set(active) <= set(RULES):
        # One look instead of a guard for each rule; most names and other short pieces end here.
        wanted += f" AND {S.rlike(text, MAYBE_SENSITIVE)}"
    return f"CASE WHEN {wanted} THEN {spans} ELSE {NO_SPANS} END"


def cut_spans(text: str, spans: str) -> str:
    """Replace ordered spans by markers; a span that begins inside the previous one only widens the cut."""
    a, s = S.fresh("a"), S.fresh("s")
    kept = f"substring({text}, {a}.last + 1, {s}.start - {a}.last)"
    mark = f"concat('[REDACTED_', upper({s}.category), ']')"
    step = (
        f"named_struct('parts', CASE WHEN {s}.start < {a}.last THEN {a}.parts "
        f"ELSE concat({a}.parts, array({kept}, {mark})) END, 'last', greatest({a}.last, {s}.end))"
    )
    tail = f"substring({text}, {a}.last + 1, length({text}) - {a}.last)"
    start = "named_struct('parts', cast(array() as array<string>), 'last', 0)"
    folded = f"aggregate({spans}, {start}, ({a}, {s}) -> {step}, {a} -> concat(array_join({a}.parts, ''), {tail}))"
    return f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {folded} END"


def masked(text: str, rules=RULES, public_handles: bool = False) -> str:
    return S.let(all_spans(text, rules, public_handles), lambda s: cut_spans(text, s))


def spans_col(name: str, rules=RULES, public_handles: bool = False, prefilter: bool = False) -> Column:
    return F.expr(all_spans(name, rules, public_handles, prefilter))


def cut_col(name: str, spans_name: str) -> Column:
    return F.expr(cut_spans(name, spans_name))


def masked_col(name: str, rules=RULES, public_handles: bool = False) -> Column:
    return F.expr(masked(name, rules, public_handles))
