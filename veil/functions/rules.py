"""Sensitive-text rules as data.

Patterns are written for ``java.util.regex``. Three habits keep them in step with
the ASCII semantics the rules were defined with:

* ``BL`` / ``BR`` stand for a word boundary in front of / behind a word character
  and are ASCII-only, so accented letters do not count as word characters;
* ``WS`` is the wide white-space class (NBSP, thin spaces, BOM, ...);
* ``\\z`` is used for end of text.

A rule is one row: pattern, category, confidence, whether group 1 is the span,
whether a span is dropped when an earlier rule already covers it, an optional
value check, and a cheap *guard* pattern every match must contain, so that most
texts never reach the expensive pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

WS_CHARS = r"\s   -     　﻿"
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
WORD = "[A-Za-z0-9_]"
BL = f"(?<!{WORD})"
BR = f"(?!{WORD})"
# A boundary where either side may be the word character.
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Openers that may stand directly in front of a span.
OPEN_QUOTED = rf"""(?:^|(?<=[{WS_CHARS}(\[{{"']))"""
OPEN_LISTED = rf"""(?:^|(?<=[{WS_CHARS}(\[{{:;,]))"""

# Canary prefixes planted by test pages; deployments add their own.
CANARY_PREFIXES = ("SECRET_CANARY",)


def canary_pattern(prefixes=CANARY_PREFIXES) -> str:
    return rf"{BL}(?:{'|'.join(prefixes)})[A-Za-z0-9_]*{BR}"


# ---------------------------------------------------------------------------
# Detection patterns. They must equal the published rule set.
# ---------------------------------------------------------------------------
MEDICAL = rf"(?i){BL}(?:medical note|clinical diagnosis|prescription info|patient record|doctor note){BR}[^\n.,;]*"
HANDLE = rf"{OPEN_QUOTED}(@[A-Za-z0-9_]{{1,30}}){BR}"
DELIVERY = rf"(?i){OPEN_QUOTED}(?:Deliver(?:y|ing)?{WS}+to|Ship{WS}+to|Shipping{WS}+to|Delivered{WS}+to){WS}+([^\n\r<]{{3,80}})"
HOME_WORK = rf"(?i){BL}(?:HOME|WORK|OFFICE|OTHER){WS}+(?:at{WS}+|-{WS}+)([^\n\r<]{{3,80}})"
PIN_CODE = (
    rf"(?i)(?:[A-Za-z]+[\-,]{WS}*|[,\-]{WS}*|{BL}(?:pin(?:{WS}*code)?|postal(?:{WS}*code)?|zip(?:{WS}*code)?)"
    rf"[{WS_CHARS}:\-,]*)([1-9][0-9]{{2}}{WS}?[0-9]{{3}}){BR}"
)
LOCALITY = (
    rf"(?i){BL}(?:Flat|House|H\.No|Plot|Shop|Room|Bldg|Building|Apartment|Apt){WS}*"
    rf"(?:(?:No\.?|#){WS}*[A-Za-z0-9/-]{{1,10}}|\d+[A-Za-z0-9/-]*){EDGE}"
    rf"|{BL}(?:Sector|Block|Pocket){WS}*(?:[-#]{WS}*[A-Za-z0-9/-]{{1,8}}|(?:No\.?|#){WS}*[A-Za-z0-9/-]{{1,8}}"
    rf"|\d+[A-Za-z0-9/-]*|[A-Z]{BR})"
    rf"|{BL}\d+(?:st|nd|rd|th)?{WS}+(?:Main|Cross)(?:{WS}+(?:Road|Rd))?{BR}"
    rf"|{BL}Main{WS}+(?:Road|Street){BR}"
    rf"|{BL}[A-Z][a-zA-Z0-9'-]+(?:{WS}+[A-Z][a-zA-Z0-9'-]+){{0,2}}{WS}+"
    rf"(?:Nagar|Colony|Enclave|Vihar|Kunj|Mohalla|Gali|Katra|Chowk|Bazar|Bazaar|Puram|Pally|Palli|Guda|Pura){BR}"
)
GREETING = rf"(?i){BL}(?:Hello|Hi|Welcome),{WS}+([A-Za-z0-9_]{{2,30}}){BR}"
STREET = (
    rf"(?i){BL}(?<![~≈])\d{{1,5}}(?:[/-]\d{{1,5}})?{WS}+"
    r"(?!(?:(?:km|kg|m/s|mb|gb|tb|hz|khz|mhz|ghz|cm|mm|meters?|miles?|hours?|hrs?|mins?|sec(?:onds?)?|days?|years?"
    rf"|percent|x|deg|v|w|a|k){BR}|%(?={WORD})))"
    rf"[A-Za-z0-9'.-]{{1,25}}(?:{WS}+[A-Za-z0-9'.-]{{1,25}}){{0,2}}{WS}+"
    rf"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir){BR}"
    rf"(?:{WS}+(?:Apt|Suite|Unit|Flat|Floor|#){WS}*[A-Za-z0-9/-]+)?"
)
MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    "|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)
BIRTH_DATE = (
    rf"(?i){BL}(?:\d{{1,2}}[{WS_CHARS}/-](?:{MONTHS})[{WS_CHARS}/-]\d{{2,4}}"
    rf"|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}[/-]\d{{1,2}}[/-]\d{{1,2}}){BR}"
)
BIRTH_LABEL = (
    rf"(?i)(?:^|[{WS_CHARS}(\[{{,;])(?:dob|date{WS}+of{WS}+birth|birth{WS}+date|birthday|bday){WS}*[:=\-]?{WS}*\z"
)
EMAIL = rf"{EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{BR}"
OBFUSCATED_EMAIL = (
    rf"(?i){OPEN_LISTED}[A-Za-z0-9._%+-]+(?:{WS}*\[at\]{WS}*|{WS}*\(at\){WS}*|{WS}*@{WS}*)[A-Za-z0-9.-]+"
    rf"(?:{WS}*\[dot\]{WS}*|{WS}*\(dot\){WS}*|{WS}*\.{WS}*)[A-Za-z]{{2,}}"
    rf"(?:{WS}*\[dot\]{WS}*[A-Za-z]{{2,}}|{WS}*\.{WS}*[A-Za-z]{{2,}})*"
)
LABELLED_EMAIL = (
    rf"(?i){OPEN_LISTED}(?:Email|E-mail|Mail)[{WS_CHARS}.:]*"
    rf"([^{WS_CHARS}<]+@[^{WS_CHARS}<]+|[A-Za-z0-9._%+-]+(?:{WS}*\[at\]{WS}*|{WS}*\(at\){WS}*)[^{WS_CHARS}<]+)"
)
TEN_DIGIT_PHONE = (
    rf"(?:^|(?<!\d))(?:\+?1[{WS_CHARS}.-]?)?\(?([0-9]{{3}})\)?[{WS_CHARS}.-]?([0-9]{{3}})[{WS_CHARS}.-]?([0-9]{{4}})(?!\d){BR}"
)
LABELLED_PHONE = (
    rf"(?i){OPEN_LISTED}(?:Phone|Tel(?:ephone)?|Mobile|Mob|Contact|Call|Fax)[{WS_CHARS}.:]*([+\d{WS_CHARS}()./-]{{7,35}})(?!\d)"
)
INDIAN_MOBILE = rf"(?:^|(?<!\d))(?:\+91[{WS_CHARS}-]?)?[6-9]\d{{4}}[{WS_CHARS}-]?\d{{5}}(?!\d){BR}"
INDIAN_LANDLINE = (
    rf"{OPEN_LISTED}(?:\+91[{WS_CHARS}-]?)?0?\d{{2,4}}[{WS_CHARS}-]?\d{{6,8}}(?:{WS}*[/,]{WS}*\d{{2,4}})*(?!\d){BR}"
)
INTERNATIONAL_PHONE = (
    rf"{OPEN_LISTED}\+(?:[1-9]\d{{0,2}})[{WS_CHARS}.-]?\(?\d{{1,5}}\)?[{WS_CHARS}.-]?\d{{1,5}}[{WS_CHARS}.-]?\d{{3,5}}"
    rf"(?:{WS}*[/,]{WS}*\d{{2,5}})*(?!\d)"
)
PAN_ID = rf"{BL}[A-Z]{{5}}[0-9]{{4}}[A-Z]{BR}"
TWELVE_DIGIT_ID = rf"{BL}[2-9]\d{{3}}[{WS_CHARS}-]?\d{{4}}[{WS_CHARS}-]?\d{{4}}{BR}"
CARD = rf"{BL}(?:\d{{4}}[{WS_CHARS}-]?){{3,4}}\d{{1,4}}{BR}"
CVV = rf"(?i){BL}(?:cvv|cvc|cvn|security code)[{WS_CHARS}:]*([0-9]{{3,4}}){BR}"
JWT = rf"{BL}eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{EDGE}"
VENDOR_KEY = rf"{BL}(?:sk_live_|ghp_|akIA)[A-Za-z0-9_]{{16,}}{BR}"
# ---------------------------------------------------------------------------

# Digits as the digit rules need them at least, so that short numbers reach none of the patterns.
GUARD_PIN = rf"[1-9][0-9]{{2}}{WS}?[0-9]{{3}}"
GUARD_TWELVE = rf"\d{{4}}[{WS_CHARS}-]?\d{{4}}[{WS_CHARS}-]?\d{{4}}"
GUARD_LANDLINE = rf"\d{{2}}[{WS_CHARS}-]?\d{{6}}"
GUARD_TEN = rf"\d{{3}}\)?[{WS_CHARS}.-]?\d{{3}}[{WS_CHARS}.-]?\d{{4}}"
GUARD_MOBILE = rf"[6-9]\d{{4}}[{WS_CHARS}-]?\d{{5}}"


@dataclass(frozen=True)
class Rule:
    seq: int
    name: str
    category: str
    confidence: float
    pattern: str
    guard: str
    group: int = 0
    skip_covered: bool = False
    check: str | None = None
    handle: bool = False


RULES: tuple[Rule, ...] = (
    Rule(1, "canary", "token", 1.0, canary_pattern(), "CANARY"),
    Rule(2, "medical_note", "uninspectable", 0.95, MEDICAL, "(?i)note|diagnosis|info|record"),
    Rule(3, "handle", "username", 0.95, HANDLE, "@", group=1, handle=True),
    Rule(4, "delivery", "address", 0.95, DELIVERY, "(?i)deliver|ship"),
    Rule(5, "home_work", "address", 0.95, HOME_WORK, rf"(?i)(?:home|work|office|other){WS}+(?:at|-)"),
    Rule(6, "locality", "address", 0.92, LOCALITY,
         r"(?i)flat|house|h\.no|plot|shop|room|bldg|building|apartment|apt|sector|block|pocket|main|cross"
         r"|nagar|colony|enclave|vihar|kunj|mohalla|gali|katra|chowk|bazar|bazaar|puram|pally|palli|guda|pura"),
    Rule(7, "pin_code", "address", 0.96, PIN_CODE, GUARD_PIN, group=1),
    Rule(8, "greeting", "username", 0.95, GREETING, "(?i)(?:hello|hi|welcome),", group=1),
    Rule(9, "email", "email", 0.98, EMAIL, "@"),
    Rule(10, "obfuscated_email", "email", 0.97, OBFUSCATED_EMAIL, r"(?i)@|\[at\]|\(at\)", skip_covered=True),
    Rule(11, "labelled_email", "email", 0.98, LABELLED_EMAIL, "(?i)mail", group=1, skip_covered=True),
    Rule(12, "pan_id", "national_id", 0.99, PAN_ID, r"[A-Z]{5}\d{4}"),
    Rule(13, "twelve_digit_id", "national_id", 0.99, TWELVE_DIGIT_ID, GUARD_TWELVE, check="verhoeff"),
    Rule(14, "card", "credit_card", 1.0, CARD, GUARD_TWELVE, check="luhn"),
    Rule(15, "labelled_phone", "phone", 0.98, LABELLED_PHONE, "(?i)phone|tel|mob|contact|call|fax",
         group=1, skip_covered=True),
    Rule(16, "indian_mobile", "phone", 0.95, INDIAN_MOBILE, GUARD_MOBILE, skip_covered=True),
    Rule(17, "indian_landline", "phone", 0.94, INDIAN_LANDLINE, GUARD_LANDLINE, skip_covered=True, check="eight_digits"),
    Rule(18, "international_phone", "phone", 0.90, INTERNATIONAL_PHONE, r"\+[1-9]", skip_covered=True,
         check="eight_chars"),
    Rule(19, "ten_digit_phone", "phone", 0.92, TEN_DIGIT_PHONE, GUARD_TEN, skip_covered=True),
    Rule(20, "street", "address", 0.94, STREET,
         rf"(?i){WS}(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|circle|cir){BR}",
         skip_covered=True),
    Rule(21, "birth_date", "date_of_birth", 0.95, BIRTH_DATE, r"(?i)dob|birth|bday", skip_covered=True,
         check="birth_label"),
    Rule(22, "cvv", "cvv", 0.95, CVV, "(?i)cvv|cvc|cvn|security", group=1),
    Rule(23, "jwt", "token", 1.0, JWT, "eyJ"),
    Rule(24, "vendor_key", "token", 1.0, VENDOR_KEY, "sk_live_|ghp_|akIA"),
)
RULES_BY_NAME = {r.name: r for r in RULES}

# A text without any of these cannot match any rule. Worth asking for short pieces such as URL parts.
MAYBE_SENSITIVE = (
    rf"\d{{3}}|[@#+(\[{WS_CHARS}]|[\d()./-]{{7}}|CANARY|eyJ|sk_live_|ghp_|akIA|(?i:flat|house|h\.no|plot|shop|room|bldg"
    r"|building|apartment|apt|sector|block|pocket|dob|birth|bday)"
)


def with_canary_prefixes(prefixes, rules=RULES) -> tuple[Rule, ...]:
    """The same rules looking for other planted prefixes."""
    from dataclasses import replace

    guard = "|".join(prefixes)
    return tuple(replace(r, pattern=canary_pattern(prefixes), guard=guard) if r.name == "canary" else r for r in rules)


# The category vocabulary in precedence order (most specific first),
# then the categories without a rank of their own.
CATEGORY_PRECEDENCE = (
    "password", "auth_code", "cvv", "credit_card", "national_id", "bank_account", "email", "phone",
    "date_of_birth", "token", "face", "high_risk_surface", "uninspectable",
)
UNRANKED_CATEGORIES = ("address", "username", "name")
