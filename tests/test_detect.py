"""Spans, checksums, masking."""

import re

from pyspark.sql import functions as F

from veil.functions import rules
from veil.functions.rules import RULES_BY_NAME, with_canary_prefixes
from veil.operators import detect
from tests.conftest import SF

CASES = [
    ("Reach Asha at asha.rao@labs.example.org or call +91 98765 43210.", {"email", "phone"}),
    ("Identity: PAN ABCDE1234F, number 4532 8901 2342.", {"national_id"}),
    ("Card: 4532 0150 1234 5671 with CVV: 892.", {"credit_card", "cvv"}),
    ("Deliver to Meera, 211002 - HOME at katra - Allahabad", {"address"}),
    ("DOB: 14 July 2003", {"date_of_birth"}),
    ("Birth Date: 14-07-2003", {"date_of_birth"}),
    ("Phone: +91 80 22172294 / 96", {"phone"}),
    ("Email: helpdesk[at]agency[dot]gov[dot]in", {"email"}),
    ("Flat 402, Building 3, Sector 62, Noida", {"address"}),
    ("123 Main St, Springfield", {"address"}),
    ("Hello, Kiran and welcome", {"username"}),
    ("ping @some_handle please", {"username"}),
    ("medical note: patient is fine. ok", {"uninspectable"}),
    ("key sk_live_abcdefghijklmnop1234 here", {"token"}),
    ("SECRET_CANARY_X9 leaked", {"token"}),
]
CLEAN = [
    "Launched on 14 July 2023", "Skip to main content", "Main navigation and portal sitemap",
    "Room for innovation in satellite telemetry",
    "The module orbits at 100 km and separates; its size is ~170 x 36500 km.", "", None,
]


def scan(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r.id: r for r in detect.scan_pii(df, "text", **kw).collect()}


def test_categories_and_offsets(spark):
    got = scan(spark, [t for t, _ in CASES])
    for i, (text, want) in enumerate(CASES):
        found = {s.category for s in got[i].spans}
        assert want <= found, (text, found)
        assert all(0 <= s.start < s.end <= len(text) for s in got[i].spans)
        keys = [(s.start, s.rule_seq) for s in got[i].spans]
        assert keys == sorted(keys)


def test_public_text_has_no_spans(spark):
    got = scan(spark, CLEAN)
    assert [i for i in got if got[i].spans] == []


def test_boundaries_are_ascii(spark):
    # An accented letter is no word character, so the number after it still stands alone.
    assert scan(spark, ["café4532 0150 1234 5671"])[0].spans[0].category == "credit_card"


def test_public_handles_and_own_canaries(spark):
    assert not scan(spark, ["by @someone today"], public_handles=True)[0].spans
    assert scan(spark, ["PLANTED_1 x"], rules=with_canary_prefixes(("PLANTED",)))[0].spans[0].category == "token"


def test_scrub_extends_overlaps(spark):
    df = spark.createDataFrame([("Ship to 456 Park Avenue, Apt 4B",), ("write a@b.co, c@d.co!",)], "text string")
    rows = detect.scrub_text(df, "text").collect()
    assert rows[0].clean == "[REDACTED_ADDRESS]"
    assert rows[1].clean == "write [REDACTED_EMAIL], [REDACTED_EMAIL]!" and rows[1].n_spans == 2


def test_scrubbed_text_has_no_email_or_card_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = [RULES_BY_NAME["email"], RULES_BY_NAME["card"]]
    again = detect.scan_pii(detect.scrub_text(docs, "text", rules), "clean", rules)
    assert again.filter(F.size("spans") > 0).count() == 0


def test_spans_match_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    patterns = {
        "email": r"(?<![A-Za-z0-9_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])",
        "ten_digit_phone": r"(?<!\d)(?:\+?1[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}(?!\d)(?![A-Za-z0-9_])",
    }
    for name, pattern in patterns.items():
        got = {r.doc_id: [(s.start, s.end) for s in r.spans]
               for r in detect.scan_pii(docs, "text", [RULES_BY_NAME[name]]).collect()}
        for r in docs.collect():
            assert got[r.doc_id] == [m.span() for m in re.finditer(pattern, r.text, re.A)], (name, r.doc_id)


def test_checksums(spark):
    df = spark.createDataFrame([
        ("4532015012345671",), ("4532015012345679",), ("4532 0150 1234 5671",), ("1234",), ("4532 8901 2342",),
        ("4532 8901 2345",), ("222222222222",), (None,)], "v string")
    out = {r.v: (r.luhn_valid, r.id_valid) for r in detect.id_valid(detect.luhn_valid(df, "v"), "v").collect()}
    assert out["4532015012345671"] == (True, False)
    assert out["4532015012345679"][0] is False
    assert out["4532 0150 1234 5671"][0] is True
    assert out["4532 8901 2342"][1] is True and out["4532 8901 2345"][1] is False
    assert out["222222222222"][1] is False and out[None] == (False, False)
    digits = spark.createDataFrame([("45328901234",), ("x",)], "v string")
    made = {r.v: r.check_digit for r in detect.id_check_digit(digits, "v").collect()}
    assert made["45328901234"] == 2 and made["x"] is None


def test_names_are_trimmed_and_cut(spark):
    df = spark.createDataFrame([("  " + "x" * 90 + " ",), (None,)], "n string")
    got = [r.clean for r in detect.sanitize_name(df, "n").collect()]
    assert got[0] == "x" * 77 + "..." and got[1] == ""


def test_residual_scan_rejects_canaries(spark):
    df = spark.createDataFrame([(1, 1, "a@b.co left"), (1, 2, "SECRET_CANARY_9")], "page_id int, local_id int, sanitized_name string")
    clean, leaks = detect.residual_scan(df)
    assert [r.sanitized_name for r in clean.collect()] == ["[REDACTED_EMAIL] left"]
    assert [r.local_id for r in leaks.collect()] == [2]


def test_addresses_after_sector_words(spark):
    """The word edge belongs to the single letter only."""
    texts = ["Sector #123456789", "Sector 12-", "Block C", "Block Cx", "Pocket No. 4/7,"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r["id"]: r["m"] for r in df.select("id", F.regexp_extract_all("text", F.lit(rules.LOCALITY), F.lit(0)).alias("m")).collect()}
    assert found == {0: ["Sector #12345678"], 1: ["Sector 12-"], 2: ["Block C"], 3: [], 4: ["Pocket No. 4/7"]}
    assert detect.explode_spans(detect.scan_pii(df, "text")).where("id = 0").count() > 0


def test_short_numbers_pass_no_digit_guard():
    digit_rules = ("pin_code", "twelve_digit_id", "card", "indian_mobile", "indian_landline", "ten_digit_phone")
    guards = [RULES_BY_NAME[n].guard for n in digit_rules]
    assert not [g for g in guards if re.search(g, "order 4321 of 1999, 12345 items")]
    for name, text in zip(digit_rules, ("pin 110 001", "2345 6789 0123", "4111-1111-1111-1111", "98765 43210", "020-234567", "(555) 234-5678")):
        assert re.search(RULES_BY_NAME[name].guard, text), name
