"""URLs, free text, nested payloads."""

from pyspark.sql import functions as F

from veil.functions import urls
from veil.functions.spans import SPAN_TYPE
from veil.operators import scrub

EXACT = [
    ("https://portal.example.com/users/ana@example.com/profile", "https://portal.example.com/users/[REDACTED_EMAIL]/profile"),
    ("https://portal.example.com/accounts/bob%40company.org/settings", "https://portal.example.com/accounts/[REDACTED_EMAIL]/settings"),
    ("https://root:hunter2@internal.example.net/tools", "https://internal.example.net/tools"),
    ("https://spa.example.com/#/profile/ana@example.com", "https://spa.example.com/#/profile/[REDACTED_EMAIL]"),
    ("https://en.wikipedia.org/wiki/James_Webb_Space_Telescope", "https://en.wikipedia.org/wiki/James_Webb_Space_Telescope"),
    ("https://example.com/missions/moon-3/overview?view=table&category=lunar", "https://example.com/missions/moon-3/overview?view=table&category=lunar"),
    ("HTTPS://Example.COM:443", "https://example.com/"),
    ("http://example.com:8080/x", "http://example.com:8080/x"),
    ("https://a.example.com/verify/abcdef123456", "https://a.example.com/verify/[REDACTED_TOKEN]"),
    ("https://a.example.com/cb#access_token=abc&user=a@b.co", "https://a.example.com/cb#access_token=[REDACTED_TOKEN]&user=[REDACTED_EMAIL]"),
    ("https://a.example.com/?next=https%3A%2F%2Fb.example.com%2Freset%2Fabcdefgh12", "https://a.example.com/?next=https://b.example.com/reset/[REDACTED_TOKEN]"),
    ("about:blank", "about:blank"), ("", ""), (None, ""),
    ("/relative?token=abcdefghij", "/relative?token=[REDACTED_TOKEN]"),
    ("https://a.example.com/x%zz/y", "https://a.example.com/x%zz/y"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(EXACT)], "i int, u string")
    got = {r.i: r.url_clean for r in scrub.sanitize_urls(df, "u").collect()}
    for i, (raw, want) in enumerate(EXACT):
        assert got[i] == want, raw


def test_long_urls_lose_the_fragment_then_the_query(spark):
    df = spark.createDataFrame([("https://e.example.com/p?" + "&".join(f"k{i}=v" for i in range(600)) + "#f",)], "u string")
    out = scrub.sanitize_urls(df, "u").first().url_clean
    assert len(out) == 2048 and "#" not in out


def test_free_text(spark):
    text = 'see https://p.example.com/user/a@b.co/edit?token=sec_12345678 and Bearer abcdefgh12345, token = "deadbeefcafe" plus ' + "ab" * 16
    df = spark.createDataFrame([(text,), (None,)], "t string")
    out = [r.text_clean for r in scrub.scrub_free_text(df, "t").collect()]
    assert out[0] == ('see https://p.example.com/user/[REDACTED_EMAIL]/edit?token=[REDACTED_TOKEN] and Bearer [REDACTED_TOKEN], '
                      'token = "[REDACTED_TOKEN]" plus [REDACTED_TOKEN]')
    assert out[1] is None


def test_nested_payload(spark):
    df = spark.sql("""SELECT 'mail a@b.co' AS goal, named_struct('url', 'https://e.example.com/u/a@b.co', 'title', CAST(NULL AS STRING),
        'stateDelta', named_struct('currentUrl', 'https://e.example.com/reset/abcdefgh1')) AS pageState,
        array(named_struct('sanitizedName', 'call 415-555-0134', 'role', 'link')) AS elements, 7 AS kept""")
    r = scrub.scrub_nested(df, scrub.PAYLOAD_PATHS).first()
    assert r.goal == "mail [REDACTED_EMAIL]" and r.kept == 7
    assert r.pageState.url == "https://e.example.com/u/[REDACTED_EMAIL]" and r.pageState.title is None
    assert r.pageState.stateDelta.currentUrl == "https://e.example.com/reset/[REDACTED_TOKEN]"
    assert r.elements[0].sanitizedName == "call [REDACTED_PHONE]" and r.elements[0].role == "link"


def test_gate_and_zones(spark):
    df = spark.createDataFrame([("chrome://x",), ("https://app.slack.com/a",), ("https://x.com/home",), (None,)], "u string")
    passed, blocked = scrub.gate_urls(df, "u")
    assert blocked.count() == 1 and passed.count() == 3
    zones = {r.u: r.zone for r in scrub.page_zone(df, "u").collect()}
    assert zones["https://app.slack.com/a"] == "private_workspace" and zones["https://x.com/home"] == "hybrid"
    assert zones[None] == "public_broadcast"


def test_scrub_is_idempotent(spark):
    df = spark.createDataFrame([("mail a@b.co or 415-555-0134, card 4532015012345671",)], "t string")
    once = scrub.scrub_free_text(df, "t", "a")
    twice = scrub.scrub_free_text(once, "a", "b")
    assert twice.filter(F.col("a") != F.col("b")).count() == 0


def test_urls_nested_one_to_six_levels_deep(spark):
    from urllib.parse import quote

    deep, want, rows = "https://c0.example.com/reset/abcdefgh12?session=1&q=ok", "https://c0.example.com/reset/[REDACTED_TOKEN]?session=[REDACTED_TOKEN]&q=ok", []
    for level in range(1, 7):
        deep = f"https://c{level}.example.com/docs/page?next={quote(deep, safe='')}&view=a&mail=x%40y.org#top"
        want = f"https://c{level}.example.com/docs/page?next={want}&view=a&mail=[REDACTED_EMAIL]#top"
        rows.append((level, deep, want))
    both = "https://a.example.com/?x=" + quote("https://b.example.com/?y=" + quote("http://bad host/?k=1", safe=""), safe="") + "&z=" + quote("http://c.example.com/?w=1", safe="")
    rows.append((7, both, "https://a.example.com/?x=https://b.example.com/?y=http://bad host/?k=1&z=http://c.example.com/?w=1"))
    out = {r["i"]: (r["url_clean"], r["want"]) for r in scrub.sanitize_urls(spark.createDataFrame(rows, "i int, u string, want string"), "u").collect()}
    for got, expected in out.values():
        assert got == expected


def test_parts_that_are_secret_anyway_are_not_scanned(spark, monkeypatch):
    monkeypatch.setattr(urls, "all_spans", lambda text: f"cast(raise_error('scanned') as {SPAN_TYPE})")
    df = spark.createDataFrame([("https://a.example/reset/tok123456789?session=s12345&email=u12345%40a.example#access_token=a12345",)], "u string")
    assert scrub.sanitize_urls(df, "u").first().url_clean == (
        "https://a.example/reset/[REDACTED_TOKEN]?session=[REDACTED_TOKEN]&email=[REDACTED_EMAIL]#access_token=[REDACTED_TOKEN]")
