"""Queries over documents, conversations and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.rules import RULES, RULES_BY_NAME
from veil.operators import catalogs, chat, detect, payloads, scrub
from veil.plans.derived import PRIVATE_URLS, derive, table
from veil.plans.registry import query

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CARD = r"\b(?:\d{4}[\s-]?){3,4}\d{1,4}\b"
# Luhn over the digits of `d`, right to left.
LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN cast(d[length(d) - i + 1] AS INT)
       WHEN cast(d[length(d) - i + 1] AS INT) > 4 THEN cast(d[length(d) - i + 1] AS INT) * 2 - 9
       ELSE cast(d[length(d) - i + 1] AS INT) * 2 END)) % 10 = 0"""


@query("pii_email_counts", f"""
WITH m AS (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS s FROM documents)
SELECT lang, count(DISTINCT doc_id) AS docs, count(*) AS spans, sum(length(s))::BIGINT AS chars FROM m GROUP BY lang""")
def pii_email_counts(spark, sf):
    found = detect.scan_pii(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text", [RULES_BY_NAME["email"]])
    # Counting per document first keeps the exploded spans inside their task.
    per_doc = found.select("lang", F.size("spans").alias("n"), F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"])).alias("chars")).filter("n > 0")
    return per_doc.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("spans"), F.sum("chars").alias("chars"))


@query("pii_card_luhn", f"""
WITH m AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '{CARD}')) AS s FROM documents),
c AS (SELECT source, doc_id, regexp_replace(s, '[\\s-]', '', 'g') AS d FROM m),
v AS (SELECT source, doc_id, length(d) BETWEEN 13 AND 19 AND {LUHN} AS ok FROM c)
SELECT source, count(*) AS candidates, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS cards FROM v GROUP BY source""")
def pii_card_luhn(spark, sf):
    from dataclasses import replace

    loose = replace(RULES_BY_NAME["card"], check=None)
    docs = table(spark, sf, "documents", heavy=True).select("source", "doc_id", "text")
    found = detect.scan_pii(detect.scan_pii(docs, "text", [loose], out="c"), "text", [RULES_BY_NAME["card"]], out="v")
    return found.select("source", F.size("c").alias("c"), F.size("v").alias("v")).filter("c > 0").groupBy("source").agg(
        F.sum("c").alias("candidates"), F.sum("v").alias("cards"))


@query("pii_phone_counts", r"""
WITH m AS (SELECT lang, unnest(regexp_extract_all(text, '(?:^|[\s(\[{:;,])(\+(?:[1-9]\d{0,2})[\s.-]?\(?\d{1,5}\)?[\s.-]?\d{1,5}[\s.-]?\d{3,5})(?:[^0-9]|$)', 1)) AS s FROM documents)
SELECT lang, count(*) AS spans FROM m WHERE length(s) >= 8 GROUP BY lang""")
def pii_phone_counts(spark, sf):
    found = detect.scan_pii(table(spark, sf, "documents", heavy=True).select("lang", "text"), "text", [RULES_BY_NAME["international_phone"]])
    return found.select("lang", F.size("spans").alias("n")).filter("n > 0").groupBy("lang").agg(F.sum("n").alias("spans"))


@query("pii_span_offsets")
def pii_span_offsets(spark, sf):
    """All rules over whole documents: one row per span. Look-arounds keep it out of ANSI SQL."""
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    return detect.explode_spans(detect.scan_pii(docs, "text")).drop("text")


@query("pii_spans_ordered", f"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS s FROM documents)
SELECT doc_id, count(*) AS n_spans FROM m GROUP BY doc_id""")
def pii_spans_ordered(spark, sf):
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    spans = detect.explode_spans(detect.scan_pii(docs, "text", [RULES_BY_NAME["email"]])).drop("text", "seq")
    return detect.order_spans(spans, ["doc_id"]).select("doc_id", F.size("spans").cast("bigint").alias("n_spans"))


@query("pii_prefilter_loss", f"""
SELECT count(*) AS docs, sum(CASE WHEN regexp_matches(text, '[0-9@+]') THEN 1 ELSE 0 END)::BIGINT AS scanned,
  sum(CASE WHEN regexp_matches(text, '{EMAIL}') THEN 1 ELSE 0 END)::BIGINT AS hit,
  sum(CASE WHEN regexp_matches(text, '{EMAIL}') AND NOT regexp_matches(text, '[0-9@+]') THEN 1 ELSE 0 END)::BIGINT AS lost FROM documents""")
def pii_prefilter_loss(spark, sf):
    """How many texts the cheap pre-filter lets through to the scanner, and how many with a span it loses."""
    docs, rules = table(spark, sf, "documents", heavy=True).select("text"), [RULES_BY_NAME["email"]]
    both = detect.scan_pii(detect.scan_pii(docs, "text", rules).withColumnRenamed("spans", "plain"), "text", rules, prefilter=True)
    return both.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("text").rlike("[0-9@+]")).alias("scanned"),
                    F.count_if(F.size("spans") > 0).alias("hit"), F.count_if(F.size("plain") > F.size("spans")).alias("lost"))


@query("luhn_flags", f"""
WITH c AS (SELECT o_orderkey, concat('4532', lpad(cast(o_orderkey * 7919 % 1000000000000 AS VARCHAR), 12, '0')) AS d FROM orders)
SELECT o_orderkey, d AS card, {LUHN} AS luhn_valid FROM c""")
def luhn_flags(spark, sf):
    cards = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat('4532', lpad(cast(o_orderkey * 7919 % 1000000000000 as string), 12, '0')) AS card")
    return detect.luhn_valid(cards, "card")


def _verhoeff_sql(digits: str, offset: int) -> str:
    from veil.functions.checks import _PERMUTED, _PRODUCT

    p, d = _PERMUTED.replace("array(", "[").replace(")", "]"), _PRODUCT.replace("array(", "[").replace(")", "]")
    return (f"list_reduce(list_transform(range(0, length({digits})), lambda i: ({p})[((i + {offset}) % 8) * 10 + "
            f"cast({digits}[length({digits}) - i] AS INT) + 1]), lambda a, x: ({d})[a * 10 + x + 1], 0)")


@query("id_checksums", f"""
WITH c AS (SELECT o_orderkey, concat(cast(2 + o_orderkey % 8 AS VARCHAR), lpad(cast(o_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '0')) AS base FROM orders),
w AS (SELECT o_orderkey, base, [0, 4, 3, 2, 1, 5, 6, 7, 8, 9][{_verhoeff_sql('base', 1)} + 1] AS check_digit FROM c),
z AS (SELECT o_orderkey, check_digit, concat(base, cast((check_digit + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR)) AS id FROM w)
SELECT o_orderkey, check_digit, id, {_verhoeff_sql('id', 0)} = 0 AS id_valid FROM z""")
def id_checksums(spark, sf):
    """D4 makes the digit, every third one is spoiled, D3 checks it."""
    base = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "concat(cast(2 + o_orderkey % 8 as string), lpad(cast(o_orderkey * 104729 % 10000000000 as string), 10, '0')) AS base")
    made = detect.id_check_digit(base, "base").withColumn("id", F.concat("base", F.expr(
        "cast((check_digit + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 10 as string)")))
    return detect.id_valid(made, "id").drop("base")


@query("scrub_email_docs", f"""
SELECT doc_id, md5(regexp_replace(text, '{EMAIL}', '[REDACTED_EMAIL]', 'g')) AS clean_md5,
       len(regexp_extract_all(text, '{EMAIL}')) AS n_spans FROM documents""")
def scrub_email_docs(spark, sf):
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    return detect.scrub_text(docs, "text", [RULES_BY_NAME["email"]]).select("doc_id", F.md5("clean").alias("clean_md5"), "n_spans")


@query("scrub_text_docs")
def scrub_text_docs(spark, sf):
    """D5 with all rules."""
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "lang", "text")
    out = detect.scrub_text(docs, "text")
    return out.groupBy("lang").agg(F.count_if(F.col("n_spans") > 0).alias("docs_hit"), F.sum("n_spans").alias("spans"),
                                   F.sum(F.length("text") - F.length("clean")).alias("chars_removed"))


@query("sanitize_names", """
SELECT c_custkey, CASE WHEN length(t) > 80 THEN concat(substr(t, 1, 77), '...') ELSE t END AS clean FROM (
  SELECT c_custkey, concat(c_name, ' writes to [REDACTED_EMAIL]', CASE WHEN c_custkey % 2 = 0 THEN ' about the ' || lower(c_mktsegment) || ' order that was late' ELSE '' END) AS t FROM customer)""")
def sanitize_names(spark, sf):
    names = table(spark, sf, "customer", heavy=True).selectExpr("c_custkey", """concat('  ', c_name, ' writes to user', cast(c_custkey as string), '@mail.example.com',
        CASE WHEN c_custkey % 2 = 0 THEN concat(' about the ', lower(c_mktsegment), ' order that was late') ELSE '' END, ' ') AS name""")
    return detect.sanitize_name(names, "name").select("c_custkey", "clean")


@query("canary_leaks", """
WITH n AS (SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 10 = 0 THEN ' SECRET_CANARY_A1' ELSE '' END) AS name,
                  concat(c_mktsegment, CASE WHEN c_custkey % 15 = 0 THEN ' CANARY_PAYMENT_SECRET' ELSE '' END) AS note FROM customer),
u AS (SELECT c_custkey AS row_id, 'name' AS "column", name AS v FROM n UNION ALL SELECT c_custkey, 'note', note FROM n)
SELECT row_id, "column", k.canary FROM u, (VALUES ('SECRET_CANARY_A1'), ('CANARY_PAYMENT_SECRET')) AS k(canary) WHERE contains(v, k.canary)""")
def canary_leaks(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey", "concat(c_name, CASE WHEN c_custkey % 10 = 0 THEN ' SECRET_CANARY_A1' ELSE '' END) AS name",
        "concat(c_mktsegment, CASE WHEN c_custkey % 15 = 0 THEN ' CANARY_PAYMENT_SECRET' ELSE '' END) AS note")
    return detect.canary_leaks(rows, "c_custkey", ["name", "note"], ["SECRET_CANARY_A1", "CANARY_PAYMENT_SECRET"])


@query("residual_scan", """
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 3 = 0 THEN '[REDACTED_EMAIL] ok' ELSE c_name END AS sanitized_name,
       CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS residual, false AS rejected FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, NULL, NULL, true FROM customer WHERE c_custkey % 10 = 0""")
def residual_scan(spark, sf):
    els = table(spark, sf, "customer").selectExpr("c_custkey AS page_id", "0 AS local_id", """CASE WHEN c_custkey % 10 = 0 THEN concat(c_name, ' SECRET_CANARY_Z')
        WHEN c_custkey % 3 = 0 THEN concat('u', cast(c_custkey as string), '@mail.example.com ok') ELSE c_name END AS sanitized_name""")
    clean, rejects = detect.residual_scan(els)
    return clean.select("page_id", "sanitized_name", "residual", F.lit(False).alias("rejected")).unionByName(
        rejects.select("page_id", F.lit(True).alias("rejected")), allowMissingColumns=True)


@query("context_spans", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'username' WHEN 2 THEN 'uninspectable' ELSE 'username' END AS category,
       length(CASE c_custkey % 4 WHEN 0 THEN concat('Colony ', c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN concat('seen yesterday by ', c_mktsegment) ELSE concat('Hi ', c_mktsegment) END) AS "end" FROM customer""")
def context_spans(spark, sf):
    nodes = table(spark, sf, "customer").selectExpr(
        "c_custkey", """CASE c_custkey % 4 WHEN 0 THEN concat('Colony ', c_mktsegment) WHEN 1 THEN c_mktsegment
           WHEN 2 THEN concat('seen yesterday by ', c_mktsegment) ELSE concat('Hi ', c_mktsegment) END AS text""",
        "c_custkey % 4 = 0 AS is_delivery", "c_custkey % 4 IN (1, 2) AS is_message", "c_custkey % 4 = 3 AS is_account")
    return detect.context_spans(nodes).select("c_custkey", F.col("spans")[0]["category"].alias("category"), F.col("spans")[0]["end"].alias("end"))


@query("container_spans", """
SELECT c_custkey AS page_id, 'email' AS category, 5 AS start, 5 + length(concat('user', cast(c_custkey AS VARCHAR), '@mail.example.com')) AS "end" FROM customer""")
def container_spans(spark, sf):
    nodes = table(spark, sf, "customer", heavy=True).selectExpr("c_custkey AS page_id", """posexplode(array('Mail ', concat('user', cast(c_custkey as string)), '@mail.', 'example.com', ' !'))
        AS (pos, text)""").withColumn("parent_id", F.lit(1))
    found = detect.container_spans(nodes)
    return found.filter("rule_seq = 9").select("page_id", "category", "start", "end")


@query("url_sanitize", r"""
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+$') THEN url || '/' ELSE url END AS url_clean FROM pages""")
def url_sanitize(spark, sf):
    return scrub.sanitize_urls(table(spark, sf, "pages", heavy=True).select("page_id", "url"), "url").select("page_id", "url_clean")


@query("url_sanitize_private", """
SELECT o_orderkey, concat('https://shop.example.com/account/[REDACTED_EMAIL]/reset/[REDACTED_TOKEN]?page=', cast(o_orderkey % 9 AS VARCHAR),
  '&email=[REDACTED_EMAIL]&session=[REDACTED_TOKEN]&flag', CASE WHEN o_orderkey % 2 = 0 THEN '#top' ELSE '#access_token=[REDACTED_TOKEN]' END) AS url_clean FROM orders""")
def url_sanitize_private(spark, sf):
    return scrub.sanitize_urls(derive(spark, sf, PRIVATE_URLS, heavy=True), "raw_url").select("o_orderkey", "url_clean")


@query("urls_in_text", """
SELECT o_orderkey, concat('see https://shop.example.com/account/[REDACTED_EMAIL]/reset/[REDACTED_TOKEN]?page=', cast(o_orderkey % 9 AS VARCHAR),
  '&email=[REDACTED_EMAIL]&session=[REDACTED_TOKEN]&flag', CASE WHEN o_orderkey % 2 = 0 THEN '#top' ELSE '#access_token=[REDACTED_TOKEN]' END, ' now') AS text_clean FROM orders""")
def urls_in_text(spark, sf):
    texts = derive(spark, sf, PRIVATE_URLS, heavy=True).select("o_orderkey", F.concat(F.lit("see "), "raw_url", F.lit(" now")).alias("text"))
    return scrub.sanitize_embedded_urls(texts, "text").select("o_orderkey", "text_clean")


@query("free_text_docs")
def free_text_docs(spark, sf):
    """U3 over whole documents."""
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    return scrub.scrub_free_text(docs, "text").select("doc_id", F.md5("text_clean").alias("clean_md5"))


@query("free_text_secrets", """
SELECT o_orderkey, concat('order ', cast(o_orderkey AS VARCHAR), ' Bearer [REDACTED_TOKEN] and token="[REDACTED_TOKEN]" [REDACTED_TOKEN] end') AS text_clean FROM orders""")
def free_text_secrets(spark, sf):
    texts = table(spark, sf, "orders", heavy=True).selectExpr("o_orderkey", """concat('order ', cast(o_orderkey as string), ' bearer abcdef', cast(o_orderkey as string), 'xyz and token="',
        substr(md5(cast(o_orderkey as string)), 1, 9), 'abcdefg" ', translate(md5(concat('k', cast(o_orderkey as string))), '0123456789', 'abcdefabcd'), ' end') AS text""")
    return scrub.scrub_free_text(texts, "text").select("o_orderkey", "text_clean")


@query("scrub_conversations")
def scrub_conversations(spark, sf):
    """U4."""
    turns = scrub.scrub_conversations(table(spark, sf, "conversations", heavy=True))
    return turns.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("scrub_nested", """
SELECT o_orderkey, concat('pay [REDACTED_EMAIL]') AS goal, 'https://shop.example.com/reset/[REDACTED_TOKEN]' AS url, concat('by [REDACTED_EMAIL]') AS first_summary FROM orders""")
def scrub_nested(spark, sf):
    df = table(spark, sf, "orders", heavy=True).selectExpr(
        "o_orderkey", "concat('pay u', cast(o_custkey as string), '@mail.example.org') AS goal",
        """named_struct('url', concat('https://shop.example.com/reset/tok', lpad(cast(o_orderkey as string), 12, '0')),
           'statusSummaries', array(concat('by u', cast(o_custkey as string), '@mail.example.org'), 'ok')) AS pageState""")
    out = scrub.scrub_nested(df, scrub.PAYLOAD_PATHS)
    return out.select("o_orderkey", "goal", F.col("pageState.url").alias("url"), F.col("pageState.statusSummaries")[0].alias("first_summary"))


@query("header_redaction", """
SELECT event_id, '[REDACTED_HEADER]' AS auth, '[REDACTED_HEADER]' AS cookie, concat(event_type, ', ', 'b') AS accept, '' AS empty FROM events""")
def header_redaction(spark, sf):
    logs = table(spark, sf, "events").selectExpr("event_id", """map('Authorization', array(props), 'cookie', array('a', 'b'), 'accept', array(event_type, 'b'),
        'empty', cast(array() as array<string>)) AS headers""")
    out = scrub.redact_headers(logs, "headers")
    h = F.col("headers")
    return out.select("event_id", h["Authorization"].alias("auth"), h["cookie"].alias("cookie"), h["accept"].alias("accept"), h["empty"].alias("empty"))


@query("error_classes", """
SELECT event_type, failure_class, detail, count(*) AS n FROM (
 SELECT event_type, CASE event_id % 5 WHEN 0 THEN 'SANITIZER_TIMEOUT' WHEN 1 THEN 'CANVAS_UNAVAILABLE' WHEN 2 THEN 'MASK_RENDER_FAILED' WHEN 3 THEN 'DIGEST_FAILED' ELSE 'UNKNOWN_SANITIZER_FAILURE' END AS failure_class,
  CASE event_id % 5 WHEN 0 THEN 'Request timed out at [URL]' WHEN 1 THEN 'Canvas context lost' WHEN 2 THEN 'could not render mask [HASH]' WHEN 3 THEN 'sha256 mismatch' ELSE concat('odd ', event_type) END AS detail
 FROM events) GROUP BY ALL""")
def error_classes(spark, sf):
    logs = table(spark, sf, "events").selectExpr("event_type", """CASE event_id % 5 WHEN 0 THEN concat('Request timed out at https://x.example.com/', cast(event_id as string))
        WHEN 1 THEN 'Canvas context lost' WHEN 2 THEN concat('could not render mask ', md5(cast(event_id as string))) WHEN 3 THEN 'sha256 mismatch' ELSE concat('odd ', event_type) END AS message""")
    return scrub.normalize_errors(logs, "message").groupBy("event_type", "failure_class", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("neutralize_pages", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  'https?://', 'https //', 'gi'), 'blob:', 'blob ', 'gi'), 'data:', 'data ', 'gi'), '<script\b', '[script', 'gi'), 'javascript:', 'javascript ', 'gi'),
  '\bon\w+\s*=', 'evt=', 'gi'), '\beval\s*\(', 'eval ', 'gi')) AS html_md5 FROM pages""")
def neutralize_pages(spark, sf):
    out = scrub.neutralize_text(table(spark, sf, "pages", heavy=True).select("page_id", "html"), "html")
    return out.select("page_id", F.md5("html").alias("html_md5"))


@query("script_flags", r"""
SELECT regexp_matches(html, '(?i)<script\b|javascript:|vbscript:|data:text/html|\beval\s*\(|\bexpression\s*\(|\bon(?:load|error|click|mouse\w+|key\w+|focus|blur|change|submit|reset|select|contextmenu|drag\w*|drop|wheel|scroll|touch\w*|animation\w*|transition\w*)\s*=') AS has_script, count(*) AS pages
FROM pages GROUP BY 1""")
def script_flags(spark, sf):
    return scrub.script_flag(table(spark, sf, "pages").select("html"), "html").groupBy("has_script").agg(F.count(F.lit(1)).alias("pages"))


@query("url_zones", r"""
SELECT CASE WHEN regexp_matches(lower(url), '/(?:direct|inbox|messages?|messaging|conversations?|chat|mail|compose|banking|netbanking|payroll|hrms|myaccount|statements|checkout)(?:[/?#]|$)') THEN 'private_workspace'
            ELSE 'public_broadcast' END AS zone, count(*) AS pages FROM pages GROUP BY 1""")
def url_zones(spark, sf):
    return scrub.page_zone(table(spark, sf, "pages").select("url"), "url").groupBy("zone").agg(F.count(F.lit(1)).alias("pages"))


@query("url_zones_known_hosts", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'private_workspace' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'public_broadcast' ELSE 'private_workspace' END AS zone FROM customer""")
def url_zones_known_hosts(spark, sf):
    urls = table(spark, sf, "customer").selectExpr("c_custkey", """concat('https://', CASE c_custkey % 4 WHEN 0 THEN 'app.slack.com/c' WHEN 1 THEN 'github.com/o'
        WHEN 2 THEN 'en.wikipedia.org/wiki/' ELSE 'social.example.com/inbox/' END, cast(c_custkey as string)) AS url""")
    return scrub.page_zone(urls, "url").select("c_custkey", "zone")


@query("domain_counts", r"""
SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS domain, count(*) AS pages FROM pages GROUP BY 1""")
def domain_counts(spark, sf):
    return scrub.normalize_domain(table(spark, sf, "pages").select("url"), "url").groupBy("domain").agg(F.count(F.lit(1)).alias("pages"))


@query("url_gate", """
SELECT CASE page_id % 5 WHEN 0 THEN 'Chrome internal settings/management surface (chrome://)' WHEN 1 THEN 'Extension internal origin (chrome-extension://)'
  WHEN 2 THEN 'Privileged browser internal origin' WHEN 3 THEN 'Local file scheme URL without explicit verified permission' ELSE 'passed' END AS outcome, count(*) AS n FROM pages GROUP BY 1""")
def url_gate(spark, sf):
    urls = table(spark, sf, "pages").selectExpr("""CASE page_id % 5 WHEN 0 THEN 'chrome://settings' WHEN 1 THEN 'Chrome-Extension://abc/x' WHEN 2 THEN ' about:config'
        WHEN 3 THEN 'file:///etc/hosts' ELSE url END AS url""")
    passed, blocked = scrub.gate_urls(urls, "url")
    return passed.select(F.lit("passed").alias("outcome")).unionByName(blocked.select(F.col("reason").alias("outcome"))).groupBy(
        "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("strip_reasoning", """
SELECT conv_id, turn, trim(text, E' \\n\\t\\r') AS answer, CASE WHEN turn % 2 = 0 THEN concat('plan ', cast(turn AS VARCHAR)) ELSE '' END AS reasoning FROM conversations""")
def strip_reasoning(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(
        F.lit("<think> plan "), F.col("turn").cast("string"), F.lit("\n</think>"), "text")).otherwise(F.col("text")))
    return chat.strip_reasoning(turns).select("conv_id", "turn", "answer", "reasoning")


@query("reasoning_lines")
def reasoning_lines(spark, sf):
    """U11."""
    return chat.reasoning_lines(table(spark, sf, "conversations", heavy=True)).select("conv_id", "turn", "line", "category", F.md5("body").alias("body_md5"))


@query("action_suggestions", """
SELECT conv_id, turn, concat('Save ', role, '|Next') AS suggestions FROM conversations""")
def action_suggestions(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("text", F.concat(
        F.lit('First click on "Save '), "role", F.lit("\" then press 'Next', tap \"Save "), "role", F.lit('" and open "'), F.repeat(F.lit("x"), 50), F.lit('"')))
    return chat.action_suggestions(turns).select("conv_id", "turn", F.array_join("suggestions", "|").alias("suggestions"))


@query("semantic_tokens", r"""
WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(concat(p_name, ' / ', p_brand)), '[^a-z0-9\s_-]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM part)
SELECT p_partkey, norm, len(string_split(norm, ' ')) AS n_tokens FROM n""")
def semantic_tokens(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" / "), "p_brand").alias("name"))
    return chat.tokenize(parts, "name").select("p_partkey", "norm", F.size("tokens").alias("n_tokens"))


@query("clean_tokens", """
SELECT c_custkey, concat('user name ', lower(c_mktsegment), ' field 1') AS text_tokens FROM customer""")
def clean_tokens(spark, sf):
    names = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("userName_"), F.lower("c_mktsegment"), F.lit("-(field)[1]")).alias("n"))
    return chat.clean_tokens(names, "n").select("c_custkey", "text_tokens")


@query("normalized_intents", r"""
SELECT trim(regexp_replace(regexp_replace(concat('open ', lower(o_orderpriority), ' orders'), '[-]', ' ', 'g'), '\s+', ' ', 'g')) AS intent, count(*) AS n FROM orders GROUP BY 1""")
def normalized_intents(spark, sf):
    goals = table(spark, sf, "orders").select(F.concat(F.lit("Please  Open "), "o_orderpriority", F.lit(" (orders)")).alias("goal"))
    return chat.normalize_intent(goals, "goal").groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query("intent_tags", r"""
SELECT role, count(*) AS turns, sum(CASE WHEN regexp_matches(lower(trim(text)), '^(?:open|find|set|list|test|read|do|see|show|move|sign|try|work|get|view|look|check|close|drop|drag|press|fill|type|click|enter|write|select|choose|search|scroll)\b') THEN 1 ELSE 0 END)::BIGINT AS actions
FROM conversations GROUP BY role""")
def intent_tags(spark, sf):
    tagged = chat.tag_intents(table(spark, sf, "conversations"))
    return tagged.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if("is_action").alias("actions"))


@query("intent_tags_requests", """
SELECT o_orderkey % 4 AS k, o_orderkey % 4 IN (0, 1) AS is_action, o_orderkey % 4 = 1 AS is_nav, o_orderkey % 4 = 2 AS is_multi, count(*) AS n FROM orders GROUP BY ALL""")
def intent_tags_requests(spark, sf):
    goals = table(spark, sf, "orders").selectExpr("o_orderkey % 4 AS k", """CASE o_orderkey % 4 WHEN 0 THEN concat('Please can you click order ', cast(o_orderkey as string))
        WHEN 1 THEN concat('go to shop', cast(o_orderkey as string), '.example.com') WHEN 2 THEN 'price on amazon versus flipkart' ELSE 'what a day' END AS text""")
    return chat.tag_intents(goals).groupBy("k", "is_action", "is_nav", "is_multi").agg(F.count(F.lit(1)).alias("n"))


@query("search_phrases", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE '' END AS phrase FROM part""")
def search_phrases(spark, sf):
    goals = table(spark, sf, "part").selectExpr("p_partkey", """CASE p_partkey % 3 WHEN 0 THEN concat('please search for ', p_name, ' on amazon and compare it')
        WHEN 1 THEN concat('open wikipedia.org and find "', p_name, '" in the search box') ELSE concat('buy ', p_name) END AS text""")
    return chat.search_phrase(goals).select("p_partkey", "phrase")


@query("target_urls", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('https://x.example.com/p/', cast(p_partkey AS VARCHAR)) WHEN 1 THEN concat('http://localhost:4500/', cast(p_partkey AS VARCHAR))
  WHEN 2 THEN 'https://www.wikipedia.org' WHEN 3 THEN 'https://mosdac.gov.in' END AS url FROM part""")
def target_urls(spark, sf):
    goals = table(spark, sf, "part").selectExpr("p_partkey", """CASE p_partkey % 5 WHEN 0 THEN concat('go to https://x.example.com/p/', cast(p_partkey as string), ', please')
        WHEN 1 THEN concat('try localhost:4500/', cast(p_partkey as string)) WHEN 2 THEN 'open wikipedia.org now' WHEN 3 THEN 'open the mosdac portal' ELSE p_name END AS text""")
    found = catalogs.resolve_portal(goals, "text")
    return chat.target_url(found, portal_url="portal_url").select("p_partkey", "url")


@query("field_assignments", """
SELECT p_partkey AS conv_id, 0 AS pos, 'name' AS target, cast(p_partkey AS VARCHAR) AS value FROM part UNION ALL
SELECT p_partkey, 1, 'e-mail', concat('u', cast(p_partkey AS VARCHAR), '@mail.example.com') FROM part UNION ALL
SELECT p_partkey, 2, 'city', p_brand FROM (SELECT p_partkey, regexp_replace(p_brand, '#', '', 'g') AS p_brand FROM part)""")
def field_assignments(spark, sf):
    goals = table(spark, sf, "part", heavy=True).selectExpr("p_partkey AS conv_id", "0 AS turn", """concat('for name type "', cast(p_partkey as string), '" and type u', cast(p_partkey as string),
        '@mail.example.com in the e-mail then ', regexp_replace(p_brand, '#', ''), ' into the city') AS text""")
    return chat.assignments(goals).select("conv_id", "pos", "target", "value")


@query("listing_facts", """
SELECT p_partkey AS page_id, concat('INR ', cast(p_size AS VARCHAR)) AS prices, concat('AI-', cast(100 + p_size AS VARCHAR)) AS codes, concat('at ', lpad(cast(p_size % 24 AS VARCHAR), 2, '0'), ':30 PM') AS times FROM part""")
def listing_facts(spark, sf):
    els = table(spark, sf, "part").selectExpr("p_partkey AS page_id", """posexplode(array(concat('INR ', cast(p_size as string)), concat('AI-', cast(100 + p_size as string)),
        concat('at ', lpad(cast(p_size % 24 as string), 2, '0'), ':30 PM'), concat('INR ', cast(p_size as string)), 'more')) AS (seq, text)""")
    out = chat.listing_facts(els)
    return out.select("page_id", *[F.array_join(c, "|").alias(c) for c in ("prices", "codes", "times")])


@query("entity_mentions", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'amazon|airindia' ELSE 'github' END AS names FROM orders""")
def entity_mentions(spark, sf):
    goals = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'Amazon or Air India or amazon' ELSE 'GitHub page' END AS text")
    return chat.entities(goals, "text", chat.MULTI_ENTITIES).select("o_orderkey", F.array_join("names", "|").alias("names"))


@query("token_similarity", """
WITH t AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(concat(p_name, ' ', p_type)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2))) AS s FROM part),
b AS (SELECT s, min(id) AS b_id FROM t WHERE id % 20 = 0 GROUP BY s),
a AS (SELECT DISTINCT s FROM t WHERE id % 20 <> 0),
m AS (SELECT a.s, b.b_id, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM a, b),
w AS (SELECT s, min(b_id) AS b_id, arg_min(j, b_id) AS j FROM m WHERE j >= 0.35 GROUP BY s)
SELECT t.id AS a_id, w.b_id, round(w.j, 6) AS jaccard FROM t JOIN w USING (s) WHERE t.id % 20 <> 0""")
def token_similarity(spark, sf):
    """Requests (parts) against earlier requests (every twentieth part)."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    out = chat.similarity_join(parts.filter("id % 20 <> 0"), parts.filter("id % 20 = 0"))
    return out.select("a_id", "b_id", F.round("jaccard", 6).alias("jaccard"))


@query("history_validation", r"""
WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT CASE WHEN s.n > 30 THEN 'too_many_turns' WHEN role NOT IN ('user', 'assistant') THEN 'invalid_role' WHEN text IS NULL THEN 'missing_text'
  WHEN length(text) > 4000 THEN 'too_long' WHEN regexp_matches(text, '(?i)<script\b|javascript:|vbscript:|data:text/html|\beval\s*\(|\bexpression\s*\(') THEN 'script_pattern' ELSE 'valid' END AS outcome
 FROM conversations JOIN s USING (conv_id))
SELECT outcome, count(*) AS turns FROM r GROUP BY 1""")
def history_validation(spark, sf):
    tagged = payloads.tag_conversations(table(spark, sf, "conversations"))
    return tagged.groupBy(F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("turns"))


@query("pii_by_rule")
def pii_by_rule(spark, sf):
    """D1 over conversations: spans per rule and role."""
    found = detect.explode_spans(detect.scan_pii(table(spark, sf, "conversations", heavy=True), "text").select("role", "spans"))
    names = {r.seq: r.name for r in RULES}
    rule = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("rule_seq"))
    return found.groupBy("role", rule.alias("rule")).agg(F.count(F.lit(1)).alias("spans"))


@query("flagship_pii", f"""
WITH e AS (SELECT lang, doc_id, 'email' AS category, unnest(regexp_extract_all(text, '{EMAIL}')) AS s FROM documents),
k AS (SELECT lang, doc_id, s, regexp_replace(s, '[\\s-]', '', 'g') AS d FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '{CARD}')) AS s FROM documents)),
c AS (SELECT lang, doc_id, 'credit_card' AS category, s FROM k WHERE length(d) BETWEEN 13 AND 19 AND {LUHN}),
u AS (SELECT * FROM e UNION ALL SELECT * FROM c)
SELECT lang, category, count(DISTINCT doc_id) AS docs, count(*) AS spans, sum(length(s))::BIGINT AS chars FROM u GROUP BY lang, category""")
def flagship_pii(spark, sf):
    """Documents -> spans -> per language and category: documents hit, spans, characters removed."""
    docs = table(spark, sf, "documents", heavy=True).select("doc_id", "lang", "text")
    found = detect.scan_pii(docs, "text", [RULES_BY_NAME["email"], RULES_BY_NAME["card"]])
    return detect.explode_spans(found.drop("text")).groupBy("lang", "category").agg(
        F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("chars"))


