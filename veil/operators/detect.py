"""Finding and masking sensitive spans in text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import checks
from veil.functions.rules import CANARY_PREFIXES, RULES, WS
from veil.functions.spans import cut_col, spans_col
from veil.functions.util import trim_ws


def scan_pii(df: DataFrame, col: str, rules=RULES, public_handles: bool = False, prefilter: bool = False,
             out: str = "spans") -> DataFrame:
    """Add ``out``: the ordered spans of ``col``."""
    return df.withColumn(out, spans_col(col, rules, public_handles, prefilter))


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span, in span order; rows without spans vanish.

    The outer form with a filter behind it: for the plain form Spark infers filters on the array and
    would run the whole scan once more for each of them.
    """
    keep = [c for c in df.columns if c != spans]
    return df.select(*keep, F.posexplode_outer(spans).alias("seq", "_s")).filter("seq IS NOT NULL").select(
        *keep, "seq", "_s.rule_seq", "_s.category", "_s.start", "_s.end", "_s.confidence")


def order_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Span table -> one ordered array per key."""
    entry = F.struct("start", "rule_seq", "end", "category", "confidence")
    return spans.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("spans"))


def luhn_valid(df: DataFrame, col: str, out: str = "luhn_valid") -> DataFrame:
    return df.withColumn(out, checks.luhn_ok(f"`{col}`"))


def id_valid(df: DataFrame, col: str, out: str = "id_valid") -> DataFrame:
    return df.withColumn(out, checks.twelve_digit_id_ok(f"`{col}`"))


def verhoeff_valid(df: DataFrame, col: str, out: str = "verhoeff_valid") -> DataFrame:
    return df.withColumn(out, checks.verhoeff_ok(f"`{col}`"))


def id_check_digit(df: DataFrame, col: str, out: str = "check_digit") -> DataFrame:
    return df.withColumn(out, checks.verhoeff_digit(f"`{col}`"))


def scrub_text(df: DataFrame, col: str, rules=RULES, public_handles: bool = False) -> DataFrame:
    """Add ``clean`` and ``n_spans``."""
    found = scan_pii(df, col, rules, public_handles, out="_spans")
    return found.withColumn("clean", cut_col(col, "_spans")).withColumn("n_spans", F.size("_spans")).drop("_spans")


def short_name(text):
    """Trimmed; longer than 80 characters becomes 77 plus an ellipsis."""
    trimmed = trim_ws(F.coalesce(text, F.lit("")))
    return F.when(F.length(trimmed) > 80, F.concat(F.substring(trimmed, 1, 77), F.lit("..."))).otherwise(trimmed)


def sanitize_name(df: DataFrame, col: str, out: str = "clean", public_handles: bool = False) -> DataFrame:
    found = scan_pii(df, col, public_handles=public_handles, out="_spans")
    return found.withColumn(out, short_name(cut_col(col, "_spans"))).drop("_spans")


def canary_leaks(df: DataFrame, id_col: str, columns: list[str], canaries) -> DataFrame:
    """Every (row, column, canary) where a planted token is still readable.

    ``canaries`` is a fixed, short list of tokens, so it travels as a literal array.
    """
    tokens = F.array(*[F.lit(c) for c in canaries])
    cells = df.select(F.col(id_col).alias("row_id"), F.explode(F.create_map(*[
        x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column", "_value"))
    hits = cells.withColumn("canary", F.explode(F.filter(tokens, lambda t: F.contains(F.col("_value"), t))))
    return hits.select("row_id", "column", "canary")


def residual_scan(elements: DataFrame, name_col: str = "sanitized_name", id_cols=("page_id", "local_id"),
                  canaries=CANARY_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """Second pass over already cleaned names: ``(clean, leaks)``.

    What a second scan still finds is masked; a name with a planted canary goes to ``leaks``.
    """
    leaked = F.lit(False)
    for c in canaries:
        leaked = leaked | F.contains(F.coalesce(F.col(name_col), F.lit("")), F.lit(c))
    flagged = elements.withColumn("_leak", leaked)
    leaks = flagged.filter("_leak").select(*id_cols, F.col(name_col))
    kept = scan_pii(flagged.filter("NOT _leak").drop("_leak"), name_col, out="_spans")
    return kept.withColumn("residual", F.size("_spans")).withColumn(
        name_col, cut_col(name_col, "_spans")).drop("_spans"), leaks


# Words that are surface chrome, not private content.
_MESSAGE_CHROME = (
    r"(?i)^(?:messages|requests|search|send message|new message|direct|chats|inbox|all|unread|primary|general)\z")
_SNIPPET = rf"(?i)\b(?:sent an attachment|replied to|seen|yesterday|\d+:\d+|\d+{WS}*[hdwm])\b"
_ACCOUNT_CHROME = (
    r"(?i)^(?:login|sign in|sign up|register|cart|orders|notifications|help|wishlist|explore|become a seller|messages"
    r"|requests|direct|chats|home|about|about\s+us|activities|services|programmes|resources|engagements|media"
    r"|missions|careers?|tenders?|faq|contact|contact\s+us|sitemap|feedback|rti|menu|navigation|search|overview"
    r"|gallery|centres|facilities|launchers|satellites)\z")
_DELIVERY_CHROME = r"(?i)^(?:address|location|pin\s*code|postal\s*code)\z"
_DELIVERY_HINT = (
    r"(?i)\b(?:home|work|office|deliver|katra|nagar|colony|road|street|bhavan|bhawan|marg|lane|avenue|floor|block"
    r"|sector|plot|post|pin)\b|[1-9][0-9]{2}\s?[0-9]{3}")


def context_spans(nodes: DataFrame, text: str = "text") -> DataFrame:
    """Label a whole text node by where it stands, when the rules found nothing in it.

    Input flags: ``is_delivery``, ``is_message``, ``is_account``. Delivery text that looks like an
    address, message text and account names are private as a whole.
    """
    found = scan_pii(nodes, text, out="_found")
    trimmed = trim_ws(F.col(text))
    n = F.length(trimmed)
    delivery = (F.col("is_delivery") & (n > 2) & (n < 120) & ~trimmed.rlike(_DELIVERY_CHROME)
                & trimmed.rlike(_DELIVERY_HINT))
    message = F.col("is_message") & (n > 1) & ~trimmed.rlike(_MESSAGE_CHROME)
    snippet = F.contains(trimmed, F.lit("•")) | (n > 35) | trimmed.rlike(_SNIPPET)
    account = F.col("is_account") & (n > 1) & (n < 80) & ~trimmed.rlike(_ACCOUNT_CHROME)
    label = (
        F.when(F.size("_found") > 0, None)
        .when(delivery, F.lit("address"))
        .when(message, F.when(snippet, F.lit("uninspectable")).otherwise(F.lit("username")))
        .when(account, F.lit("username"))
    )
    whole = F.array(F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("rule_seq"), F.length(text).alias("end"),
        F.col("_label").alias("category"), F.lit(0.95).alias("confidence")))
    return found.withColumn("_label", label).withColumn(
        "spans", F.when(F.col("_label").isNotNull(), whole).otherwise(F.col("_found"))).drop("_label", "_found")


def container_spans(nodes: DataFrame, keys=("page_id", "parent_id"), pos: str = "pos", text: str = "text",
                    max_chars: int | None = None) -> DataFrame:
    """Spans that only show once the text pieces of one small container are joined.

    Returns spans whose category none of the container's own pieces already has. A container
    is one inline element, so its pieces are few; ``max_chars`` leaves out larger ones.
    """
    keys = list(keys)
    pieces = scan_pii(nodes, text, out="_own")
    joined = pieces.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("_parts"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("_own", lambda s: s["category"])))).alias("_have"),
        F.count(F.lit(1)).alias("_n"),
    ).filter("_n > 1").withColumn("text", F.array_join(F.transform("_parts", lambda x: x["t"]), ""))
    if max_chars is not None:
        joined = joined.filter(F.length("text") <= max_chars)
    spans = explode_spans(scan_pii(joined.drop("_parts", "_n"), "text"))
    return spans.filter(~F.array_contains("_have", F.col("category"))).drop("_have")
