"""URL filter (operator 7). DataFrame functions only.

Rules name a host and a path start; the longest that fits decides. Urls that no rule decides are judged by two
character models of variable order, one of accepted and one of rejected urls (those that rules allow and
block): the chance of a character after its context is the context's count smoothed by the chance after the
next shorter context, down to an even share of the alphabet. A url's score is the log-likelihood difference
by character; the threshold is set on a fifth of the ruled urls that the counts do not see.

Every distinct n-gram of all urls gets one row with its counts and then its log ratio; urls meet these rows on
the n-gram. The rows are broadcast only while they number at most ``max_broadcast``; beyond that the join shuffles.

Defined results: a url that is null or empty and fits no rule is blocked; without accepted or rejected examples
every difference is 0 and the threshold is 0, so urls are allowed. Host and path are empty for a url that is null or has no ``://``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stand before and behind a url while its n-grams are taken.
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``rule, verdict`` of the longest rule that fits (of equally long ones the first), else NULLs. ``rules``: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _grams(url: Column, order: int) -> Column:
    """Each character with the ``order`` characters before it; the end counts as one."""
    chars = F.regexp_extract_all(F.concat(F.lit(_START * order), url, F.lit(_END)), F.lit("(?s)."), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.size(chars) - order), lambda at: F.array_join(F.slice(chars, at, order + 1), ""))


def log_ratios(ruled: DataFrame, urls: DataFrame, order: int = 4, strength: float = 4.0) -> DataFrame:
    """``gram, ratio`` of every n-gram of ``urls``; ``ruled``: url, accepted."""
    counted = ruled.select(F.explode(_grams(F.col("url"), order)).alias("gram"), F.col("accepted").cast("long").alias("a"), (~F.col("accepted")).cast("long").alias("r"))
    plain = urls.select(F.explode(_grams(F.col("url"), order)).alias("gram"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))
    grams = written(counted.unionByName(plain).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-grams")
    letters = grams.select(F.countDistinct(F.substring("gram", -1, 1))).first()[0]
    even = F.lit(1.0 / max(1, letters))
    out = grams.select("gram", even.alias("pa"), even.alias("pr"))
    for size in range(order + 1):
        # Java strings are counted from the end: the last character and ``size`` before it.
        tail, before = F.substring("gram", -(size + 1), size + 1), F.substring("gram", -(size + 1), size)
        tails = grams.groupBy(tail.alias("tail")).agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        contexts = grams.groupBy(before.alias("before")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        out = out.withColumns({"tail": tail, "before": before}).join(tails, "tail").join(contexts, "before").select(
            "gram", ((F.col("ta") + strength * F.col("pa")) / (F.col("ca") + strength)).alias("pa"),
            ((F.col("tr") + strength * F.col("pr")) / (F.col("cr") + strength)).alias("pr"))
    both = reduce(lambda a, b: a & b, [grams.agg(F.sum(c) > 0).first()[0] or False for c in ("a", "r")])
    return out.select("gram", (F.log("pa") - F.log("pr") if both else F.lit(0.0)).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = 4,
                max_broadcast: int = 500_000) -> DataFrame:
    """``page_id, host, path, rule, score, verdict`` of every row; ``score`` is NULL where a url has no characters."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, decision = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "decision": decision})

    distinct = rows.where(F.length("url") > 0).groupBy("url").agg(F.first("decision").alias("decision"))
    urls = written(distinct, "urls").withColumn("held", F.pmod(F.crc32("url"), F.lit(5)) == 0)
    ruled = urls.where(F.col("decision").isNotNull() & ~F.col("held")).select("url", (F.col("decision") == "allow").alias("accepted"))
    ratios = written(log_ratios(ruled, urls, order), "url-ratios")
    if ratios.count() <= max_broadcast:
        ratios = F.broadcast(ratios)
    pieces = urls.select("url", "decision", "held", F.explode(_grams(F.col("url"), order)).alias("gram"))
    scores = written(pieces.join(ratios, "gram").groupBy("url", "decision", "held").agg(F.avg("ratio").alias("score")), "url-scores")

    sides = {r["decision"]: r for r in scores.where("held AND decision IS NOT NULL").groupBy("decision").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).collect()}
    threshold = 0.0
    if {"allow", "block"} <= set(sides):
        a, b = sides["allow"], sides["block"]
        spread = a["spread"] + b["spread"]
        # As many spreads from either side's mean.
        threshold = (a["mean"] * b["spread"] + b["mean"] * a["spread"]) / spread if spread > 0 else (a["mean"] + b["mean"]) / 2
    judged = rows.join(scores.select("url", "score"), "url", "left")
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", "score", F.coalesce("decision", by_model).alias("verdict"))
