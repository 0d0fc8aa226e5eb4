"""Mixing to target weights (operator 3): soft membership. DataFrame functions only.

1. A classifier is fitted on a labelled table: presence of tokens (runs of letters, pairs of other signs), of which the
   ``max_tokens`` that tell most about the domain are kept among those of ``lift`` times their usual share in one; a document gets a posterior share of each domain (naive Bayes
   over presence and absence). Fitting reads at most ``max_rows`` labelled rows, chosen by a hash of their id.
2. Every document gets a rate, the expected number of its copies. With p its posteriors and t its tokens, domain totals
   are A r = sum t p r, and rates minimise the squared distance of A r from the targets over r >= 0. Projected gradient from
   r = 1: r <- max(0, r - p . G^-1 (A r - target)), with the metric G = sum t p p' over the documents whose rate is positive, so that a
   step is as long in a small domain as in a large one and is exact where no rate meets zero. A pass sums the totals and the next G,
   a few dozen numbers. Rates follow from the posteriors and the steps so far (K numbers each), so none are stored or
   joined between passes. Passes end when each domain is within ``close`` of its own target, or when ``PATIENCE`` of them have not halved the
   sum of squared gaps, each relative to its target: then no rates reach the targets, and the nearest totals found are taken, with a warning;
   ``mix_with_totals`` returns reached and wanted totals.
3. ``copies`` is the rate rounded up or down by a hash of the id, so that its expected value is the rate.

Null text has no tokens and counts for nothing, its rate follows from the posteriors of an empty text. Rows are judged one by one:
repeated rows get equal rates. Labels without an id or domain are left out; of several labels of an id the least counts.
Without labels all domains are equally likely. Targets are shares of ``budget`` times the tokens of all documents.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import texts, written

TOKEN = r"\p{L}+|[^\p{L}\s]{1,2}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _doubles(values: list[float]) -> Column:
    # One text that Spark folds to an array once: a tree of a node a number is costly to plan with.
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>") if values else F.array().cast("array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass
class DomainModel:
    """``base``: log share of a text without any of ``words``; ``weights[k][i]``: what word i adds to domain k."""

    domains: list[str]
    base: list[float]
    words: list[str]
    weights: list[list[float]]

    def posteriors(self, all_tokens: Column) -> Column:
        """Shares of the domains, in their order."""
        # Tables of one entry a word: a plan is printed and kept with all its constants.
        known = F.array(*map(F.lit, self.words)) if self.words else F.array().cast("array<string>")
        slots = F.transform(F.array_intersect(all_tokens, known), lambda w: F.array_position(known, w).cast("int") - 1)
        zero, tables = _doubles(self.base), [_doubles(w) for w in self.weights]
        logs = F.aggregate(slots, zero, lambda s, at: F.array(*[F.get(s, F.lit(k)) + F.get(t, at) for k, t in enumerate(tables)]))
        shifted = F.transform(F.array(logs), lambda v: F.transform(v, lambda x: F.exp(x - F.array_max(v))))
        return F.transform(shifted, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda s, y: s + y)))[0]


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], max_rows: int = 20_000, max_tokens: int = 200, lift: float = 3.0) -> DomainModel:
    """``labelled``: doc_id, domain."""
    spark = docs.sparkSession
    sample = labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")).where(
        F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("domain", F.array_distinct(tokens(F.col("text"))).alias("present"))
    rows = written(rows, "labelled")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    of = [sizes.get(d, 0) for d in domains]
    counts = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    counted = rows.select("domain", F.explode("present").alias("word")).groupBy("word").agg(*counts)
    seen = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))

    def part(both: Column, given: Column, size: int) -> Column:
        """A cell of the mutual information of presence and domain."""
        return F.when(both > 0, both / n * F.log(both * n / (given * size))).otherwise(0.0)

    told = sum((part(F.col(f"n{k}"), seen, of[k]) + part(F.lit(of[k]) - F.col(f"n{k}"), F.lit(n) - seen, of[k]) for k in range(len(domains)) if of[k]), F.lit(0.0))
    # A word of ``lift`` times its usual share in some domain. Weaker ones mostly tell how long a text is, and they are many.
    strong = F.greatest(*[F.col(f"n{k}") * (n / of[k]) if of[k] else F.lit(0.0) for k in range(len(domains))]) >= lift * seen
    best = counted.where(strong).orderBy(told.desc(), "word").limit(max_tokens).collect() if n else []
    base, weights = [], []
    for k in range(len(domains)):
        share = [(r[f"n{k}"] + 0.5) / (of[k] + 1) for r in best]
        base.append(math.log((of[k] + 1) / (n + len(domains))) + sum(math.log(1 - p) for p in share))
        weights.append([math.log(p / (1 - p)) for p in share])
    return DomainModel(domains, base, [r["word"] for r in best], weights)


def _step(gram: list[list[float]], active: list[list[float]], gaps: list[float]) -> list[float]:
    """K numbers s for r <- r - p . s: in the measure of ``gram`` the totals come as near to their targets as the active documents allow."""
    g = np.array(gram)
    root = np.linalg.cholesky(g + np.eye(len(g)) * (1e-12 * np.trace(g)))  # safe against domains without documents
    inner = np.linalg.solve(root, np.linalg.solve(root, np.array(active)).T)
    found = np.linalg.lstsq(inner, np.linalg.solve(root, np.array(gaps)), rcond=1e-9)[0]
    return [float(v) for v in np.linalg.solve(root.T, found)]


def _distance(gram: list[list[float]], gaps: list[float]) -> float:
    """What the steps lessen: the squared distance from the targets in the measure of ``gram``."""
    g = np.array(gram)
    return float(np.array(gaps) @ np.linalg.solve(g + np.eye(len(g)) * (1e-12 * np.trace(g)), np.array(gaps)))


def rate(posteriors: Column, steps: list[list[float]]) -> Column:
    """A document's rate after these steps."""
    if not steps:
        return F.lit(1.0)
    taken = F.expr("array(" + ",".join("array(" + ",".join(f"{v!r}D" for v in s) + ")" for s in steps) + ")")
    return F.aggregate(taken, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - _dot(posteriors, s)))


def _sums(features: DataFrame, k: int, steps: list[list[float]]) -> tuple[float, list[float], list[list[float]]]:
    """In one pass: sum t r r, the totals sum t r p, and sum t p p' of the documents of positive rate."""
    t, r = F.col("n_tokens").cast("double"), F.col("r")
    share = [F.get("posteriors", F.lit(i)) for i in range(k)]
    active = F.when(r > 0, t).otherwise(0.0)
    row = features.withColumn("r", rate(F.col("posteriors"), steps)).agg(
        F.sum(t * r * r), *[F.sum(t * r * p) for p in share], *[F.sum(active * share[i] * share[j]) for i in range(k) for j in range(k)]).first()
    values = [v or 0.0 for v in row]
    return values[0], values[1:1 + k], [values[1 + k + i * k:1 + k + i * k + k] for i in range(k)]


PATIENCE = 3


def fit_rates(features: DataFrame, targets: list[float], budget: float = 1.0, rounds: int | None = None, close: float = 1e-3, whole: list[bool] | None = None) -> tuple[list[list[float]], list[float], list[float]]:
    """Steps, reached totals and wanted totals; ``features``: n_tokens, posteriors.

    Ends when each domain is within ``close`` of its own target (of a ten-thousandth of all tokens, if that is more), or when
    passes gain no more. With ``rounds`` that many steps at most, all in the metric of all documents.
    ``whole``: domains whose wanted total is at least what they have at rate 1; the budget grows by the difference.
    """
    k = len(targets)
    total, reached, gram = _sums(features, k, [])
    wanted = [budget * total * w / (sum(targets) or 1.0) for w in targets]
    wanted = [max(w, own) if keep else w for w, own, keep in zip(wanted, reached, whole or [False] * k)]
    if total == 0:
        return [], reached, wanted
    scale = [max(w, 1e-4 * total) for w in wanted]
    steps: list[list[float]] = []
    tried: list[tuple[float, list[float]]] = []
    off: list[float] = []
    active = gram
    while True:
        gaps = [a - b for a, b in zip(reached, wanted)]
        tried.append((_distance(gram, gaps), reached))
        off.append(sum((g / s) ** 2 for g, s in zip(gaps, scale)))
        if all(abs(g) <= close * s for g, s in zip(gaps, scale)):
            return steps, reached, wanted
        if rounds is not None and len(steps) >= rounds or rounds is None and len(off) > PATIENCE and min(off[-PATIENCE:]) > min(off[:-PATIENCE]) / 2:
            break
        steps.append(_step(gram, active, gaps))
        _, reached, active = _sums(features, k, steps)
        if rounds is not None:
            active = gram
    # The first of those that are as near as any, but for rounding.
    near = min(d for d, _ in tried) * (1 + 1e-9)
    best = len(steps) if rounds is not None else next(i for i, (d, _) in enumerate(tried) if d <= near)
    reached = tried[best][1]
    warnings.warn(f"rates reach the totals {reached} instead of {wanted}", stacklevel=2)
    return steps[:best], reached, wanted


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", out: str = "mix", whole: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``out: struct<n_tokens, posteriors, rate, copies>`` (it replaces a column of that name).

    ``whole``: domains that get the tokens they have at least, whatever their target.
    """
    return mix_with_totals(docs, labelled, targets, budget, id_col, text_col, out, whole)[0]


def mix_with_totals(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", out: str = "mix", whole: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """What ``mix`` returns, and by domain the tokens that the rates reach and those wanted."""
    domains = sorted(targets)
    rows = texts(docs, id_col, text_col)
    model = fit_domains(rows, labelled, domains)

    def judged(text: Column) -> tuple[Column, Column]:
        # One evaluation of the tokens serves both.
        both = F.transform(F.array(tokens(text)), lambda all_: F.struct(F.size(all_).cast("long").alias("n"), model.posteriors(all_).alias("p")))[0]
        return both["n"], both["p"]

    n, p = judged(F.col("text"))
    features = written(rows.select(n.alias("n_tokens"), p.alias("posteriors")), "domain-shares")
    steps, reached, wanted = fit_rates(features, [targets[d] for d in domains], budget, whole=[d in whole for d in domains])
    n, p = judged(F.col(text_col))
    marked = docs.withColumn(out, F.struct(n.alias("n_tokens"), p.alias("posteriors")))
    r = rate(F.col(f"{out}.posteriors"), steps)
    even = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    marked = marked.withColumn(out, F.struct(f"{out}.n_tokens", f"{out}.posteriors", r.alias("rate")))
    copies = F.floor(F.col(f"{out}.rate")) + (even < F.col(f"{out}.rate") - F.floor(F.col(f"{out}.rate"))).cast("long")
    marked = marked.withColumn(out, F.struct(f"{out}.n_tokens", f"{out}.posteriors", f"{out}.rate", copies.alias("copies")))
    return marked, dict(zip(domains, zip(reached, wanted)))
