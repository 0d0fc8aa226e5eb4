"""Lookups in small catalogs.

A catalog is a short list handed over as a parameter; its size is checked before it becomes part of
an expression or a broadcast table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions.blocking import containing_text
from veil.functions.rules import CATEGORY_PRECEDENCE, UNRANKED_CATEGORIES
from veil.functions.util import trim_ws
from veil.operators import fields
from veil.operators.chat import search_phrase
from veil.operators.match import fuzzy, normalize, tokens

CATALOG_LIMIT = 5_000

# A starter directory and starter playbooks. Deployments pass their own lists.
PORTALS = [
    {"id": "isro", "url": "https://www.isro.gov.in",
     "keywords": ["isro", "space", "chandrayaan", "gaganyaan", "aditya", "rocket", "satellite", "pslv", "gslv", "lvm3"]},
    {"id": "bhuvan", "url": "https://bhuvan.nrsc.gov.in",
     "keywords": ["bhuvan", "geoportal", "isro map", "bhuvan maps", "satellite imagery", "thematic layers"]},
    {"id": "wikipedia", "url": "https://www.wikipedia.org", "keywords": ["wikipedia", "encyclopedia"]},
    {"id": "github", "url": "https://github.com", "keywords": ["github", "repository", "source code"]},
]
# Places whose name alone decides the portal, in order: (all of these words, URL).
PORTAL_OVERRIDES = [
    ((("bhuvan",), ("map", "ngmap", "viewer")), "https://bhuvan.nrsc.gov.in/ngmaps"),
    ((("bhuvan",),), "https://bhuvan.nrsc.gov.in"),
    ((("mosdac",),), "https://mosdac.gov.in"),
    ((("vedas",),), "https://vedas.sac.gov.in"),
    ((("bhoonidhi",),), "https://bhoonidhi.nrsc.gov.in"),
    ((("sih", "smart india hackathon"),), "https://sih.gov.in"),
]
PLAYBOOKS = [
    {"domain": "wikipedia.org", "name": "Wikipedia", "aliases": ["wikipedia"],
     "routes": [{"name": "search", "path": "/w/index.php", "keywords": ["search"]},
                {"name": "main", "path": "/wiki/Main_Page", "keywords": ["main page", "home"]}],
     "landmarks": [{"phrase": "Search Wikipedia", "aliases": ["search box", "search"], "role": "input", "action": "type"}],
     "metrics": []},
    {"domain": "github.com", "name": "GitHub", "aliases": ["github"],
     "routes": [{"name": "trending", "path": "/trending", "keywords": ["trending"]}],
     "landmarks": [{"phrase": "Issues", "aliases": ["issues tab"], "role": "tab", "action": "click"}],
     "metrics": [{"metric_id": "stars", "keywords": ["stars", "stargazers"], "pattern": "[0-9][0-9,.]*[kKmMbB]?"}]},
]


def _checked(rows: list) -> list:
    if len(rows) > CATALOG_LIMIT:
        raise ValueError(f"a catalog has at most {CATALOG_LIMIT} entries; join a table instead")
    return rows


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """A named dimension as a broadcast table."""
    made = {
        "keywords": lambda: ([(k,) for k in fields.KEYWORDS], "keyword string"),
        "autocomplete": lambda: ([(k,) for k in fields.AUTOCOMPLETE_VALUES], "value string"),
        "categories": lambda: ([(c, i) for i, c in enumerate(CATEGORY_PRECEDENCE)]
                               + [(c, len(CATEGORY_PRECEDENCE)) for c in UNRANKED_CATEGORIES], "category string, precedence int"),
        "synonyms": lambda: ([(s, a) for s, (al, _, _) in fields.SLOTS.items() for a in al], "slot string, alias string"),
        "portals": lambda: ([(p["id"], p["url"], p["keywords"]) for p in PORTALS], "id string, url string, keywords array<string>"),
        "playbooks": lambda: ([(p["domain"], p["name"], p["aliases"]) for p in PLAYBOOKS],
                              "domain string, name string, aliases array<string>"),
    }
    rows, schema = made[name]()
    return F.broadcast(spark.createDataFrame(_checked(rows), schema))


def resolve_portal(df: DataFrame, col: str, portals=None, overrides=None, out: str = "portal_url") -> DataFrame:
    """Overrides first; else the portal with the longest contained keyword; else a word that is a portal id.

    The catalog travels inside the expression, so no row is ever paired with all keywords.
    """
    portals = _checked(PORTALS if portals is None else portals)
    overrides = PORTAL_OVERRIDES if overrides is None else overrides
    q = F.lower(trim_ws(F.coalesce(F.col(col), F.lit(""))))
    decided = F.lit(None).cast("string")
    for groups, url in reversed(overrides):
        cond = F.lit(True)
        for words in groups:
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | F.contains(q, F.lit(w))
            cond = cond & any_word
        decided = F.when(cond, F.lit(url)).otherwise(decided)
    entries = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(-i).alias("o"), F.lit(p["url"]).alias("url"))
                        for i, p in enumerate(portals) for k in p["keywords"]])
    hits = F.transform(F.filter(entries, lambda e: F.contains(q, e["k"])), lambda e: F.struct(F.length(e["k"]).alias("n"), e["o"], e["url"]))
    words = F.transform(F.split(q, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    by_id = F.lit(None).cast("string")
    for p in reversed(portals):
        by_id = F.when(F.array_contains(words, p["id"]), F.lit(p["url"])).otherwise(by_id)
    return df.withColumn(out, F.coalesce(decided, F.array_max(hits)["url"], by_id))


def lookup_playbook(df: DataFrame, col: str, playbooks=None, out: str = "playbook") -> DataFrame:
    """First playbook whose domain is the host or its suffix, or one of whose aliases the host contains."""
    low = F.lower(trim_ws(F.coalesce(F.col(col), F.lit(""))))
    host = F.when(F.contains(low, F.lit("://")), F.coalesce(F.try_parse_url(low, F.lit("HOST")), F.regexp_replace(
        F.regexp_replace(low, "^[a-z]+://", ""), "[/:].*$", ""))).otherwise(low)
    found = F.lit(None).cast("string")
    for p in reversed(_checked(PLAYBOOKS if playbooks is None else playbooks)):
        cond = (host == p["domain"]) | host.endswith("." + p["domain"])
        for a in p["aliases"]:
            cond = cond | F.contains(host, F.lit(a.lower()))
        found = F.when(cond, F.lit(p["name"])).otherwise(found)
    return df.withColumn(out, found)


def _names(norm: Column, toks: Column, phrase: str) -> Column:
    """Whether a query names a phrase: it contains it, or has a word close to each of its words."""
    p = " ".join("".join(c if c.isalnum() or c in "_-" else " " for c in phrase.lower()).split())
    every = F.lit(bool(p))
    for w in p.split():
        every = every & _close(toks, w)
    return F.contains(norm, F.lit(p)) | every


def _words_close(toks: Column, phrase: str) -> Column:
    """Whether each word of a phrase is one of the query's words or close to one; a part of a longer word does not count."""
    words = "".join(c if c.isalnum() or c in "_-" else " " for c in phrase.lower()).split()
    out = F.lit(bool(words))
    for w in words:
        out = out & (F.array_contains(toks, w) | _close(toks, w))
    return out


def _close(toks: Column, word: str) -> Column:
    def near(t):
        return fuzzy(F.lit(word), t)

    return F.exists(toks, near)


def resolve_intent(df: DataFrame, query: str = "query", url: str = "url", playbook: str = "playbook", playbooks=None) -> DataFrame:
    """Add ``intent, target, confidence``: metric, route, landmark or none within the row's playbook.

    Order: metric questions; for navigation wording the routes; landmarks (inputs first when the
    request searches); routes again with less confidence.
    """
    staged = search_phrase(df, query, "_phrase").withColumn("_n", normalize(F.col(query))).withColumn("_t", tokens(F.col(query)))
    n, t, raw = F.col("_n"), F.col("_t"), F.coalesce(F.col(query), F.lit(""))
    counts = raw.rlike(r"(?i)\b(?:how\s+many|count\s+(?:the\s+)?|total\s+(?:number\s+of\s+)?|number\s+of)") & ~raw.rlike(
        r"(?i)\b(?:search(?:\s+for)?|find|locate|lookup|filter(?:\s+by)?|query|type|bhuvan|geoportal|map|statement\s+for|theme|details)\b")
    goes = raw.rlike(r"(?i)^(?:(?:please|kindly)\s+)?(?:go\s+to|navigate\s+to|visit|open|load|take\s+me\s+to)\b") | F.coalesce(
        F.get(t, F.lit(0)).isin("go", "navigate", "visit", "load"), F.lit(False))
    searches = (F.length("_phrase") > 1) | raw.rlike(r"(?i)\b(?:search(?:\s+for)?|find|locate|lookup|filter(?:\s+by)?|query|type)\b")
    low_url = F.lower(F.coalesce(F.col(url), F.lit("")))

    def answer(intent, target, confidence):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(intent).alias("intent"), lit(target).alias("target"), F.lit(float(confidence)).alias("confidence"))

    out = F.lit(None)
    for p in reversed(_checked(PLAYBOOKS if playbooks is None else playbooks)):
        tries = [F.when(counts & _any([_words_close(t, k) for k in m["keywords"]]), answer("extract_metric", m["keywords"][0], 0.95))
                 for m in p["metrics"]]

        def route(r, confidence, gate, p=p):
            blocked = searches if r["name"] == "search" else F.lit(False)
            there = F.contains(low_url, F.lit(r["path"].lower()))
            return F.when(gate & ~blocked & _any([_names(n, t, k) for k in r["keywords"]]), answer(
                F.when(there, F.lit("none")).otherwise(F.lit("navigate")), f"https://{p['domain']}{r['path']}", confidence))

        tries += [route(r, 0.95, goes) for r in p["routes"]]
        marks = [(m, m["role"] == "input" or m["action"] == "type") for m in p["landmarks"]]

        def landmark(m, is_input, gate):
            return F.when(gate & _any([_names(n, t, a) for a in (m["phrase"], *m["aliases"])]), answer(
                "fill_field" if is_input else "click_landmark", m["phrase"], 0.92 if is_input else 0.94))

        tries += [landmark(m, i, searches) for m, i in marks if i] + [landmark(m, i, searches) for m, i in marks if not i]
        tries += [landmark(m, i, ~searches) for m, i in marks]
        tries += [route(r, 0.85, F.lit(True)) for r in p["routes"]]
        tries.append(answer("none", F.lit(None).cast("string"), 0.2))
        out = F.when(F.col(playbook) == p["name"], F.coalesce(*tries)).otherwise(out)
    blank = answer("none", F.lit(None).cast("string"), 0.0)
    return staged.withColumn("_a", F.when(n == "", blank).otherwise(out)).select(
        *df.columns, "_a.intent", "_a.target", "_a.confidence")


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def reuse_lookup(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``request_id, stored_id``: the first stored request equal to, or (beyond eight characters) contained in, this one.

    ``requests(request_id, text)``, ``stored(stored_id, seq, text)``. Equal texts meet by hash; contained ones by
    their first nine characters among the request's substrings.
    """
    r = requests.select("request_id", _reuse_key(F.col("text")).alias("_r")).filter("_r <> ''")
    s = stored.select("stored_id", "seq", _reuse_key(F.col("text")).alias("_s")).filter("_s <> ''")
    first = s.groupBy("_s").agg(F.min(F.struct("seq", "stored_id")).alias("_first"))
    same = r.join(first, r["_r"] == first["_s"]).select("request_id", "_first")
    inside = containing_text(first.filter(F.length("_s") > 8), r, [], "_s", "_r", gram=9).select("request_id", "_first")
    return same.unionByName(inside).groupBy("request_id").agg(F.min("_first").alias("_f")).select(
        "request_id", F.col("_f.stored_id").alias("stored_id"))


def _reuse_key(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9]+", " "))


# Hosts and paths that are second-hand reading, not the place itself.
_SECOND_HAND = (
    r"/article/|/news/|/blog/|/post/|/learn/|medium\.com|envato\.com|freepik\.com|canva\.com|pinterest\.com|scribd\.com")
# Topic word -> URL patterns in order of preference; the first group also applies on the topic's own site.
RESULT_RULES = (
    ("isro", r"isro\.gov\.in", (r"(?i)isro\.gov\.in", r"(?i)(?:iirs|nrsc|vssc|ursc|sac|isac|prl)\.gov\.in", r"(?i)\.gov\.in")),
    ("bhuvan", r"bhuvan", (r"(?i)bhuvan(?:\.nrsc)?\.gov\.in", r"(?i)nrsc\.gov\.in", r"(?i)\.gov\.in")),
    ("sih|hackathon", r"sih\.gov\.in", (r"(?i)sih\.gov\.in", r"(?i)\.gov\.in")),
)


def best_result(results: DataFrame) -> DataFrame:
    """T4: ``query_id, url, title``: the best search result by ordered domain rules.

    ``results(query_id, pos, query, goal, current_url, url, title)``. Priority is a column of each result, so a
    query's best is a plain minimum.
    """
    said = F.lower(F.concat_ws(" ", "query", "goal"))
    here = F.lower(F.coalesce(F.try_parse_url("current_url", F.lit("HOST")), F.lit("")))
    url = F.coalesce("url", F.lit(""))
    official = here.rlike(r"isro\.gov\.in|bhuvan|sih\.gov\.in")
    rank = F.lit(None).cast("int")
    ladder: list[tuple[Column, int]] = []
    at = 0
    for topic, host, patterns in RESULT_RULES:
        on = here.rlike(host) | said.rlike(topic)
        if topic == "isro":
            files = on & said.rlike("brochure|pdf|download|report|dataset") & url.rlike(r"(?i)\.pdf(?:\?.*)?\z")
            ladder += [(files & url.rlike(r"(?i)isro\.gov\.in"), at), (files & url.rlike(r"(?i)\.gov\.in"), at + 1)]
            at += 2
        for p in patterns:
            ladder.append((on & url.rlike(p), at))
            at += 1
    ladder.append((official & url.rlike(r"(?i)\.gov\.in|\.nic\.in"), at))
    free = ~official
    current = F.coalesce("current_url", F.lit(""))
    other = (url != "") & (url != current) & ~F.startswith(current, url)
    ladder += [(free & said.contains("wikipedia") & url.rlike(r"(?i)wikipedia\.org"), at + 1),
               (free & said.contains("github") & url.rlike(r"(?i)github\.com"), at + 2),
               (free & other & ~url.rlike(_SECOND_HAND), at + 3), (free & other, at + 4)]
    for cond, value in reversed(ladder):
        rank = F.when(cond, F.lit(value)).otherwise(rank)
    return results.withColumn("_p", rank).filter("_p IS NOT NULL").groupBy("query_id").agg(
        F.min_by(F.struct("url", "title"), F.struct("_p", "pos")).alias("_b")).select("query_id", "_b.url", "_b.title")
