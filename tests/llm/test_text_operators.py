"""Each operator against a brute-force version, on awkward rows and on small generated texts."""

from __future__ import annotations

import random
import re
import warnings
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veil.llm import mixing, near_dedup, substring_dedup
from veil.llm.chat_tree import chat_trees, escape, marks, parse, unescape, write_chat_trees
from veil.llm.common import shared_path, table
from veil.llm.components import components
from veil.llm.decontaminate import decontaminate
from veil.llm.exact_dedup import mark_duplicates
from veil.llm.language_id import fit
from veil.llm.line_dedup import drop_repeated_lines
from veil.llm.mixing import fit_rates, mix, mix_with_totals
from veil.llm.near_dedup import near_duplicates
from veil.llm.queries import BUDGET, TARGETS, domain_labels, op3
from veil.llm.substring_dedup import drop_repeated_spans
from veil.llm.suffix_automaton import SuffixAutomaton
from veil.llm.token_files import WordIds, _slices, decode, encode, read_token_files, write_token_files
from veil.llm.url_filter import filter_urls

BPE = public_tokenizers.path("word_bpe_49k.json")
CHAT_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
# doc_id, text: nulls, empty and blank texts, no letters, a very long text, equal ids, equal rows.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! 42"), (5, "one"), (6, LONG), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e"), (8, "other words here now"),
           (9, "A  B\nC d\te"), (None, "a b c d e"), (None, None), (10, "été à la plage 😀 straße"), (11, LONG + " end")]


def docs_of(spark, rows):
    """With columns whose names an operator may want for itself."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.selectExpr("doc_id", "text", "1 AS kept", "2 AS component_id", "3 AS language", "4 AS mix", "5 AS benchmark_hits", "6 AS version", "7 AS cuts", "8 AS n_words")


def empty(spark):
    return docs_of(spark, [])


def vocabulary(seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def corpus(n: int, seed: int = 5) -> list[tuple[int, str]]:
    """Texts with exact copies, light and heavy edits, chains of edits and a passage that many share."""
    rng, words = random.Random(seed), vocabulary(seed)
    passage = [rng.choice(words) for _ in range(25)]
    texts: list[list[str]] = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = list(rng.choice(texts))
        elif texts and kind < 0.55:
            text = list(rng.choice(texts[:3] if kind < 0.35 else texts))
            for _ in range(rng.randint(1, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + passage + text[at:]
        texts.append(text)
    ends = [" ", " ", "\n", "  "]
    return [(i * 3 + 1, "".join(w + rng.choice(ends) for w in t)) for i, t in enumerate(texts)]


def rows_of(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# 1 -------------------------------------------------------------------------------------------------


def windows_of(text, width):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
    return words, {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("limit", [64_000_000, 300])
def test_decontaminate(spark, limit):
    items = [(1, "A b c d e f g h i j k l"), (2, "one"), (12, "b c d e f g h i j k"), (3, None), (4, ""), (None, "zz yy"), (5, "été à")]
    rows = [*AWKWARD, (20, "x A-b c, d e f g h i j k! One"), (21, "a b c d e f g h i"), (22, "zz, yy l"), (23, "xone"), (24, "ÉTÉ été\n à")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    out = decontaminate(docs_of(spark, rows), benchmark, width=10, max_pattern_bytes=limit)
    assert "kept" in out.columns
    found = rows_of(out.selectExpr("doc_id", "text", "benchmark_hits.n_words n", "benchmark_hits.n_hit h", "benchmark_hits.items i", "benchmark_hits.spans s"), "doc_id", "text", "n", "h", "i", "s")
    wanted = []
    for doc_id, text in rows:
        words, _ = windows_of(text, 10)
        hit, ids = set(), set()
        for item, item_text in items:
            for w in windows_of(item_text, 10)[1]:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i:i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        ids |= {str(item)} - {"None"}
        wanted.append((doc_id, text, len(words), len(hit), sorted(ids)))
    assert [f[:5] for f in found] == sorted(wanted, key=lambda r: repr(r[:3]))
    for _, text, _, n_hit, _, spans in found:
        assert sum(len(windows_of(text[s["start"]:s["end"]], 10)[0]) for s in spans) == n_hit
    assert decontaminate(empty(spark), benchmark).count() == 0
    assert decontaminate(docs_of(spark, rows), benchmark.limit(0)).where("benchmark_hits.n_hit > 0").count() == 0


# 2 -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup(spark, hot):
    rows = [*AWKWARD, *[(100 + i, "copy of\t" + " " * (i % 3) + "this") for i in range(1300 if hot else 9)], (99, "copyofthis")]
    found = rows_of(mark_duplicates(docs_of(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    wanted = []
    for body, members in groups.items():
        members.sort()
        wanted += [(m[3], members[0][3], len(members), i == 0, sha256(body.encode()).hexdigest()) for i, m in enumerate(members)]
    assert found == sorted(wanted, key=repr)
    assert mark_duplicates(empty(spark)).count() == 0


# 3 -------------------------------------------------------------------------------------------------


def test_rates_reach_targets_like_plain_projected_gradient(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    t = rng.integers(0, 300, 400)
    features = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens bigint, posteriors array<double>")
    targets = [0.7, 0.29, 0.01]
    steps, reached, wanted = fit_rates(features, targets, budget=1.3, rounds=40)
    r = np.ones(400)
    gram = (p * t[:, None]).T @ p
    for _ in steps:
        r = np.maximum(0, r - p @ np.linalg.solve(gram, (p * (t * r)[:, None]).sum(0) - np.array(wanted)))
    assert np.allclose((p * (t * r)[:, None]).sum(0), reached, rtol=1e-6)
    assert (r >= 0).all() and np.abs(np.array(reached) - wanted).sum() <= 0.02 * t.sum()


def test_mix_reaches_each_target(spark):
    """With the parameters of op3, whose smallest target is 0.02 % of the tokens."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = op3(spark, "/root/testdata/sf0.01").toPandas()
    wanted = {d: BUDGET * rows.n_tokens.sum() * w for d, w in TARGETS.items()}
    for d, w in wanted.items():
        assert abs((rows.n_tokens * rows.rate * rows[f"p_{d}"]).sum() - w) <= 0.01 * w
    assert (rows.rate >= 0).all()
    totals = mix_with_totals(docs, domain_labels(labels), TARGETS, BUDGET)[1]
    assert all(abs(reached - w) <= 0.01 * w and abs(w - wanted[d]) <= 1e-6 * w for d, (reached, w) in totals.items())


def test_default_rates_by_force(spark, monkeypatch):
    """The default path recomputed, at easy targets, at a tenth of them and at none for the toxic ones; passes are counted."""
    passes, sums = [], mixing._sums
    monkeypatch.setattr(mixing, "_sums", lambda *a: passes.append(1) or sums(*a))
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.dirichlet([9, 1, 0.02, 0.01], 900), rng.dirichlet([0.2, 0.3, 9, 0.3], 80), rng.dirichlet([0.2, 0.3, 0.3, 9], 20)])
    t = rng.integers(0, 300, 1000)
    for p, share, reachable in ((p, 1.0, True), (p, 0.1, True), (0.9 * p + 0.025, 0.1, False)):  # each row has at least a fortieth of each domain
        features = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "n_tokens bigint, posteriors array<double>")
        own = (p * t[:, None]).sum(0)
        targets = [own[0], own[1], own[2] / 20 * share, own[3] / 20 * share]
        passes.clear()
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            steps, reached, wanted = fit_rates(features, targets, budget=1.2, whole=[True, True, False, False])
        assert len(passes) <= 15 and any("instead of" in str(w.message) for w in said) != reachable
        r = np.ones(1000)
        for s in steps:
            r = np.maximum(0, r - p @ np.array(s))
        assert np.allclose((p * (t * r)[:, None]).sum(0), reached, rtol=1e-6)
        if reachable:
            assert np.allclose(reached, wanted, rtol=1e-2)
        else:
            assert np.allclose(reached[:2], wanted[:2], rtol=0.1) and (np.array(reached) > wanted)[2:].all()


def test_one_hot_group_of_copies_is_mixed_whole(spark):
    rows = [(i, "same words here fine" if i % 3 else f"badword text {i} badder") for i in range(600)]
    labels = spark.createDataFrame([(i, "good" if i % 3 else "bad") for i in range(0, 600, 2)], "doc_id bigint, domain string")
    out = mix(docs_of(spark, rows), labels, {"good": 0.9, "bad": 0.1}, budget=1.0)
    rates = {r[0] for r in out.where("doc_id % 3 <> 0").select("mix.rate").collect()}
    assert len(rates) == 1 and out.count() == 600


def test_unreachable_targets_warn(spark):
    features = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.6, 0.4])], "n_tokens bigint, posteriors array<double>")
    with pytest.warns(UserWarning, match="instead of"):
        steps, reached, wanted = fit_rates(features, [0.0, 1.0])
    # On the edge (0.6, 0.4) of what rates can reach, (54, 36) is nearest to (0, 30) in the measure of G^-1.
    assert len(steps) == 1 and wanted == [0, 30] and np.allclose(reached, [54, 36], rtol=1e-3)


def test_mix(spark):
    rng, words = random.Random(1), vocabulary(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" badword badder" if i % 5 == 0 else " fine")) for i in range(300)]
    labels = spark.createDataFrame([(i, "bad" if i % 5 == 0 else "good") for i in range(0, 300, 2)] + [(None, "bad"), (4, None), (6, "odd")], "doc_id bigint, domain string")
    short = [r for r in AWKWARD if len(r[1] or "") < 1000]
    out = mix(docs_of(spark, rows + short), labels, {"good": 0.95, "bad": 0.05}, budget=1.1)
    assert "kept" in out.columns and out.count() == len(rows) + len(short)
    found = {r[0]: (r[1], r[2], list(r[3])) for r in out.where("doc_id % 5 IS NOT NULL").selectExpr("doc_id", "mix.rate", "mix.copies", "mix.posteriors").collect()}
    assert all(found[i][2][0] > 0.9 and found[i][0] < 0.7 for i in range(15, 300, 5))
    assert all(found[i][2][1] > 0.9 and found[i][0] > 1 and found[i][1] >= 1 for i in range(16, 300, 5))
    assert all(abs(sum(v[2]) - 1) < 1e-9 and v[1] in (int(v[0]), int(v[0]) + 1) for v in found.values())
    assert mix(empty(spark), labels, {"good": 1.0, "bad": 0.0}).count() == 0
    unlabelled = mix(docs_of(spark, rows), labels.limit(0), {"good": 0.5, "bad": 0.5})
    assert unlabelled.where("abs(mix.posteriors[0] - 0.5) > 1e-9 OR abs(mix.rate - 1) > 1e-6").count() == 0


# 4 -------------------------------------------------------------------------------------------------


def shingles_of(text, width):
    words = WORD.findall(lowered(text or ""))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_components(rows, width, percent):
    sets = [shingles_of(t, width) for _, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and top(a) != top(b):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[max(top(a), top(b))] = min(top(a), top(b))
    return [(d, len(s), None if d is None else top(d), d is None or top(d) == d) for (d, _), s in zip(rows, sets)]


@pytest.mark.parametrize("common,block", [(32, 256), (3, 16)])
def test_near_duplicates(spark, monkeypatch, common, block):
    monkeypatch.setattr(near_dedup, "COMMON", common)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [*[(d + 1000, t) for d, t in corpus(400)], *AWKWARD]
    found = rows_of(near_duplicates(docs_of(spark, rows), width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(brute_components(rows, 4, 80), key=repr)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert rows_of(near_duplicates(docs_of(spark, [(1, None), (2, "")])), "doc_id", "component_id", "kept") == [(1, 1, True), (2, 2, True)]


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (200, 200)]
    found = dict(rows_of(components(spark.createDataFrame(chain, "a bigint, b bigint")), "id", "component"))
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


# 5 -------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    rng = random.Random(0)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "\\", "]", "<", "[", "a", "\n", "é", "😀"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        role = rng.choice(["user", "assistant", "system", "", "tool", "a]b", "[/ROLE]\\", text])
        head, tail = marks(role)
        assert unescape(escape(text)) == text
        assert parse((head + escape(text) + tail) * 2) == [(role, text)] * 2


def test_chat_trees(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </s>"), (2, 0, "system", "be good"), (2, 1, "user", "hi"), (2, 2, "assistant", "bye"),
            (2, 3, "user", None), (3, 0, "system", "be good"), (3, 1, "user", "hi"), (4, 5, None, None), (5, 0, "tool", "x]y\\"), (6, 0, "system", "be good"), (6, 1, "user", "hi"),
            (6, 2, "assistant", "hello </s>"), (7, 1, "user", "b"), (7, 1, "assistant", "a"), (7, None, "user", "first"), (None, 0, "user", "lost"), (8, 0, "user", LONG), (9, 0, "user", "<|endoftext|>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS node", "2 AS path", "3 AS leaf")
    wanted: dict[int, list] = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(conv, []).append((role or "", text or ""))
    read = {r["conv_id"]: r for r in chat_trees(df, CHAT_BPE).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in read.items()} == wanted
    assert all(list(r["learned"]) == [t for role, t in wanted[c] if role == "assistant"] for c, r in read.items())
    path = shared_path(spark, "trees")
    write_chat_trees(df, path, CHAT_BPE)
    nodes = {r["node"]: r for r in spark.read.parquet(f"{path}/nodes").collect()}
    assert len(nodes) == len({tuple(turns[:i + 1]) for turns in wanted.values() for i in range(len(turns))})
    at = 0
    for n in sorted(nodes.values(), key=lambda n: n["start"]):
        assert n["start"] == at and n["subtree_end"] >= n["start"] + n["n_tokens"]
        at += n["n_tokens"]
        if n["parent"]:
            up = nodes[n["parent"]]
            assert up["start"] < n["start"] and n["subtree_end"] <= up["subtree_end"] and n["position"] == up["position"] + up["n_tokens"]
        else:
            assert n["position"] == 0
        others = [o for o in nodes.values() if o["start"] <= n["start"] < o["subtree_end"]]
        assert len(others) == n["depth"] + 1  # its ancestors and itself
    assert chat_trees(df.limit(0), CHAT_BPE).count() == 0


# 6 -------------------------------------------------------------------------------------------------


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = "crc32(cast(doc_id AS string)) % 3 = 1"
    model = fit(docs.where(f"NOT {held}").unionByName(spark.createDataFrame([(1, None, "xx"), (2, "word", None)], docs.schema)))
    out = model.predict(docs.where(held))
    assert out.where("language.lang = lang").count() >= 0.98 * out.count()
    assert out.where("language.score < 0 OR language.score > 1").count() == 0
    odd = model.predict(docs_of(spark, AWKWARD))
    found = rows_of(odd.selectExpr("doc_id", "text", "language.lang AS lang", "language.score AS score"), "doc_id", "text", "lang", "score")
    for _, text, lang, score in found:
        assert (lang == "und" and score == 0) if not re.search(r"[^\W\d_]", text or "") else lang in model.langs
    assert {r["lang"] for r in model.predict(docs_of(spark, [(1, "½ ²"), (2, "漢字")])).select("language.lang").collect()} == {"und", "en"}
    assert fit(docs.limit(0)).predict(docs_of(spark, AWKWARD)).where("language.lang <> 'und'").count() == 0
    assert model.predict(empty(spark)).count() == 0


# 7 -------------------------------------------------------------------------------------------------

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    return lowered(host), re.match(r"[^?#]*", rest[len(host):])[0]


def url_rule(host, path):
    fits = [(len(t), t, v) for v, t in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def test_url_filter(spark):
    urls = [r["url"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net", "http://net/", "http://xnet/a", "https://É.Example.ORG/fr/é?x#y", "http://a.example.net/en/b?c", "http://a.example.net/enx",
             "http://example.com#/de/", "http://u@org:80/fr/", "a://b\n.org/fr/\nz", "http://x.com/" + "long/" * 3000]
    urls += urls[:5]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://q.com/1")], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS gram", "3 AS score")
    found = {r["page_id"]: r for r in filter_urls(df, RULES, order=2).collect()}
    assert len(found) == len(urls) + 1
    order, strength = 2, 4.0
    counts = {side: [Counter() for _ in range(2 * (order + 1))] for side in ("allow", "block")}
    letters = set()

    def grams(url):
        text = "\x02" * order + url + "\x03"
        return [text[i:i + order + 1] for i in range(len(url) + 1)]

    distinct = {u for u in [*urls, "http://q.com/1"] if u}
    sides = {u: url_rule(*url_parts(u))[1] for u in distinct}
    held = {u for u in distinct if zlib.crc32(u.encode()) % 5 == 0}
    for u in distinct:
        letters |= {g[-1] for g in grams(u)}
        if sides[u] and u not in held:
            for g in grams(u):
                for size in range(order + 1):
                    counts[sides[u]][2 * size][g[order - size:]] += 1
                    counts[sides[u]][2 * size + 1][g[order - size:-1]] += 1

    def score(url):
        total = 0.0
        for g in grams(url):
            p = {"allow": 1 / len(letters), "block": 1 / len(letters)}
            for size in range(order + 1):
                p = {s: (counts[s][2 * size][g[order - size:]] + strength * p[s]) / (counts[s][2 * size + 1][g[order - size:-1]] + strength) for s in p}
            total += np.log(p["allow"]) - np.log(p["block"])
        return total / (len(url) + 1)

    of = {s: [score(u) for u in held if sides[u] == s] for s in ("allow", "block")}
    a, b = np.array(of["allow"]), np.array(of["block"])
    threshold = (a.mean() * b.std() + b.mean() * a.std()) / (a.std() + b.std())
    for i, url in [*enumerate(urls), (None, "http://q.com/1")]:
        host, path = url_parts(url)
        rule, verdict = url_rule(host, path)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert (r["score"] is None) == (not url) and (not url or abs(r["score"] - score(url)) < 1e-9)
        assert r["verdict"] == (verdict or ("block" if not url else "allow" if r["score"] >= threshold else "block"))
    assert filter_urls(df.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(df.where("url LIKE '%q.com%'"), RULES).collect()} == {"allow"}


# 8 -------------------------------------------------------------------------------------------------


def test_suffix_automaton_matches():
    rng = random.Random(4)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(4)]
        machine = SuffixAutomaton()
        for t in texts:
            machine.add(t)
        probe = [rng.choice("abc") for _ in range(12)]
        runs = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)} | {()}
        assert machine.matches(probe) == [max(k for k in range(e + 1) if tuple(probe[e - k:e]) in runs) for e in range(1, 13)]


def brute_spans(rows, width):
    least: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (doc_id, _), w in zip(rows, words):
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if doc_id is not None:
                least[key] = min(least.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - width + 1) if doc_id is not None and least[tuple(w[i:i + width])] < doc_id for k in range(width)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [6, 13])
def test_substring_dedup(spark, width):
    rows = [*[(d + 1000, t) for d, t in corpus(300, seed=8)], *AWKWARD, (50, "x " * 40), (51, "y " + "x " * 30), (7, "a b c d e f g h i j k l m n o p"), (52, "q a b c d e f g h i j k l m n o p")]
    assert rows_of(drop_repeated_spans(docs_of(spark, rows), width=width), "doc_id", "n_words", "n_removed", "text") == brute_spans(rows, width)


def test_phrase_with_different_words_around_it(spark):
    """No task gets all unlike pieces of a gram; what is removed stays the same."""
    rng = random.Random(4)
    phrase = "commonphrase ofseveral longishwords everywhere"
    around = [[" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(12)) for _ in range(2)] for _ in range(120)]
    rows = [(i, f"{a} {phrase} {b}") for i, (a, b) in enumerate(around)]
    rows += [(i + 500, f"{around[i][0]} {phrase} {around[i + 1][1]}") for i in range(40)] + [(i + 700, f"x {rows[i][1]} y") for i in range(40)] + [(i + 900, t) for i, t in rows[:20]]
    assert rows_of(drop_repeated_spans(docs_of(spark, rows), hot=20, sample=1), "doc_id", "n_words", "n_removed", "text") == brute_spans(rows, 13)
    named = docs_of(spark, rows).select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    pieces = substring_dedup._repeated_pieces(named, 13, 20, 1)
    assert pieces.groupBy("gram").agg(F.count_distinct("words").alias("n")).agg(F.max("n")).first()[0] <= 20
    assert substring_dedup._hot_grams(named, 13, 10 ** 6, 1) == []


def test_substring_dedup_of_nothing(spark):
    assert drop_repeated_spans(empty(spark)).count() == 0


# 9 -------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "d e", "\t"]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + AWKWARD
    found = rows_of(drop_repeated_lines(docs_of(spark, rows), run=3), "doc_id", "n_lines", "n_removed", "text")
    first: dict[tuple, tuple] = {}
    lines = [[x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")] for _, t in rows]
    for (doc_id, _), w in zip(rows, lines):
        for i in range(len(w) - 2):
            if doc_id is not None:
                key = tuple(w[i:i + 3])
                first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    wanted = []
    for (doc_id, text), w in zip(rows, lines):
        gone = {i + k for i in range(len(w) - 2) if doc_id is not None and first[tuple(w[i:i + 3])] < (doc_id, i) for k in range(3)}
        kept, n = [], 0
        for x in (text or "").split("\n"):
            if x.strip(" \t\x0b\x0c\r"):
                n += 1
                if n - 1 in gone:
                    continue
            kept.append(x)
        wanted.append((doc_id, len(w), len(gone), None if text is None else "\n".join(kept)))
    assert found == sorted(wanted, key=repr)
    assert drop_repeated_lines(empty(spark)).count() == 0


def test_line_dedup_of_single_lines(spark):
    """Runs of one or two lines, and documents shorter than three lines, lose their later copies as well."""
    rows = [(1, "a long line\nb\nc"), (2, " a long line "), (3, "x\nb\n\ny\nx"), (4, "b\nc\nz"), (5, None), (None, "b"), (6, "")]
    found = rows_of(drop_repeated_lines(docs_of(spark, rows)), "doc_id", "n_lines", "n_removed", "text")
    wanted = [(1, 3, 0, "a long line\nb\nc"), (2, 1, 1, ""), (3, 4, 2, "x\n\ny"), (4, 3, 2, "z"), (5, 0, 0, None), (None, 1, 0, "b"), (6, 0, 0, "")]
    assert found == sorted(wanted, key=repr)


# 10 ------------------------------------------------------------------------------------------------


def test_word_aligned_blocks_round_trip():
    rng = np.random.default_rng(0)
    for k in range(300):
        n = int(rng.integers(0, 300))
        ids = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> rng.integers(0, 64, n).astype(np.uint64)
        ids[rng.random(n) < rng.random()] = 0
        assert (decode(encode(ids)) == ids).all()
    assert len(encode(np.zeros(6000, dtype=np.uint64))) == 16 + 800


@pytest.mark.parametrize("name,block_ids", [("word_bpe_49k.json", 1000), ("byte_bpe_50k.json", 1 << 16)])
def test_token_files(spark, name, block_ids):
    import tokenizers

    rows = [*AWKWARD, (-5, "It's don't WE'LL x1y2 İ. Σας a\x1cb <|endoftext|>x"), *corpus(60)]
    path, vocabulary_path = shared_path(spark, "tokens"), public_tokenizers.path(name)
    write_token_files(docs_of(spark, rows), path, vocabulary_path, 1, block_ids=block_ids)
    found = [(r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in read_token_files(spark, path).orderBy("start").collect()]
    plain = tokenizers.Tokenizer.from_file(vocabulary_path)
    wanted = {}
    for doc_id, text in rows:
        wanted.setdefault(doc_id, []).append(np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    at = 0
    for _, start, n, ids in found:
        assert start == at and len(ids) == 4 * n
        at += n
    assert [f[0] for f in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    got: dict = {}
    for doc_id, _, _, ids in found:
        got.setdefault(doc_id, []).append(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_word_ids_equal_the_tokenizer_on_random_texts():
    """Words meet every kind of white space, mark, case and script that the shortcuts tell apart."""
    import pyarrow as pa
    import tokenizers

    rng = np.random.default_rng(7)
    pieces = ["a", "word", "Ünder", "ß", "É", "e\u0301", "İ", "K", "don't", "it's", "'ll", "x1", "12", "日本語", "Σας", "ﬁ", "\u00ad", "🙂", "<|endoftext|>", "<", "|", ">", "_", "-", "'", '"', "***", "@(", "[\\]^`{}~",
              ".", ",", "!?", ";:", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\u00a0", "\u2003", "\u2028", "\u200b", "\u3000", "\u180e", "\ufeff"]
    values = [None, "", " ", *("".join(rng.choice(pieces, int(rng.integers(1, 40)))) for _ in range(4000))]
    plain, ids = tokenizers.Tokenizer.from_file(BPE), WordIds(BPE)
    assert ids.by_word
    wanted = [np.array(plain.encode(v or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for v in values]
    assert ids.of(pa.array(values)) == wanted
    assert ids.of(pa.array(values).slice(3, 5)) == wanted[3:8] and ids.of(pa.array([], pa.string())) == []
    assert [v for rows in _slices(pa.RecordBatch.from_pydict({"i": pa.array(range(4003)), "t": pa.array(values)})) for v in rows.column(1).to_pylist()] == values


def test_token_files_of_nothing(spark):
    path = shared_path(spark, "tokens")
    write_token_files(empty(spark), path, BPE, 1)
    assert read_token_files(spark, path).count() == 0
