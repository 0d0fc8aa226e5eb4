"""Jobs that ask several questions of a page's nodes parse the page once."""

import random

import pytest

from veil.functions import nodes as nodes_module
from veil.functions.nodes import node_table, parse_nodes
from veil.operators import html

PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(PAGES)


def parses(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


@pytest.mark.parametrize("job", ["extract_tables", "extract_cards", "extract_kv", "extract_sections", "extract_records", "next_page", "counters", "page_specs", "posts", "status_lines", "page_summary"])
def test_at_most_one_parse(pages, job):
    assert parses(getattr(html, job)(pages)) <= 1


def test_element_context_reads_the_table(pages):
    assert parses(html.element_context(node_table(pages))) == 0


def test_element_context_gathers_no_nodes_on_the_driver(pages):
    plan = html.element_context(node_table(pages))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_the_table_holds_what_was_parsed(spark, pages):
    once, again = node_table(pages), parse_nodes(pages)
    assert once.schema == again.schema
    cols = ["page_id", "node_id", "parent_id", "tag", "cls", "role", "text"]
    assert sorted(map(str, once.select(*cols).collect())) == sorted(map(str, again.select(*cols).collect()))
    assert node_table(pages.limit(0)).count() == 0


def test_cut_markup_is_parsed_like_the_rest():
    """Plain markup is cut by one regex; trees equal HTMLParser's for any order of tags."""
    rng, plain = random.Random(1), 0
    tags = "div p a li ul tr td table br input dl dt dd article select option tbody script svg".split()
    for _ in range(3000):
        page = ""
        for _ in range(rng.randint(0, 25)):
            tag, kind = rng.choice(tags), rng.random()
            given = "".join(f' {rng.choice(["class", "id", "href"])}="{rng.choice(["a b", "", "/p?q=1"])}"' for _ in range(rng.choice([0, 0, 1, 2])))
            page += f"<{tag}{given}{rng.choice(['', '', '/'])}>" if kind < 0.45 else f"</{tag}>" if kind < 0.7 else rng.choice(["x", "\n", ">", " é "])
        plain += bool(nodes_module._PLAIN.fullmatch(page))
        rows = nodes_module.page_nodes(page)
        inside = {i: max([i] + [r["node_id"] for r in rows if any(a[0] == i for a in r["anc"])]) for i in range(len(rows))}
        assert nodes_module.page_tree(page) == [[r["parent_id"], inside[r["node_id"]], r["tag"], r["attrs"], r["text"]] for r in rows], page
    assert plain > 1000


def test_cards_and_posts_are_read_without_a_shuffle(spark):
    """A card's rules stand once in the plan (a pattern is searched and split by): a filter on the record repeated them, and parts met by a shuffle."""
    html_text = '<div class="grid"><div class="card"><h3>A</h3>$5.25</div><div class="card"><p>x@mail.example.com</p></div></div><article><i class="author">B</i><p class="post-body">C</p></article>'
    src = spark.createDataFrame([(1, html_text)], "page_id int, html string")
    cards, posts = html.extract_cards(src), html.posts(src)
    for df, masks in ((cards, 2), (posts, 0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("SECRET_CANARY)") == masks and "Aggregate" not in plan and "Window" not in plan
    assert [(r.row, r.record) for r in cards.orderBy("row").collect()] == [(1, {"title": "A", "price": "$5.25"}), (2, {"description": "[REDACTED_EMAIL]"})]
    assert [(r.kind, r.author, r.body, r.pos) for r in posts.collect()] == [("post", "B", "C", 1)]
