"""Sources, sinks, and nested HTML."""

import json

import pytest

from veil.functions.nodes import page_nodes, parse_nodes
from veil.operators import html, quality
from veil.sources import io


def test_parser_implied_ends():
    rows = page_nodes("<ul><li>a<li>b<p>x<div>y</div></ul><table><tr><td>1<td>2<tr><td>3</table><script>var t='</p>'</script>")
    tags = [(r["tag"], r["text"]) for r in rows]
    assert ("li", "a") in tags and ("li", "bxy") in tags and ("p", "x") in tags
    assert [t for n, t in tags if n == "td"] == ["1", "2", "3"]
    assert [r for r in rows if r["tag"] == "script"][0]["text"] == ""


def test_nodes_have_one_parent_each(spark):
    nodes = parse_nodes(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    bad = nodes.filter("parent_id >= node_id OR depth <> size(anc)").count()
    assert bad == 0 and nodes.count() > 100


def test_record_strategies(spark):
    pages = [(1, "<table><tr><th>A</th><th></th></tr><tr><td>x|y</td><td>2</td></tr></table>"), (2, "<ul><li><b>One</b></li><li><b>Two</b></li></ul>"),
             (3, "<dl><dt>K<dd>V</dl>"), (4, "<h1>T</h1><p>d</p>"), (5, "")]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = {}
    for r in html.extract_records(df).collect():
        got.setdefault(r.page_id, []).append((r.strategy, dict(r.record)))
    assert got[1] == [("table", {"A": "x|y", "column_2": "2"})]
    assert sorted(v["title"] for _, v in got[2]) == ["One", "Two"] and got[2][0][0] == "cards"
    assert got[3] == [("generic", {"K": "V"})] and got[4] == [("section", {"section": "T", "detail": "d"})] and 5 not in got
    md = html.to_markdown(html.extract_tables(df)).first().markdown
    assert md == "| A | column_2 |\n| --- | --- |\n| x\\|y | 2 |"


def test_sinks(spark, tmp_path):
    df = spark.range(3).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts")
    path = io.write_run(df, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        io.write_run(df, str(tmp_path / "runs"), "r1")
    io.append_audit(df, str(tmp_path / "a"))
    io.append_audit(df.selectExpr("event_id + 3 AS event_id", "timestamp_seconds(event_id + 3) AS ts"), str(tmp_path / "a"))
    assert sorted(r.event_id for r in io.read_audit(spark, str(tmp_path / "a"), 2).collect()) == [4, 5]
    metrics = spark.createDataFrame([("pii_recall", 99.0), ("cpu_pct", None)], "metric string, value double")
    out = spark.read.json(io.write_scorecard(metrics, str(tmp_path / "s")))
    assert {r.metric: r.verdict for r in out.collect()} == {"pii_recall": "PASSED", "cpu_pct": "NOT_MEASURED"}


def test_json_sources(spark, tmp_path):
    truth = {"page_id": "p", "split": "dev", "boxes": [{"category": "email", "x": 0.1, "y": 0.1, "w": 0.2, "h": 0.1, "token": "a@b.co"}],
             "elements": [{"role": "input", "name": "Mail", "is_sensitive": True}]}
    (tmp_path / "t.json").write_text(json.dumps(truth) + "\n")
    t = io.read_ground_truth(spark, str(tmp_path / "t.json"))
    assert io.truth_boxes(t).first().text == "a@b.co" and io.truth_elements(t).first().name == "Mail"
    (tmp_path / "b.json").write_text('{"run_id":"r","total_ms":5}\n{broken\n')
    rows = io.read_telemetry(spark, [str(tmp_path / "missing.json"), str(tmp_path / "b.json")]).collect()
    assert [r.total_ms for r in rows] == [5, None] and rows[1]._corrupt == "{broken"
    assert io.read_telemetry(spark, [str(tmp_path / "missing.json")]).count() == 0
    (tmp_path / "r.json").write_text(json.dumps([{"scenario_id": "s", "classification": "expected autonomous success", "passed": True, "terminal_state": "complete",
                                                  "interactions": [], "steps": [{"executed": True, "verified": False, "risk": "safe"}]}], indent=1))
    rates = {r.metric: (r.num, r.den) for r in quality.run_rates(io.read_runs(spark, str(tmp_path / "r.json"))).collect()}
    assert rates["incorrect_action"] == (1, 1) and rates["autonomous_completion"] == (1, 1)


def test_registry_is_complete():
    from veil.plans import all_queries

    queries, oracles = all_queries()
    assert set(oracles) <= set(queries) and len(queries) > 130


def test_every_record_of_a_long_page(spark):
    from veil.operators import html

    rows = "".join(f"<tr><td>{i}</td><td>v{i}</td></tr>" for i in range(150))
    cards = "".join(f'<div class="card"><h3>T{i}</h3><p>Some words {i}</p></div>' for i in range(150))
    heads = "".join(f"<h2>H{i}</h2><p>text</p>" for i in range(150))
    long = "x" * 400
    made = [(1, f"<table><tr><th>a</th><th>b</th></tr>{rows}</table>"), (2, f"<div>{cards}</div>"), (3, heads), (4, f'<div role="status">{long}</div>')]
    pages = spark.createDataFrame([(i, "", f"<html><body>{h}</body></html>") for i, h in made], "page_id int, url string, html string")
    counts = {r["page_id"]: r["count"] for r in html.extract_records(pages).groupBy("page_id").count().collect()}
    assert counts[1] == 150 and counts[2] == 150 and counts[3] == 150
    assert html.extract_tables(pages, limit=120).where("page_id = 1").count() == 120
    assert [len(r["text"]) for r in html.status_lines(pages).collect()] == [150]
    assert [len(r["text"]) for r in html.status_lines(pages, cuts=html.ALL).collect()] == [400]
    assert html.page_specs(pages, cuts=html.ALL).where("page_id = 3").count() == 140  # a heading has three characters at least
