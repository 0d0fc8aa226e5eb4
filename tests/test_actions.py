"""Action proposals (V4): a golden row for each published kind, and what breaks one."""

import json

import pytest

from veil.operators import payloads

BASE = {"actionId": "a1", "confidence": 0.5, "risk": "safe", "rationale": "r"}
# What a kind needs besides the members that every proposal has.
NEEDS = {"click": {"targetLocalId": "el_1"}, "hover": {"targetLocalId": "el_1"}, "type": {"targetLocalId": "el_1", "textToType": "x"}, "select": {"targetLocalId": "el_1", "selectOptionValue": "x"},
         "drag_and_drop": {"targetLocalId": "el_1", "destinationLocalId": "el_2"}, "upload_file": {"targetLocalId": "el_1", "fileName": "a b.txt"}, "navigate": {"url": "https://a.example"},
         "web_search": {"searchQuery": "q"}, "batch": {"batchActions": [{"actionId": "b", "kind": "wait"}]}}
OTHER = [
    ({"kind": "switch_tab"}, "invalid_kind"), ({"kind": "wait", "tab": 1}, "unknown_property"), ({"kind": "wait", "actionId": "a b"}, "invalid_action_id"), ({"kind": "wait", "confidence": 2}, "invalid_confidence"),
    ({"kind": "wait", "rationale": "see HTTPS://a.example"}, "invalid_rationale"), ({"kind": "wait", "rationale": "x onfoo = 1"}, "invalid_rationale"), ({"kind": "wait", "expectedPostcondition": []}, "invalid_postcondition"),
    ({"kind": "click"}, "missing_target"), ({"kind": "click", "coordinates": [1, 2]}, None), ({"kind": "hover", "coordinates": [1, 2]}, "missing_target"), ({"kind": "click", "targetLocalId": "xpath"}, "invalid_target"),
    ({"kind": "click", "targetLocalId": "el_7"}, "unknown_target"), ({"kind": "drag_and_drop", "targetLocalId": "el_1", "destinationLocalId": "el_7"}, "unknown_target"),
    ({"kind": "upload_file", "targetLocalId": "el_1", "fileName": "../x"}, "invalid_file_name"), ({"kind": "upload_file", "targetLocalId": "el_1"}, "missing_file_name"),
    ({"kind": "type", "targetLocalId": "el_3", "textToType": "x"}, "missing_capability"), ({"kind": "hover", "targetLocalId": "el_3"}, None), ({"kind": "drag_and_drop", "targetLocalId": "el_3", "destinationLocalId": "el_7"}, "unknown_target"),
    ({"kind": "navigate", "targetUrl": ""}, "missing_url"), ({"kind": "navigate", "url": "", "targetUrl": "https://a.example"}, None), ({"kind": "navigate", "url": "javascript:x"}, "invalid_url"),
    ({"kind": "batch", "batchActions": []}, "invalid_batch"), ({"kind": "batch", "batchActions": [{"actionId": "b", "kind": "click", "targetLocalId": "el_7"}]}, "unknown_target"),
    ({"kind": "batch", "batchActions": [{"actionId": "b", "kind": "finish"}]}, "batchActions: invalid_kind"), ({"kind": "extract", "fallbackStrategy": "pray", "completionEvidence": [" URL ", 7, "dream"]}, None),
    ({"kind": "answer", "completionEvidence": "Dialog", "fallbackStrategy": "fail_safe"}, None),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [({"kind": k, **NEEDS.get(k, {})}, None) for k in payloads.ACTION_KINDS] + OTHER
    table = [(1, k, json.dumps({**BASE, **body})) for k, (body, _) in enumerate(rows)] + [(2, 900, json.dumps({**BASE, "kind": "click", "targetLocalId": "el_1"})), (None, 901, "null"), (1, 902, None), (1, 903, "{")]
    actions = spark.createDataFrame(table, "page_id int, seq int, proposal string")
    elements = spark.createDataFrame([(1, "el_1", []), (1, "el_1", None), (1, "el_2", None), (1, "el_3", ["click"]), (None, "el_1", None)], "page_id int, local_id string, caps array<string>")
    found = {r.seq: r for r in payloads.action_extras(payloads.tag_actions(actions, elements)).collect()}
    return rows, found


def test_every_kind_and_rule(judged):
    rows, found = judged
    wrong = {k: (body, found[k].reason, reason) for k, (body, reason) in enumerate(rows) if found[k].reason != reason}
    assert not wrong
    assert found[900].reason == "unknown_target" and {found[k].reason for k in (901, 902, 903)} == {"not_an_object"}


def test_values_left_out(judged):
    rows, found = judged
    by_kind = {body["kind"]: found[k] for k, (body, _) in enumerate(rows) if "completionEvidence" in body}
    assert by_kind["extract"].fallback_strategy is None and by_kind["extract"].completion_evidence == ["url"]
    assert by_kind["answer"].fallback_strategy == "fail_safe" and by_kind["answer"].completion_evidence == ["dialog"]
    assert found[0].completion_evidence is None


def test_equal_proposals_are_judged_once_and_on_every_page(spark, monkeypatch):
    monkeypatch.setattr(payloads, "reason_sql", lambda *_: "uuid()")
    same = json.dumps({**BASE, "kind": "wait"})
    actions = spark.createDataFrame([(page, same) for page in range(40)] + [(None, same), (1, None)], "page_id int, proposal string").repartition(4)
    elements = spark.createDataFrame([(1, "el_1")], "page_id int, local_id string")
    rows = payloads.tag_actions(actions, elements).collect()
    assert len(rows) == 42 and len({r.reason for r in rows if r.proposal == same}) == 1


def test_named_elements_are_taken_out_above_the_scan_only(spark):
    actions = spark.createDataFrame([(1, json.dumps({**BASE, "kind": "wait"}))], "page_id int, proposal string").repartition(3)
    tagged = payloads.tag_actions(actions, spark.createDataFrame([(1, "el_1")], "page_id int, local_id string"))
    plan = tagged._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "batchActions" in line]
