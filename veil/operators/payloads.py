"""Closed-schema validation of JSON payloads and risk tags.

A contract is data: allowed keys and a list of rules. It becomes one ``CASE`` expression that names
the first broken rule, so a table of payloads is split into valid rows and rejects in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions import text_sql as S
from veil.functions.util import settled
from veil.operators.scrub import SCRIPT_PATTERNS, has_script

PROHIBITED_KEYS = ("__proto__", "constructor", "prototype")


@dataclass(frozen=True)
class Rule:
    """``path`` is dotted; ``kind`` is string, enum, number, int, bool, object, array, regex, items or strings."""

    path: str
    kind: str
    reason: str
    required: bool = False
    max_len: int | None = None
    low: float | None = None
    high: float | None = None
    safe: bool = False
    values: tuple = ()
    pattern: str | None = None
    item: "Contract | None" = None
    # a text or identifier that matches this breaks the rule
    never: str | None = None


@dataclass(frozen=True)
class Contract:
    keys: tuple
    rules: tuple = ()
    unknown: str = "unknown_property"
    unique: dict = field(default_factory=dict)
    # (reason, SQL that is true when broken; ``{v}`` stands for the object, ``{m}`` for its members, ``{kind}`` for its kind as text), after all rules
    checks: tuple = ()


_SAFE = "|".join(p.removeprefix("(?i)") for p in SCRIPT_PATTERNS)


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _members(x: str) -> str:
    """An object's members; NULL for anything else."""
    return f"try_variant_get({x}, '$', 'map<string,variant>')"


def _member(m: str, path: str) -> str:
    """The same as :func:`_get`, out of the members."""
    head, _, rest = path.partition(".")
    return _get(f"{m}['{head}']", rest) if rest else f"{m}['{head}']"


def _kind(x: str) -> str:
    return f"schema_of_variant({x})"


def _text(x: str) -> str:
    return f"try_variant_get({x}, '$', 'string')"


def _number(x: str) -> str:
    return f"try_variant_get({x}, '$', 'double')"


def _keys(x: str) -> str:
    return f"coalesce(map_keys({_members(x)}), cast(array() as array<string>))"


def _strange(keys: str, known: tuple) -> str:
    """True when ``keys`` holds one that is not known."""
    k = S.fresh("k")
    return f"exists({keys}, {k} -> NOT ({k} IN ({S.names(known)})))"


def _is_string(x: str) -> str:
    return f"{_kind(x)} = 'STRING'"


def _is_number(x: str) -> str:
    return f"({_kind(x)} = 'BIGINT' OR {_kind(x)} = 'DOUBLE' OR startswith({_kind(x)}, 'DECIMAL'))"


def _ok(r: Rule, x: str) -> str:
    """SQL that is true when present value ``x`` satisfies the rule."""
    if r.kind == "string":
        parts = [_is_string(x)]
        if r.max_len is not None:
            parts.append(f"length({_text(x)}) <= {r.max_len}")
        if r.low:
            parts.append(f"length(trim({_text(x)})) >= {int(r.low)}")
        if r.safe:
            parts.append(f"NOT rlike({_text(x)}, {S.lit('(?i)' + _SAFE)})")
        if r.pattern:
            parts.append(S.rlike(_text(x), r.pattern))
        if r.never:
            parts.append(f"NOT rlike({_text(x)}, {S.lit(r.never)})")
        return " AND ".join(parts)
    if r.kind == "enum":
        return f"{_is_string(x)} AND {_text(x)} IN ({S.names(r.values)})"
    if r.kind == "regex":
        return f"{_is_string(x)} AND {S.rlike(_text(x), r.pattern)}" + (f" AND NOT rlike({_text(x)}, {S.lit(r.never)})" if r.never else "")
    if r.kind in ("number", "int"):
        parts = [_is_number(x)]
        if r.low is not None:
            parts.append(f"{_number(x)} >= {r.low}D")
        if r.high is not None:
            parts.append(f"{_number(x)} <= {r.high}D")
        if r.kind == "int":
            parts.append(f"{_number(x)} = floor({_number(x)})")
        return " AND ".join(parts)
    if r.kind == "bool":
        return f"{_kind(x)} = 'BOOLEAN'"
    if r.kind == "object":
        named = f"NOT {_strange(_keys(x), r.values)}" if r.values else "true"
        return f"startswith({_kind(x)}, 'OBJECT') AND {named}"
    items = f"try_variant_get({x}, '$', 'array<variant>')"
    sized = [f"startswith({_kind(x)}, 'ARRAY')"]
    if r.high is not None:
        sized.append(f"size({items}) <= {int(r.high)}")
    if r.low is not None:
        sized.append(f"size({items}) >= {int(r.low)}")
    if r.kind == "strings":
        e = S.fresh("e")
        inner = Rule("", "enum" if r.values else "string", "", max_len=r.max_len, safe=r.safe, values=r.values)
        sized.append(f"coalesce(forall({items}, {e} -> {_ok(inner, e)}), false)")
        if r.pattern == "distinct":
            sized.append(f"size(array_distinct(try_variant_get({x}, '$', 'array<string>'))) = size({items})")
    elif r.kind == "numbers":
        e = S.fresh("e")
        inner = Rule("", "number", "", low=r.values[0], high=r.values[1])
        sized.append(f"coalesce(forall({items}, {e} -> {_ok(inner, e)}), false)")
    return " AND ".join(sized)


def _opened(v: str) -> dict[str, str]:
    """What :func:`reason_sql` asks of an object again and again, to be worked out once."""
    return {"m": _members(v), "kind": f"try_variant_get({v}, '$.kind', 'string')"}


def reason_sql(v: str, contract: Contract, m: str, kind: str) -> str:
    """First broken rule of variant ``v`` as a reason, NULL when all hold.

    ``m`` and ``kind`` name what :func:`_opened` gives for ``v``: a look into a map costs far less than a walk through the variant.
    """
    parts = [S.case(
        (f"{m} IS NULL", "'not_an_object'"),
        (_strange(f"map_keys({m})", contract.keys), f"'{contract.unknown}'"), otherwise="NULL")]
    for r in contract.rules:
        x = _member(m, r.path)
        # A rule inside an optional object only applies when the object is there.
        parent = f"{_member(m, r.path.rsplit('.', 1)[0])} IS NOT NULL AND " if r.required and "." in r.path else ""
        missing = f"{parent}{x} IS NULL" if r.required else "false"
        parts.append(f"CASE WHEN ({missing}) OR ({x} IS NOT NULL AND NOT coalesce({_ok(r, x)}, false)) THEN '{r.reason}' END")
        if r.item is not None:
            e, i, q = S.fresh("e"), S.fresh("i"), S.fresh("q")
            opened = ", ".join(f"'{name}', {sql}" for name, sql in _opened(e).items())
            items = f"transform(try_variant_get({x}, '$', 'array<variant>'), {e} -> named_struct('v', {e}, {opened}))"
            bad = f"get(filter(transform({items}, {i} -> {reason_sql(f'{i}.v', r.item, f'{i}.m', f'{i}.kind')}), {q} -> {q} IS NOT NULL), 0)"
            parts.append(f"CASE WHEN {x} IS NOT NULL THEN concat('{r.path}: ', {bad}) END")
    for path, key in contract.unique.items():
        e = S.fresh("e")
        ids = f"transform(try_variant_get({v}, '$.{path}', 'array<variant>'), {e} -> {_text(_get(e, key))})"
        parts.append(f"CASE WHEN size(array_distinct({ids})) < size({ids}) THEN 'duplicate_{key}' END")
    for reason, broken in contract.checks:
        for name, sql in (("{v}", v), ("{m}", m), ("{kind}", kind)):
            broken = broken.replace(name, sql)
        parts.append(f"CASE WHEN {broken} THEN '{reason}' END")
    return f"coalesce({', '.join(parts)})"


# ---------------------------------------------------------------------------
# The payload contracts.
# ---------------------------------------------------------------------------
ROLES = ("button", "link", "input", "select", "textarea", "checkbox", "radio", "menuitem", "tab", "heading", "dialog", "generic")
STATES = ("enabled", "disabled", "visible", "checked", "focused", "filled")
CAPABILITIES = ("click", "type", "select", "scroll", "hover", "drag", "upload")
LOCAL_ID = r"^[a-zA-Z0-9_-]{1,64}\z"
RUN_ID = r"^[a-zA-Z0-9_-]{1,128}\z"
ELEMENT_KEYS = ("localId", "role", "sanitizedName", "coarseBounds", "state", "actionCapabilities", "containerContext",
                "nearestHeading", "isInsideDialog", "verticalOffset", "inViewport")
PAGE_STATE_KEYS = ("title", "pageTitle", "viewport", "visibleDialogCount", "dialogTitles", "statusSummaries", "routeFingerprint",
                   "postconditionSummary", "counters", "contentSummaries", "domain", "scrollMetrics", "url", "canonicalUrl",
                   "stateDelta", "pageZone")
STATE_DELTA_KEYS = ("previousAction", "urlChanged", "previousUrl", "currentUrl", "elementsAddedCount", "elementsRemovedCount",
                    "scrollDeltaY", "dialogOpened", "observedOutcome", "verificationPassed")
PREVIOUS_ACTION_KEYS = ("kind", "targetName", "targetLocalId", "textToType", "expectedState")
SCROLL_KEYS = ("scrollTop", "scrollHeight", "clientHeight", "maxScrollTop", "scrollableBelow", "scrollableAbove", "pixelsBelow",
               "pixelsAbove")
MANIFEST_KEYS = ("manifestVersion", "totalRegions", "categoryCounts", "methodCounts", "placeholderConvention",
                 "geometrySemantics", "pixelVerificationPerformed", "pixelVerificationPassed", "uninspectableSurfacePolicy",
                 "visionAttempted", "visionSucceeded", "visionProvider", "visionModel", "categoryBreakdown", "durationMs")
REASONING_KEYS = ("protocolVersion", "runId", "goal", "screenshot", "elements", "pageState", "redactionManifest", "history",
                  "customPrompt", "executionFeedback", "taskSpecification", "objectiveProgress", "currentObjective",
                  "previousAction", "expectedPostcondition", "observedOutcome", "meaningfulProgress", "recentActionHistory",
                  "searchResults")
CHAT_KEYS = ("protocolVersion", "message", "elements", "sanitizedTitle", "maskCount", "history", "customPrompt")


def element_contract(chat: bool = False) -> Contract:
    return Contract(ELEMENT_KEYS, (
        Rule("localId", "regex", "invalid_local_id", required=True, pattern=LOCAL_ID),
        Rule("role", "enum", "invalid_role", required=not chat, values=ROLES),
        Rule("sanitizedName", "string", "invalid_name", max_len=120, safe=True),
        Rule("coarseBounds", "numbers", "invalid_bounds", low=4, high=4, values=(0, 1)),
        Rule("state", "strings", "invalid_state", values=STATES, pattern="distinct"),
        Rule("actionCapabilities", "strings", "invalid_capability", values=CAPABILITIES, pattern="distinct"),
        Rule("containerContext", "string", "invalid_context", max_len=300, safe=True),
        Rule("nearestHeading", "string", "invalid_heading", max_len=120, safe=True),
        Rule("isInsideDialog", "bool", "invalid_dialog_flag"),
        Rule("verticalOffset", "enum", "invalid_vertical_offset", values=("in_view", "above", "below")),
        Rule("inViewport", "bool", "invalid_viewport_flag")), "unknown_element_property",
        checks=(("contradictory_state", "array_contains(try_variant_get({v}, '$.state', 'array<string>'), 'enabled') "
                 "AND array_contains(try_variant_get({v}, '$.state', 'array<string>'), 'disabled')"),))


def _differs(counts: str, names: tuple[str, ...]) -> str:
    """True when the named counts of a manifest (those that are numbers) do not add up to its regions."""
    at = "$.redactionManifest." + counts
    one = lambda n: f"try_variant_get({{v}}, '{at}.{n}', 'variant')"
    total = " + ".join(f"CASE WHEN {_is_number(one(n))} THEN try_variant_get({{v}}, '{at}.{n}', 'double') ELSE 0D END" for n in names)
    return f"try_variant_get({{v}}, '{at}', 'variant') IS NOT NULL AND {total} <> try_variant_get({{v}}, '$.redactionManifest.totalRegions', 'double')"


_FLAG = "coalesce(try_variant_get({{v}}, '$.redactionManifest.{0}', 'boolean'), false)"
MANIFEST_CHECKS = (
    ("contradictory_manifest", _differs("categoryCounts", ("piiText", "domInput", "face", "surface"))),
    ("contradictory_manifest", _differs("methodCounts", ("opaqueBox", "spatialBlur"))),
    ("pixels_not_verified", "try_variant_get({v}, '$.redactionManifest.totalRegions', 'double') > 0 "
     "AND try_variant_get({v}, '$.redactionManifest.pixelVerificationPerformed', 'variant') IS NOT NULL "
     f"AND NOT ({_FLAG.format('pixelVerificationPerformed')} AND {_FLAG.format('pixelVerificationPassed')})"),
)


HISTORY_ITEM = Contract(("role", "content"), (
    Rule("role", "enum", "invalid_history_role", required=True, values=("user", "assistant")),
    Rule("content", "string", "invalid_history_content", required=True, max_len=4000, safe=True)), "unknown_history_property")

REASONING = Contract(REASONING_KEYS, (
    Rule("protocolVersion", "enum", "unsupported_version", required=True, values=("1.0",)),
    Rule("runId", "regex", "invalid_run_id", required=True, pattern=RUN_ID),
    Rule("goal", "string", "invalid_goal", required=True, low=1, max_len=2000, safe=True),
    Rule("screenshot", "regex", "invalid_screenshot", required=True,
         pattern=r"^data:image/(?:png|jpeg|webp);base64,[A-Za-z0-9+/=]+\z"),
    Rule("screenshot", "string", "screenshot_too_large", max_len=5_592_430),
    Rule("pageState", "object", "invalid_page_state", required=True, values=PAGE_STATE_KEYS),
    Rule("pageState.title", "string", "invalid_title", required=True, max_len=200, safe=True),
    Rule("pageState.pageTitle", "string", "invalid_page_title", max_len=200, safe=True),
    Rule("pageState.canonicalUrl", "string", "invalid_canonical_url", max_len=2048, safe=True),
    Rule("pageState.viewport", "numbers", "invalid_viewport", required=True, low=2, high=2, values=(1e-9, 100000)),
    Rule("pageState.visibleDialogCount", "int", "invalid_dialog_count", low=0),
    Rule("pageState.dialogTitles", "strings", "invalid_dialog_titles", high=50, max_len=200, safe=True),
    Rule("pageState.statusSummaries", "strings", "invalid_status_summaries", high=50, max_len=300, safe=True),
    Rule("pageState.routeFingerprint", "string", "invalid_route", max_len=200, safe=True),
    Rule("pageState.postconditionSummary", "string", "invalid_postcondition_summary", max_len=500, safe=True),
    Rule("pageState.counters", "array", "invalid_counters", high=50, item=Contract(("label", "value"), (
        Rule("label", "string", "invalid_counter", required=True, max_len=200, safe=True),
        Rule("value", "string", "invalid_counter", required=True, max_len=200, safe=True)))),
    Rule("pageState.contentSummaries", "strings", "invalid_content_summaries", high=50, max_len=500, safe=True),
    Rule("pageState.domain", "string", "invalid_domain", max_len=100, safe=True),
    Rule("pageState.pageZone", "enum", "invalid_zone", values=("private_workspace", "hybrid", "public_broadcast")),
    Rule("pageState.scrollMetrics", "object", "invalid_scroll_metrics", values=SCROLL_KEYS),
    *[Rule(f"pageState.scrollMetrics.{k}", "number", "invalid_scroll_metrics", required=True, low=0)
      for k in ("scrollTop", "scrollHeight", "clientHeight", "maxScrollTop", "pixelsBelow", "pixelsAbove")],
    *[Rule(f"pageState.scrollMetrics.{k}", "bool", "invalid_scroll_flag", required=True)
      for k in ("scrollableBelow", "scrollableAbove")],
    Rule("pageState.url", "string", "invalid_url", max_len=2048, safe=True),
    Rule("pageState.stateDelta", "object", "invalid_state_delta", values=STATE_DELTA_KEYS),
    Rule("pageState.stateDelta.urlChanged", "bool", "invalid_state_delta"),
    Rule("pageState.stateDelta.previousUrl", "string", "invalid_state_delta", max_len=2048, safe=True),
    Rule("pageState.stateDelta.currentUrl", "string", "invalid_state_delta", max_len=2048, safe=True),
    Rule("pageState.stateDelta.elementsAddedCount", "number", "invalid_state_delta"),
    Rule("pageState.stateDelta.elementsRemovedCount", "number", "invalid_state_delta"),
    Rule("pageState.stateDelta.scrollDeltaY", "number", "invalid_state_delta"),
    Rule("pageState.stateDelta.dialogOpened", "string", "invalid_state_delta", max_len=200, safe=True),
    Rule("pageState.stateDelta.observedOutcome", "string", "invalid_state_delta", max_len=1000, safe=True),
    Rule("pageState.stateDelta.verificationPassed", "bool", "invalid_state_delta"),
    Rule("pageState.stateDelta.previousAction", "object", "invalid_previous_action", values=PREVIOUS_ACTION_KEYS),
    Rule("pageState.stateDelta.previousAction.kind", "string", "invalid_previous_action", required=True, max_len=50, safe=True),
    Rule("pageState.stateDelta.previousAction.targetName", "string", "invalid_previous_action", max_len=200, safe=True),
    Rule("pageState.stateDelta.previousAction.targetLocalId", "string", "invalid_previous_action", max_len=100, safe=True),
    Rule("pageState.stateDelta.previousAction.textToType", "string", "invalid_previous_action", max_len=1000, safe=True),
    Rule("pageState.stateDelta.previousAction.expectedState", "string", "invalid_previous_action", max_len=200, safe=True),
    Rule("redactionManifest", "object", "invalid_manifest", values=MANIFEST_KEYS),
    Rule("redactionManifest.manifestVersion", "enum", "invalid_manifest", required=True, values=("1.0",)),
    Rule("redactionManifest.totalRegions", "int", "invalid_manifest", required=True, low=0),
    Rule("redactionManifest.placeholderConvention", "enum", "invalid_manifest", values=("[REDACTED]",)),
    Rule("redactionManifest.geometrySemantics", "enum", "invalid_manifest", values=("clamped_css_pixels",)),
    Rule("redactionManifest.uninspectableSurfacePolicy", "enum", "invalid_manifest", values=("fail_closed",)),
    *[Rule(f"redactionManifest.{k}", "object", "invalid_manifest") for k in ("categoryCounts", "methodCounts", "categoryBreakdown")],
    Rule("elements", "array", "invalid_elements", high=200, item=element_contract()),
    Rule("history", "array", "invalid_history", high=30, item=HISTORY_ITEM),
    Rule("customPrompt", "string", "invalid_custom_prompt", max_len=4000, safe=True),
), unique={"elements": "localId"}, checks=MANIFEST_CHECKS)

CHAT = Contract(CHAT_KEYS, (
    Rule("protocolVersion", "enum", "unsupported_version", required=True, values=("1.0",)),
    Rule("message", "string", "invalid_message", required=True, low=1, max_len=2000, safe=True),
    Rule("sanitizedTitle", "string", "invalid_title", max_len=200, safe=True),
    Rule("maskCount", "int", "invalid_mask_count", low=0),
    Rule("elements", "array", "invalid_elements", high=100, item=element_contract(chat=True)),
    Rule("history", "array", "invalid_history", high=30, item=HISTORY_ITEM),
    Rule("customPrompt", "string", "invalid_custom_prompt", max_len=4000, safe=True),
), unique={"elements": "localId"})

TASK_REQUEST = Contract(("protocolVersion", "goal", "contextUrl", "maxParallel", "privacyTier"), (
    Rule("protocolVersion", "enum", "unsupported_version", required=True, values=("1.0",)),
    Rule("goal", "string", "invalid_goal", required=True, low=1, max_len=2000, safe=True),
    Rule("contextUrl", "string", "invalid_context_url", max_len=2048, safe=True),
    Rule("maxParallel", "int", "invalid_max_parallel", low=1, high=4),
    Rule("privacyTier", "enum", "invalid_privacy_tier", values=("strict_dpdp", "standard")),
))

# Action proposals. Kinds, keys and patterns as they are published.
ACTION_KINDS = ("observe", "navigate", "click", "hover", "type", "select", "drag_and_drop", "upload_file", "scroll", "wait", "extract", "answer",
                "request_user_confirmation", "request_user_input", "batch", "spawn_subagents", "web_search", "finish", "blocked")
RISKS = ("safe", "protected", "blocked")
DIRECTIONS = ("up", "down", "top", "bottom")
ACTION_KEYS = ("actionId", "objectiveId", "kind", "targetLocalId", "destinationLocalId", "confidence", "risk", "rationale", "expectedState",
               "expectedPostcondition", "semanticMatchReason", "fallbackStrategy", "completionEvidence", "textToType", "fileName", "fileData",
               "mimeType", "selectOptionValue", "scrollDirection", "tabId", "userApproved", "pressEnter", "extractedData", "extractSchema",
               "extractLimit", "containerSelector", "extractedItems", "answerText", "reply", "message", "reasoning", "thought", "batchActions",
               "userInputPrompt", "inputKey", "subTasks", "coordinates", "url", "targetUrl", "createNewTab", "description", "targetName",
               "elementText", "searchQuery", "searchResults")
ATOMIC_KINDS = ("click", "hover", "type", "select", "drag_and_drop", "upload_file", "scroll", "wait", "observe", "extract", "answer",
                "request_user_input", "navigate")
ATOMIC_KEYS = ("actionId", "kind", "targetLocalId", "destinationLocalId", "textToType", "selectOptionValue", "scrollDirection", "pressEnter",
               "fileName", "userInputPrompt", "inputKey", "reply", "reasoning", "rationale", "userApproved", "coordinates", "confidence", "risk",
               "prompt", "message", "thought", "url", "targetUrl", "createNewTab", "description", "searchQuery")
FALLBACKS = ("reperceive", "wait_for_hydration", "retry_target", "scroll_to_target", "navigate_fallback", "refresh_once", "request_user_input", "fail_safe")
EVIDENCE = ("url", "element", "text", "input_value", "dialog", "attribute", "scroll", "visual_change")
# What a postcondition of each kind may say besides its kind.
POSTCONDITIONS = {
    "dialog_visible": ("dialogId",), "panel_visible": ("namePattern",), "element_visible": ("targetLocalId", "namePattern"),
    "element_count_changed": ("minimumDelta",), "visual_change": ("minimumChangeRatio",), "map_location_changed": ("locationPattern",),
    "search_results_visible": ("queryPattern",), "content_visible": ("textPattern",), "url_changed": ("expectedPathFragment",),
    "attribute_changed": ("attributeName", "expectedValue"), "value_present": ("expectedValueFragment",), "select_changed": ("expectedOptionValue",),
    "status_changed": ("statusId",), "scroll_changed": ("direction",), "visibility_changed": ("targetLocalId", "state"), "answer_supported": ("queryTopic",),
}
WATCHED_ATTRIBUTES = ("aria-expanded", "aria-checked", "aria-selected", "disabled", "open", "class")
_W = r"[A-Za-z0-9_]"
_SCRIPT = rf"(?i)<script(?!{_W})|javascript:|vbscript:|data:text/html|(?<!{_W})on{_W}+\s*=|(?<!{_W})eval\s*\(|(?<!{_W})expression\s*\("
_LINK = r"https?://|ftp://|file://|wss?://|blob:|data:"
_SELECTOR = rf"^\s*[#.]|//|(?<!{_W})xpath(?!{_W})|(?<!{_W})contains\s*\(|(?<!{_W})text\s*\(\s*\)|[\[\]>+~:]"
_NO_LINK = f"{_SCRIPT}|{_LINK}"
_NO_SELECTOR = f"{_NO_LINK}|{_SELECTOR}"


def _postcondition() -> tuple:
    at = "expectedPostcondition."
    value = lambda k: f"try_variant_get({{v}}, '$.{at}{k}', 'variant')"
    text = lambda k: f"try_variant_get({{v}}, '$.{at}{k}', 'string')"
    there = "{m}['expectedPostcondition']"
    kind = f"coalesce({text('kind')}, '')"
    extra = " OR ".join(f"({kind} = '{name}' AND {_strange(_keys(there), ('kind', *keys))})" for name, keys in POSTCONDITIONS.items())
    number = lambda key, low, high: f"({value(key)} IS NOT NULL AND NOT coalesce({_ok(Rule('', 'number', '', low=low, high=high), value(key))}, false))"
    said = "(" + " OR ".join(f"coalesce({_is_string(value(key))} AND rlike({text(key)}, {S.lit(_NO_SELECTOR)}), false)" for key in sorted({"kind", *(x for v in POSTCONDITIONS.values() for x in v)})) + ")"
    broken = (("unknown_postcondition_kind", f"NOT ({kind} IN ({S.names(tuple(POSTCONDITIONS))}))"), ("unknown_postcondition_property", f"({extra})"),
              ("invalid_minimum", f"({number('minimumDelta', 1, None)} OR {number('minimumChangeRatio', 0, 1)})"),
              ("invalid_attribute", f"({kind} = 'attribute_changed' AND NOT coalesce({text('attributeName')} IN ({S.names(WATCHED_ATTRIBUTES)}), false))"),
              ("invalid_direction", f"({kind} = 'scroll_changed' AND NOT coalesce({text('direction')} IN ({S.names(DIRECTIONS)}), false))"),
              ("invalid_visibility", f"({kind} = 'visibility_changed' AND NOT coalesce({text('state')} IN ('visible', 'hidden'), false))"),
              ("unsafe_postcondition", said))
    return tuple((reason, f"{there} IS NOT NULL AND {sql}") for reason, sql in broken)


def _says_within(kind: str, reason: str, value: str, most: int) -> tuple[str, str]:
    """A kind needs a text of 1 to ``most`` characters."""
    return reason, f"{{kind}} = '{kind}' AND (coalesce(length({value}), 0) NOT BETWEEN 1 AND {most} OR rlike({value}, {S.lit(_SCRIPT)}))"


_SUB = "try_variant_get({{v}}, '$.{0}', 'string')"
_URL = f"coalesce(nullif({_SUB.format('url')}, ''), {_SUB.format('targetUrl')})"
_TARGETED = "('click', 'hover', 'type', 'select', 'upload_file')"
_NEEDS = (_says_within("type", "missing_text", _SUB.format("textToType"), 500), _says_within("select", "missing_option", _SUB.format("selectOptionValue"), 200),
          _says_within("navigate", "missing_url", _URL, 2000))
ATOMIC = Contract(ATOMIC_KEYS, (
    Rule("actionId", "regex", "invalid_action_id", required=True, pattern=RUN_ID),
    Rule("kind", "enum", "invalid_kind", required=True, values=ATOMIC_KINDS),
    Rule("targetLocalId", "regex", "invalid_target", pattern=LOCAL_ID, never=_SELECTOR),
    Rule("scrollDirection", "enum", "invalid_scroll_direction", values=DIRECTIONS),
    Rule("rationale", "string", "invalid_rationale", max_len=500),
), checks=(("missing_target", f"{{kind}} IN {_TARGETED} AND coalesce({_SUB.format('targetLocalId')}, '') = ''"), *_NEEDS))
ACTION = Contract(ACTION_KEYS, (
    Rule("actionId", "regex", "invalid_action_id", required=True, pattern=RUN_ID, never=_NO_LINK),
    Rule("objectiveId", "regex", "invalid_objective_id", pattern=RUN_ID),
    Rule("kind", "enum", "invalid_kind", required=True, values=ACTION_KINDS),
    Rule("confidence", "number", "invalid_confidence", required=True, low=0, high=1),
    Rule("risk", "enum", "invalid_risk", required=True, values=RISKS),
    Rule("rationale", "string", "invalid_rationale", required=True, max_len=1000, never=_NO_LINK),
    Rule("reasoning", "string", "invalid_reasoning", max_len=5000, never=_NO_LINK),
    Rule("reply", "string", "invalid_reply", max_len=5000, never=_NO_LINK),
    Rule("semanticMatchReason", "string", "invalid_match_reason", max_len=1000, never=_NO_LINK),
    Rule("expectedState", "string", "invalid_expected_state", max_len=500, never=_NO_LINK),
    Rule("expectedPostcondition", "object", "invalid_postcondition"),
    Rule("scrollDirection", "enum", "invalid_scroll_direction", values=DIRECTIONS),
    Rule("destinationLocalId", "regex", "invalid_destination", pattern=LOCAL_ID, never=_SELECTOR),
    Rule("tabId", "int", "invalid_tab_id", low=0),
    Rule("fileName", "string", "invalid_file_name", max_len=255, pattern=r"^(?s:.+)\z", never=rf"{_SCRIPT}|\.\.|[/\\]"),
    Rule("fileData", "string", "invalid_file_data", max_len=5 * 1024 * 1024),
    Rule("mimeType", "string", "invalid_mime_type", max_len=100, pattern=r"^[a-zA-Z0-9.+/-]+\z"),
    Rule("targetLocalId", "regex", "invalid_target", pattern=LOCAL_ID, never=_SELECTOR),
    Rule("coordinates", "numbers", "invalid_coordinates", low=2, high=2, values=(-1e308, 1e308)),
    Rule("textToType", "string", "invalid_text", max_len=500, never=_SCRIPT),
    Rule("selectOptionValue", "string", "invalid_option", max_len=200, never=_SCRIPT),
    Rule("url", "string", "invalid_url", max_len=2000, never=_SCRIPT),
    Rule("targetUrl", "string", "invalid_url", max_len=2000, never=_SCRIPT),
    Rule("createNewTab", "bool", "invalid_flag"),
    Rule("searchQuery", "string", "invalid_search_query", max_len=500, never=_SCRIPT),
    Rule("searchResults", "array", "invalid_search_results"),
    Rule("userApproved", "bool", "invalid_flag"), Rule("pressEnter", "bool", "invalid_flag"),
    Rule("userInputPrompt", "string", "invalid_prompt", max_len=500, never=_NO_LINK),
    Rule("inputKey", "regex", "invalid_input_key", pattern=r"^[a-zA-Z0-9_-]{1,100}\z"),
    Rule("batchActions", "array", "invalid_batch", low=1, high=10, item=ATOMIC),
), checks=(
    *_postcondition(),
    ("missing_target", f"{{kind}} IN {_TARGETED} AND coalesce({_SUB.format('targetLocalId')}, '') = '' AND NOT ({{kind}} = 'click' AND {_get('{v}', 'coordinates')} IS NOT NULL)"),
    ("missing_target", f"{{kind}} = 'drag_and_drop' AND (coalesce({_SUB.format('targetLocalId')}, '') = '' OR coalesce({_SUB.format('destinationLocalId')}, '') = '')"),
    ("missing_file_name", f"{{kind}} = 'upload_file' AND coalesce({_SUB.format('fileName')}, '') = ''"),
    *_NEEDS,
    _says_within("web_search", "missing_query", _SUB.format("searchQuery"), 500),
    ("missing_batch", f"{{kind}} = 'batch' AND {_get('{v}', 'batchActions')} IS NULL"),
))
# Which capability an action needs of its target, where the target lists any; one of them is enough.
NEEDED_CAPABILITY = {"click": ("click",), "type": ("type",), "select": ("select",), "hover": ("hover", "click"), "drag_and_drop": ("drag", "click"), "upload_file": ("upload", "type")}
# ---------------------------------------------------------------------------


def validate_payloads(df: DataFrame, col: str, contract: Contract = REASONING) -> tuple[DataFrame, DataFrame]:
    """V1: ``(valid, rejects + reason)``."""
    tagged = tag_payloads(df, col, contract)
    return tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL")


def tag_payloads(df: DataFrame, col: str, contract: Contract = REASONING) -> DataFrame:
    """Add ``reason``: the first broken rule, NULL for a valid payload."""
    return _judged(df, col, contract, "reason")


def _judged(df: DataFrame, col: str, contract: Contract, out: str) -> DataFrame:
    """Add ``out``, the first broken rule; settled, as a filter on it would otherwise repeat every rule."""
    opened = settled(df.withColumn("_v", F.expr(f"try_parse_json(`{col}`)")), **{f"_{n}": F.expr(sql) for n, sql in _opened("_v").items()})
    return settled(opened.withColumn("_r", F.expr(reason_sql("_v", contract, "_m", "_kind"))), **{out: F.col("_r")}).drop("_v", "_m", "_kind", "_r")


def validate_requests(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """V3."""
    return validate_payloads(df, col, TASK_REQUEST)


def tag_conversations(turns: DataFrame, key: str = "conv_id", max_turns: int = 30, max_chars: int = 4000) -> DataFrame:
    """V2: add ``reason`` to turns: too many turns in the conversation, role, length, script text."""
    sizes = turns.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_turns).select(key, F.lit(True).alias("_long"))
    reason = (F.when(F.col("_long"), F.lit("too_many_turns"))
              .when(~F.coalesce("role", F.lit("")).isin("user", "assistant"), F.lit("invalid_role"))
              .when(F.col("text").isNull(), F.lit("missing_text")).when(F.length("text") > max_chars, F.lit("too_long"))
              .when(has_script(F.col("text")), F.lit("script_pattern")))
    return turns.join(sizes, key, "left").withColumn("reason", reason).drop("_long")


def validate_conversations(turns: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: a conversation with one bad turn is rejected as a whole."""
    tagged = tag_conversations(turns, key)
    bad = tagged.filter("reason IS NOT NULL").select(key).distinct()
    return turns.join(bad, key, "left_anti"), tagged.filter("reason IS NOT NULL")


def tag_actions(actions: DataFrame, elements: DataFrame, col: str = "proposal", key: str = "page_id") -> DataFrame:
    """V4: add ``reason``, NULL for a valid proposal: V1 rules, also for the members of a batch, what each kind needs, and every target and destination must be an element of the same page.

    ``elements(page_id, local_id)``; with ``caps``, a target that lists capabilities has to have one that the kind needs.
    Named elements are looked up one by one, so a page may have any number of them.
    """
    text = lambda p: f"try_variant_get(_v, '$.{p}', 'string')"
    b = S.fresh("b")
    members = f"transform(coalesce(try_variant_get(_v, '$.batchActions', 'array<variant>'), cast(array() as array<variant>)), {b} -> try_variant_get({b}, '$.targetLocalId', 'string'))"
    # By the order in which a proposal is judged: members, target, its capabilities (3), destination.
    named = f"""filter(concat(transform({members}, {b} -> named_struct('rank', 1, 'id', {b})), array(named_struct('rank', 2, 'id', {text('targetLocalId')}), named_struct('rank', 4, 'id', {text('destinationLocalId')}))),
        {b} -> {b}.id IS NOT NULL)"""
    # Equal proposals are parsed and judged once, whatever their pages; rows and proposals meet by the digest.
    rows = actions.withColumn("_d", F.coalesce(F.sha2(F.col(col).cast("string"), 256), F.lit("")))
    texts = actions.select(F.col(col).cast("string").alias("_p")).distinct().withColumn("_d", F.coalesce(F.sha2("_p", 256), F.lit("")))
    said = _judged(texts, "_p", ACTION, "_said").select("_d", "_said")
    names = texts.select("_d", F.expr("try_parse_json(_p)").alias("_v")).select("_d", F.expr(text("kind")).alias("_kind"), F.expr(named).alias("_t"))
    with_caps = "caps" in elements.columns
    known = elements.select(F.col(key).alias("_k"), F.col("local_id").alias("_id"), *(["caps"] if with_caps else [])).groupBy("_k", "_id")
    known = known.agg(F.max("caps").alias("_caps"), F.lit(True).alias("_there")) if with_caps else known.agg(F.first(F.lit(True)).alias("_there")).withColumn("_caps", F.lit(None).cast("array<string>"))
    # The outer form, as the plain one makes Spark ask for the size of ``_t`` on the scan as well.
    asked = rows.select(F.col(key).alias("_k"), "_d").distinct().join(names, "_d").select("_k", "_d", "_kind", F.explode_outer("_t").alias("_t")).where("_t.id IS NOT NULL")
    asked = asked.select("_k", "_d", "_kind", F.col("_t.rank").alias("_rank"), F.col("_t.id").alias("_id"))
    lacks = F.lit(False)
    for kind, needed in NEEDED_CAPABILITY.items():
        lacks = lacks | ((F.col("_kind") == kind) & ~F.arrays_overlap("_caps", F.array(*map(F.lit, needed))))
    wrong = F.when(F.col("_there").isNull(), F.col("_rank")).when((F.col("_rank") == 2) & (F.size("_caps") > 0) & lacks, F.lit(3))
    found = asked.join(known, ["_k", "_id"], "left").groupBy("_k", "_d").agg(F.min(wrong).alias("_wrong")).where("_wrong IS NOT NULL")
    j = rows.join(said, "_d", "left").join(found.withColumnRenamed("_d", "_e"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_d") == F.col("_e")), "left")
    reason = F.coalesce("_said", F.when(F.col("_wrong") == 3, F.lit("missing_capability")).when(F.col("_wrong").isNotNull(), F.lit("unknown_target")))
    return j.withColumn("reason", reason).select(*actions.columns, "reason")


def validate_actions(actions: DataFrame, elements: DataFrame, col: str = "proposal", key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """V4: ``(valid, rejects + reason)``; :func:`tag_actions` gives both in one table."""
    j = tag_actions(actions, elements, col, key)
    return j.filter("reason IS NULL").drop("reason"), j.filter("reason IS NOT NULL")


def action_extras(actions: DataFrame, col: str = "proposal") -> DataFrame:
    """Add ``fallback_strategy`` and ``completion_evidence``: unknown values of these two do not reject a proposal, they are left out."""
    e = S.fresh("e")
    one = f"try_variant_get(_v, '$.completionEvidence', 'string')"  # noqa: F541
    several = "try_variant_get(_v, '$.completionEvidence', 'array<variant>')"
    said = f"CASE WHEN {several} IS NOT NULL THEN transform({several}, {e} -> CASE WHEN {_is_string(e)} THEN {_text(e)} END) ELSE array({one}) END"
    kept = f"filter(transform({said}, {e} -> lower(trim({e}))), {e} -> {e} IN ({S.names(EVIDENCE)}))"
    fallback = "try_variant_get(_v, '$.fallbackStrategy', 'string')"
    return actions.withColumn("_v", F.expr(f"try_parse_json(`{col}`)")).withColumns({
        "fallback_strategy": F.expr(f"CASE WHEN {fallback} IN ({S.names(FALLBACKS)}) THEN {fallback} END"),
        "completion_evidence": F.expr(f"CASE WHEN size({kept}) > 0 THEN {kept} END")}).drop("_v")


# Words that decide the risk of an action.
_BLOCKED = ("password", "otp", "captcha", "cvv", "pin")
_BLOCKED_TYPING = ("payment", "card", "token", "secret", "sensitive", "national id", "aadhaar", "pan", "ssn")
_BLOCKED_BATCH_TYPING = ("payment", "card", "token", "secret")
_PROTECTED = ("submit", "send", "publish", "delete", "remove", "pay", "purchase", "buy", "authorize", "sign", "transfer", "confirm order")
_PROTECTED_BATCH = ("submit", "send", "publish", "delete", "pay")
_PROTECTED_BATCH_WHY = ("submit", "delete", "pay")


def _says(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def risk(actions: DataFrame) -> DataFrame:
    """V5: add ``risk_level`` from ``kind, target_name, user_approved, risk, batch``.

    ``batch`` is ``array<struct<kind,target,rationale>>`` or NULL; a batch is as risky as its worst part.
    """
    b = S.fresh("b")
    target, why = f"lower(coalesce({b}.target, ''))", f"lower(coalesce({b}.rationale, ''))"
    sub_blocked = f"({_says(target, _BLOCKED)} OR ({b}.kind = 'type' AND {_says(target, _BLOCKED_BATCH_TYPING)}))"
    sub_protected = f"({b}.kind = 'upload_file' OR {_says(target, _PROTECTED_BATCH)} OR {_says(why, _PROTECTED_BATCH_WHY)})"
    name = "lower(coalesce(target_name, ''))"
    declared = "CASE WHEN risk IN ('blocked', 'protected') THEN risk ELSE 'safe' END"
    return actions.withColumn("risk_level", F.expr(f"""CASE
        WHEN coalesce(user_approved, false) OR kind = 'request_user_input' THEN 'safe'
        WHEN {_says(name, _BLOCKED)} OR (kind = 'type' AND {_says(name, _BLOCKED_TYPING)}) THEN 'blocked'
        WHEN kind = 'batch' AND size(batch) > 0 THEN
          CASE WHEN exists(batch, {b} -> {sub_blocked}) THEN 'blocked' WHEN exists(batch, {b} -> {sub_protected}) THEN 'protected' ELSE 'safe' END
        WHEN kind = 'upload_file' THEN 'protected'
        WHEN kind = 'hover' THEN 'safe'
        WHEN kind = 'request_user_confirmation' OR {_says(name, _PROTECTED)} THEN 'protected'
        WHEN kind IN ('observe', 'wait', 'scroll', 'select', 'navigate', 'type') THEN 'safe'
        WHEN kind = 'click' THEN {declared}
        ELSE coalesce(risk, 'safe') END"""))


def unknown_keys(df: DataFrame, col: str, allowed, out: str = "unknown") -> DataFrame:
    """Keys of the JSON object that the contract does not list."""
    keys = F.coalesce(F.json_object_keys(F.col(col)), F.array().cast("array<string>"))
    return df.withColumn(out, F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))


def has_duplicates(df: DataFrame, col: str, out: str = "has_duplicates") -> DataFrame:
    """X3 for an array column."""
    return df.withColumn(out, F.size(F.array_distinct(col)) < F.size(col))


def duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """X3 for a table: keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wire_projection(df: DataFrame, contract_columns) -> DataFrame:
    """P5: only contract columns leave; missing ones are not invented."""
    return df.select(*[c for c in contract_columns if c in df.columns])


def display_projection(df: DataFrame, image_cols=("screenshot",)) -> DataFrame:
    """Display form: image bytes are replaced by their size."""
    for c in image_cols:
        if c in df.columns:
            df = b64_bytes(df, c, f"{c}_bytes").drop(c)
    return df


def b64_bytes(df: DataFrame, col: str, out: str = "bytes") -> DataFrame:
    """Decoded size of base64 text (after a data-URL header); at least one byte."""
    data = F.regexp_replace(F.col(col), r"^data:[^,]*,", "")
    padding = F.when(data.endswith("=="), 2).when(data.endswith("="), 1).otherwise(0)
    return df.withColumn(out, F.when(F.length(data) > 0, F.greatest(F.lit(1), F.floor(F.length(data) * 3 / 4) - padding)).otherwise(F.lit(0)))
