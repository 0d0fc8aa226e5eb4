"""Cleaning of text, URLs, nested payloads, headers and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veil.functions import text_sql as S
from veil.functions.rules import WS
from veil.functions.urls import clean_url, clean_url_col, clean_urls_in_text, free_text, free_text_col
from veil.functions.util import any_contains, trim_ws


def sanitize_urls(df: DataFrame, col: str, out: str = "url_clean") -> DataFrame:
    return df.withColumn(out, clean_url_col(f"`{col}`"))


def sanitize_embedded_urls(df: DataFrame, col: str, out: str = "text_clean") -> DataFrame:
    return df.withColumn(out, F.expr(clean_urls_in_text(f"`{col}`")))


def scrub_free_text(df: DataFrame, col: str, out: str = "text_clean") -> DataFrame:
    return df.withColumn(out, free_text_col(f"`{col}`"))


def scrub_conversations(turns: DataFrame, col: str = "text") -> DataFrame:
    """Each turn scrubbed in place; turn order is a column, so nothing is shuffled."""
    return turns.withColumn(col, free_text_col(f"coalesce(`{col}`, '')"))


def scrub_nested(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Scrub leaves of a nested column in place.

    ``paths`` maps a dotted path to ``'url'`` or ``'text'``; arrays on the way are mapped over.
    Fields the data does not have are skipped, so one path list serves many payload versions.
    """
    for path, kind in paths.items():
        root, *rest = path.split(".")
        if root not in df.columns:
            continue
        sql = _rewrite(f"`{root}`", df.schema[root].dataType, rest, kind)
        if sql is not None:
            df = df.withColumn(root, F.expr(sql))
    return df


def _rewrite(value: str, dtype: T.DataType, rest: list[str], kind: str) -> str | None:
    if isinstance(dtype, T.ArrayType):
        v = S.fresh("e")
        inner = _rewrite(v, dtype.elementType, rest, kind)
        return inner and f"transform({value}, {v} -> {inner})"
    if not rest:
        if not isinstance(dtype, T.StringType):
            return None
        cleaned = clean_url(value) if kind == "url" else free_text(value)
        return f"CASE WHEN {value} IS NULL OR {value} = '' THEN {value} ELSE {cleaned} END"
    if not isinstance(dtype, T.StructType) or rest[0] not in dtype.names:
        return None
    inner = _rewrite(f"{value}.`{rest[0]}`", dtype[rest[0]].dataType, rest[1:], kind)
    if inner is None:
        return None
    fields = ", ".join(
        f"'{f.name}', {inner if f.name == rest[0] else f'{value}.`{f.name}`'}" for f in dtype.fields)
    return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"


# The outbound payload contract's text and URL leaves.
PAYLOAD_PATHS = {
    "goal": "text", "elements.sanitizedName": "text",
    "pageState.title": "text", "pageState.pageTitle": "text", "pageState.url": "url",
    "pageState.canonicalUrl": "url", "pageState.postconditionSummary": "text", "pageState.dialogTitles": "text",
    "pageState.statusSummaries": "text", "pageState.contentSummaries": "text",
    "pageState.stateDelta.previousUrl": "url", "pageState.stateDelta.currentUrl": "url",
    "pageState.stateDelta.observedOutcome": "text", "pageState.stateDelta.dialogOpened": "text",
    "pageState.stateDelta.previousAction.targetName": "text",
    "pageState.stateDelta.previousAction.textToType": "text",
    "pageState.stateDelta.previousAction.expectedState": "text",
    "history.content": "text", "customPrompt": "text", "executionFeedback.completedTasks": "text",
    "executionFeedback.remainingTasks": "text", "executionFeedback.outcomeCode": "text",
    "observedOutcome": "text", "recentActionHistory.observedOutcome": "text",
    "searchResults.url": "url", "searchResults.title": "text", "searchResults.content": "text",
    "taskSpecification.goal": "text", "taskSpecification.contextUrl": "url",
    "taskSpecification.tasksToDo": "text", "taskSpecification.tasksNotToDo": "text",
    "taskSpecification.successCriteria": "text", "taskSpecification.subAgentTasks.targetEntityOrUrl": "url",
    "taskSpecification.subAgentTasks.goal": "text", "currentObjective.description": "text",
    "currentObjective.targetPhrase": "text", "currentObjective.extractedValue": "text",
    "objectiveProgress.evidence.summary": "text", "previousAction.targetName": "text",
}

# Header names that carry credentials.
SECRET_HEADERS = ("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization")


def redact_headers(df: DataFrame, map_col: str, out: str | None = None) -> DataFrame:
    """``map<string,string>`` or ``map<string,array<string>>`` -> ``map<string,string>`` without credentials."""
    multi = isinstance(df.schema[map_col].dataType.valueType, T.ArrayType)

    def value(k, v):
        shown = F.array_join(v, ", ") if multi else v
        return F.when(F.lower(k).isin(*SECRET_HEADERS), F.lit("[REDACTED_HEADER]")).otherwise(
            F.coalesce(shown, F.lit("")))

    return df.withColumn(out or map_col, F.transform_values(map_col, value))


# Error classes, first match wins; a class needs all of its word groups.
FAILURE_CLASSES = (
    ("SANITIZER_TIMEOUT", (("timeout", "timed out", "15000ms"),)),
    ("SCREENSHOT_DECODE_FAILED", (("decode", "bitmap", "invalid raw screenshot"),)),
    ("CANVAS_UNAVAILABLE", (("canvas",), ("context", "unavailable"))),
    ("MASK_RENDER_FAILED", (("render",), ("mask",))),
    ("MASK_VERIFICATION_FAILED", (("verification", "verifier", "post-redaction", "sanitization blocked"),)),
    ("DIGEST_FAILED", (("digest", "sha256", "crypto"),)),
    ("OFFSCREEN_UNAVAILABLE", (("offscreen",), ("unavailable", "failed", "created", "document"))),
)


def normalize_errors(logs: DataFrame, col: str) -> DataFrame:
    """Add ``detail`` (blobs, URLs and hashes as tokens, at most 120 characters) and ``failure_class``."""
    raw = F.coalesce(F.col(col), F.lit(""))
    out = F.regexp_replace(raw, r"data:image/[a-zA-Z0-9+.-]+;base64,[a-zA-Z0-9+/=]+", "[IMAGE_DATA]")
    out = F.regexp_replace(out, rf"https?://(?:(?!{WS})[^\"'<>])+", "[URL]")
    out = F.regexp_replace(out, r"(?i)[a-f0-9]{32,}", "[HASH]")
    short = F.when(F.length("_d") > 120, F.concat(F.substring("_d", 1, 117), F.lit("..."))).otherwise(F.col("_d"))
    low = F.lower(raw)
    failure = F.lit("UNKNOWN_SANITIZER_FAILURE")
    for name, groups in reversed(FAILURE_CLASSES):
        hit = reduce(lambda a, b: a & b, [any_contains(low, g) for g in groups])
        failure = F.when(hit, F.lit(name)).otherwise(failure)
    return logs.withColumn("_d", out).withColumn(
        "detail", F.when(raw == "", F.lit("Unknown error")).otherwise(trim_ws(short))
    ).withColumn("failure_class", failure).drop("_d")


# Text that could run, and how it is spelled afterwards.
NEUTRAL_FORMS = (
    (r"(?i)https?://", "https //"), (r"(?i)ftp://", "ftp //"), (r"(?i)file://", "file //"),
    (r"(?i)wss?://", "ws //"), (r"(?i)blob:", "blob "), (r"(?i)data:", "data "),
    (r"(?i)<script(?![A-Za-z0-9_])", "[script"), (r"(?i)javascript:", "javascript "),
    (r"(?i)vbscript:", "vbscript "), (r"(?i)data:text/html", "data text/html"),
    (rf"(?i)(?<![A-Za-z0-9_])on[A-Za-z0-9_]+{WS}*=", "evt="),
    (rf"(?i)(?<![A-Za-z0-9_])eval{WS}*\(", "eval "),
    (rf"(?i)(?<![A-Za-z0-9_])expression{WS}*\(", "expression "),
)


def neutralize_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    text = F.coalesce(F.col(col), F.lit(""))
    for pattern, by in NEUTRAL_FORMS:
        text = F.regexp_replace(text, pattern, by)
    return df.withColumn(out or col, text)


# Patterns that mark a string as script-bearing or as an address.
SCRIPT_PATTERNS = (
    r"(?i)<script(?![A-Za-z0-9_])", r"(?i)javascript:", r"(?i)vbscript:", r"(?i)data:text/html",
    r"(?i)(?<![A-Za-z0-9_])on(?:load|error|click|mouse[A-Za-z0-9_]+|key[A-Za-z0-9_]+|focus|blur|change|submit|reset"
    r"|select|contextmenu|drag[A-Za-z0-9_]*|drop|wheel|scroll|touch[A-Za-z0-9_]*|animation[A-Za-z0-9_]*"
    rf"|transition[A-Za-z0-9_]*){WS}*=",
    rf"(?i)(?<![A-Za-z0-9_])eval{WS}*\(", rf"(?i)(?<![A-Za-z0-9_])expression{WS}*\(",
)


def has_script(col):
    return F.coalesce(reduce(lambda a, b: a | b, [col.rlike(p) for p in SCRIPT_PATTERNS]), F.lit(False))


def script_flag(df: DataFrame, col: str, out: str = "has_script") -> DataFrame:
    return df.withColumn(out, has_script(F.col(col)))


def normalize_domain(df: DataFrame, col: str, out: str = "domain") -> DataFrame:
    """Host without scheme, port and ``www.``; broken input falls back to its first path piece."""
    low = F.lower(trim_ws(F.coalesce(F.col(col), F.lit(""))))
    full = F.when(low.rlike("^https?://"), low).otherwise(F.concat(F.lit("https://"), low))
    host = F.try_parse_url(full, F.lit("HOST"))
    fallback = F.split_part(F.split_part(low, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    return df.withColumn(out, F.when(low == "", F.lit("")).otherwise(
        F.regexp_replace(F.coalesce(host, fallback), r"^www\.", "")))


# Label classes by words in a cleaned element name, first match wins.
MASK_LABELS = (
    ("password", r"password"), ("auth_code", r"otp|\bauth(?:_code)?\b"), ("payment", r"payment|card|cvv"),
    ("national_id", r"national id|aadhaar"), ("email", r"email"), ("phone", r"phone"),
    ("address", r"address|location|pincode"), ("token", r"token|key"), ("high_risk_surface", r"sensitive"),
)


def mask_breakdown(elements: DataFrame, manifests: DataFrame) -> DataFrame:
    """``page_id, label, n``: a page's manifest counts when it has any, else counts by label.

    ``elements(page_id, sanitized_name, role)``; ``manifests(page_id, total_masks, by_category map)``.
    Masks the labels do not explain are faces.
    """
    name = F.lower(F.coalesce("sanitized_name", F.lit("")))
    label = F.when(F.col("role").isin("canvas", "iframe"), F.lit("high_risk_surface"))
    for value, pattern in reversed(MASK_LABELS):
        label = F.when(name.rlike(pattern), F.lit(value)).otherwise(label)
    counted = elements.withColumn("label", label).filter("label IS NOT NULL").groupBy("page_id", "label").agg(
        F.count(F.lit(1)).alias("n"))
    positive = F.map_filter("by_category", lambda k, v: v > 0)
    listed = manifests.select("page_id", "total_masks", positive.alias("_m"))
    given = listed.filter(F.coalesce(F.size("_m"), F.lit(0)) > 0).select(
        "page_id", F.explode("_m").alias("label", "n")).select("page_id", "label", F.col("n").cast("long"))
    without = listed.filter(F.coalesce(F.size("_m"), F.lit(0)) <= 0).select("page_id", "total_masks")
    inferred = counted.join(listed.filter(F.size("_m") > 0).select("page_id"), "page_id", "left_anti")
    explained = inferred.groupBy("page_id").agg(F.sum("n").alias("_known"))
    faces = without.join(explained, "page_id", "left").select(
        "page_id", F.lit("face").alias("label"),
        (F.col("total_masks") - F.coalesce("_known", F.lit(0))).cast("long").alias("n")).filter("n > 0")
    return given.unionByName(inferred).unionByName(faces)


# Path words and hosts of private, mixed and public places.
_PRIVATE_PATH = (
    r"/(?:direct|inbox|messages?|messaging|conversations?|chat|mail|compose|banking|netbanking|payroll|hrms|myaccount"
    r"|statements|checkout)(?:[/?#]|\z)")
_PRIVATE_HOSTS = (
    r"mail\.google\.com|outlook\.(?:live|office|office365)\.com|mail\.yahoo\.com|mail\.proton\.me|mail\.zoho\.com"
    r"|web\.whatsapp\.com|app\.slack\.com|discord\.com/channels|teams\.microsoft\.com|web\.telegram\.org"
    r"|messenger\.com|threads\.net/messages|netbanking|banking|hdfcbank\.com|icicibank\.com|onlinesbi\.sbi"
    r"|chase\.com|bankofamerica\.com|wellsfargo\.com|paypal\.com/(?:myaccount|signin)|incometax\.gov\.in"
    r"|workday\.com|myworkday|darwinbox|keka\.com|greenhouse\.io|bamboohr\.com|mychart|patientportal"
    r"|practo\.com/consult")
_HYBRID_HOSTS = (
    r"youtube\.com|youtu\.be|x\.com|twitter\.com|linkedin\.com|github\.com|gitlab\.com|reddit\.com|instagram\.com"
    r"|facebook\.com|amazon\.[a-z.]+|flipkart\.com|myntra\.com|ebay\.[a-z.]+")


def zone_of(url):
    low = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(low.rlike(_PRIVATE_PATH) | low.rlike(_PRIVATE_HOSTS), F.lit("private_workspace"))
        .when(low.rlike(_HYBRID_HOSTS), F.lit("hybrid"))
        .otherwise(F.lit("public_broadcast"))
    )


def page_zone(df: DataFrame, url_col: str, out: str = "zone") -> DataFrame:
    return df.withColumn(out, zone_of(F.col(url_col)))


def restricted_reason(url):
    """Why a page agent must not touch this page; NULL when it may."""
    low = F.lower(trim_ws(url))
    # Privileged schemes and their reasons.
    return (
        F.when(low.startswith("chrome://"), F.lit("Chrome internal settings/management surface (chrome://)"))
        .when(low.startswith("chrome-extension://"), F.lit("Extension internal origin (chrome-extension://)"))
        .when(low.rlike("^(?:edge://|about:|devtools://|view-source:)"),
              F.lit("Privileged browser internal origin"))
        .when(low.startswith("file://"),
              F.lit("Local file scheme URL without explicit verified permission"))
    )


def gate_urls(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """``(passed, blocked + reason)``; internal, extension and local-file pages are blocked."""
    flagged = df.withColumn("reason", restricted_reason(F.col(col)))
    return flagged.filter("reason IS NULL").drop("reason"), flagged.filter("reason IS NOT NULL")


def _any_ancestor(pred):
    return F.exists("anc", pred)


# Hosts and class names of maps, players, feeds and account controls.
_MAP_HOSTS = ("bhuvan", "nrsc.gov.in", "isro.gov.in", "mosdac.gov.in", "vedas.sac.gov.in", "bhoonidhi")
_MAP_CLASSES = ("ol-layer", "ol-unselectable", "leaflet", "mapboxgl", "maplibregl", "cesium", "esri-view", "gm-style")
_MAP_BOXES = ("ol-viewport", "leaflet-container", "mapboxgl-map", "maplibregl-map", "cesium-viewer", "esri-view", "gm-style",
              "map-container")
_VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "dailymotion.com")
_PLAYER_CLASSES = ("video-stream", "html5-main-video", "vjs-tech", "jw-video")
_MESSAGE_PATH = r"/(?:direct|inbox|messages?|messaging|conversations?|chat)(?:[/?#]|\z)"
_MESSAGE_BOXES = ("conversation", "message-list", "chat-list", "msg-thread", "direct-inbox")
_FEED_CLASSES = r"(?:^|\s)(?:comment-body|comment|TimelineItem|repo-list|feed)(?:\s|\z)"
_FEED_TAGS = ("article", "aside", "ytd-comment-thread-renderer", "ytd-rich-item-renderer", "ytd-rich-grid-media",
              "ytd-rich-grid-row", "ytd-video-renderer", "ytd-compact-video-renderer", "ytd-grid-video-renderer", "ytd-thumbnail",
              "ytd-channel-name", "shreddit-post", "shreddit-comment")
_SOCIAL_HOSTS = ("x.com", "twitter.com", "instagram.com", "reddit.com", "linkedin.com", "threads.net")


def context_flags(elements: DataFrame) -> DataFrame:
    """Add ``is_map, is_messaging, is_account, is_public_post, is_public_media``.

    ``elements(url, tag, cls, html_id, attrs map, anc array<struct<id,tag,cls,role,html_id>>)``, as the node table has them.
    """
    url, cls, hid = F.lower(F.coalesce("url", F.lit(""))), F.lower(F.coalesce("cls", F.lit(""))), F.lower(F.coalesce("html_id", F.lit("")))
    a = lambda k: F.lower(F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit("")))
    has = lambda k: F.map_contains_key("attrs", k)
    is_map = (any_contains(url, _MAP_HOSTS) | any_contains(cls, _MAP_CLASSES) | hid.contains("map") | hid.contains("bhuvan")
              | _any_ancestor(lambda x: any_contains(F.lower(x["cls"]), _MAP_BOXES) | x["html_id"].isin("map", "map_canvas")
                              | F.lower(x["html_id"]).contains("bhuvan")))
    messaging = url.rlike(_MESSAGE_PATH) | any_contains(cls, _MESSAGE_BOXES) | _any_ancestor(
        lambda x: any_contains(F.lower(x["cls"]), _MESSAGE_BOXES)) | any_contains(a("aria-label"), (
            "direct", "messages", "chats", "thread", "inbox")) | any_contains(a("data-testid"), ("conversation", "message", "chat", "direct"))
    aria, tid, title = a("aria-label"), a("data-testid"), a("title")
    in_header = _any_ancestor(lambda x: (x["tag"] == "header") | (x["role"] == "banner"))
    specific = (any_contains(aria, ("account", "profile", "avatar", "user")) | any_contains(title, ("account", "profile"))
                | any_contains(tid, ("profile", "user")) | any_contains(cls, ("user-profile", "account-btn")))
    account = (any_contains(aria, ("google account", "account menu", "switch account", "sign out")) | tid.contains("accountswitcher")
               | (tid == "user-menu") | (hid == "avatar-btn") | _any_ancestor(
                   lambda x: (x["html_id"] == "avatar-btn") | F.lower(x["cls"]).contains("accountswitcher"))
               | (in_header & has("aria-haspopup") & specific))
    in_main = _any_ancestor(lambda x: x["tag"].isin("article", "main", "section") | x["role"].isin("article", "main", "feed"))
    social = any_contains(url, _SOCIAL_HOSTS) & ~any_contains(url, ("/messages", "/messaging", "/direct"))
    feed = F.col("tag").isin(*_FEED_TAGS) | F.col("cls").rlike(_FEED_CLASSES) | _any_ancestor(
        lambda x: x["tag"].isin(*_FEED_TAGS) | x["cls"].rlike(_FEED_CLASSES) | x["role"].isin("article", "feed")
        | x["html_id"].isin("related", "contents", "items"))
    staged = elements.withColumn("is_map", is_map).withColumn("is_messaging", messaging).withColumn("is_account", account)
    post = (~F.col("is_account") & (zone_of(F.col("url")) != "private_workspace") & ~F.col("is_messaging")
            & (any_contains(url, _VIDEO_HOSTS[:4]) | (social & in_main) | feed))
    src = a("src")
    media_src = src.rlike("^(?:https?://|blob:)")
    player = any_contains(cls, _PLAYER_CLASSES)
    media = (F.col("tag") == "video") & ~a("data-live-camera").isin("true", "1") & (
        ((has("controls") | has("poster") | (F.coalesce(F.expr("try_cast(attrs['duration'] as double)"), F.lit(0.0)) > 0) | player) & media_src)
        | (any_contains(url, _VIDEO_HOSTS) & (media_src | player)))
    return staged.withColumn("is_public_post", post).withColumn("is_public_media", media)
