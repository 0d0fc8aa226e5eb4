"""Structure from HTML.

Tags with a flat shape (fields, buttons, images, text segments) are read with built-in
regular expressions. Anything that needs nesting works on the node table of
:func:`veil.functions.nodes.parse_nodes`.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.nodes import node_table, page_arrays, parse_nodes, parse_pages
from veil.functions import text_sql as S
from veil.functions.spans import masked, masked_col, match_ranges
from veil.functions.util import (
    all_matches, any_contains, blank_to_null, first_filled, first_match, let, settled, squash_ws, trim_ws,
)

# Tag shapes.
_FIELD = r"(?i)<(input|textarea|select)\s+([^>]*?)/?>"
_BUTTON = r"(?i)<button\s*([^>]*)>([\s\S]*?)</button>"
_IMAGE = r"""(?i)<img\s+((?:"[^"]*"|'[^']*'|[^>])*?)/?>"""
_LABEL = r"(?i)<label\s+([^>]*)>([\s\S]*?)</label>"
_TAG = "<[^>]+>"


def attr(attrs: Column, key: str) -> Column:
    """Attribute value from raw attribute text; NULL when it is not there."""
    return first_match(attrs, rf"(?i){key}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _tags(pages: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    # The outer form: the plain one makes Spark search every page twice (see detect.explode_spans).
    return pages.select(key, F.posexplode_outer(all_matches(F.col("html"), pattern)).alias("pos", "_raw")).filter(
        "pos IS NOT NULL")


def label_map(pages: DataFrame) -> DataFrame:
    """``page_id, for_id, text``; a later label for the same id replaces an earlier one."""
    found = _tags(pages, _LABEL).select(
        "page_id", "pos", attr(F.regexp_extract("_raw", _LABEL, 1), "for").alias("for_id"),
        trim_ws(F.regexp_replace(F.regexp_extract("_raw", _LABEL, 2), _TAG, "")).alias("text"))
    return found.filter("for_id <> ''").groupBy("page_id", "for_id").agg(F.max_by("text", "pos").alias("text"))


def attach_labels(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """Left outer join of fields with the label that names their id."""
    side = labels.select("page_id", F.col("for_id").alias("id"), F.col("text").alias("label_text"))
    return fields.join(side, ["page_id", "id"], "left")


def extract_fields(pages: DataFrame) -> DataFrame:
    """Input, textarea and select tags in document order, one row each."""
    a = F.regexp_extract("_raw", _FIELD, 2)
    tag = F.lower(F.regexp_extract("_raw", _FIELD, 1))
    return _tags(pages, _FIELD).select("page_id", "pos", tag.alias("tag"), a.alias("_a")).select(
        "page_id", "pos", "tag",
        F.lower(first_filled(attr(F.col("_a"), "type"),
                             F.when(F.col("tag") == "input", F.lit("text")).otherwise(F.col("tag")))).alias("type"),
        *[attr(F.col("_a"), k).alias(n) for k, n in (
            ("id", "id"), ("name", "name"), ("autocomplete", "autocomplete"), ("inputmode", "inputmode"),
            ("placeholder", "placeholder"), ("aria-label", "aria_label"), ("value", "value"), ("class", "cls"))])


def extract_buttons(pages: DataFrame) -> DataFrame:
    a = F.regexp_extract("_raw", _BUTTON, 1)
    return _tags(pages, _BUTTON).select("page_id", "pos", a.alias("_a"), trim_ws(F.regexp_replace(
        F.regexp_extract("_raw", _BUTTON, 2), _TAG, "")).alias("text")).select(
        "page_id", "pos", attr(F.col("_a"), "id").alias("id"), attr(F.col("_a"), "aria-label").alias("aria_label"),
        attr(F.col("_a"), "class").alias("cls"), "text")


def extract_surfaces(pages: DataFrame) -> DataFrame:
    """Canvas tags, then iframe tags."""
    found = [_tags(pages, rf"(?i)<{tag}\s*([^>]*)>").select(
        "page_id", F.lit(tag).alias("tag"), "pos",
        attr(F.col("_raw"), "id").alias("id"), attr(F.col("_raw"), "class").alias("cls"))
        for tag in ("canvas", "iframe")]
    return found[0].unionByName(found[1])


def extract_images(pages: DataFrame) -> DataFrame:
    """Image tags; a quoted attribute may contain ``>``."""
    a = F.regexp_extract("_raw", _IMAGE, 1)
    return _tags(pages, _IMAGE).select("page_id", "pos", a.alias("_a")).select(
        "page_id", "pos", attr(F.col("_a"), "id").alias("id"), attr(F.col("_a"), "class").alias("cls"),
        attr(F.col("_a"), "alt").alias("alt"), attr(F.col("_a"), "src").alias("src"))


def text_segments(pages: DataFrame) -> DataFrame:
    """Non-blank text between tags with its offset into the page."""
    found = F.expr(match_ranges("html", r"(?<=>)[^<]+(?=<)"))
    return pages.select("page_id", F.explode_outer(found).alias("_s")).filter(trim_ws(F.col("_s.text")) != "").select(
        "page_id", F.col("_s.start").alias("start"), F.col("_s.text").alias("text"))


def layout_boxes(elements: DataFrame) -> DataFrame:
    """Row-by-row layout: ``row`` counts fields, then buttons, of a page; buttons are narrow."""
    return (elements
            .withColumn("x", F.lit(0.1)).withColumn("y", F.lit(0.12) + F.col("row") * 0.08)
            .withColumn("w", F.when(F.col("tag") == "button", F.lit(0.3)).otherwise(F.lit(0.8)))
            .withColumn("h", F.lit(0.06)))


def page_elements(pages: DataFrame) -> DataFrame:
    """Fields then buttons of every page with label, display name, role and layout box."""
    fields = attach_labels(extract_fields(pages), label_map(pages))
    counts = pages.select("page_id", F.size(all_matches(F.col("html"), _FIELD)).alias("_n"))
    named = fields.withColumn("text", F.lit(None).cast("string")).withColumn("row", F.col("pos"))
    buttons = extract_buttons(pages).join(counts, "page_id").withColumn("row", F.col("_n") + F.col("pos")).drop("_n")
    both = named.unionByName(
        buttons.withColumn("tag", F.lit("button")).withColumn("type", F.lit("button")), allowMissingColumns=True)
    display = F.when(F.col("tag") == "button", first_filled(F.col("text"), F.col("aria_label"), F.col("id"), F.lit("Button"))
                     ).otherwise(first_filled(F.col("placeholder"), F.col("label_text"), F.col("aria_label"),
                                              F.col("name"), F.col("id"), F.concat("tag", F.lit(" field"))))
    return layout_boxes(both.withColumn("display_name", display).withColumn("role", F.col("tag")))


def benchmark_elements(pages: DataFrame) -> DataFrame:
    """The scoring view of a page: inputs, buttons, one canvas, one iframe (H8)."""
    inp = r"(?i)<input\s+([^>]+)>"

    def quoted(key):
        return first_match(F.col("_raw"), rf"(?i){key}=[\"']([^\"']+)[\"']", 1)

    inputs = _tags(pages, inp).select(
        "page_id", F.col("pos").alias("idx"), F.lit("input").alias("role"),
        F.coalesce(quoted("placeholder"), quoted("name"), quoted("id"),
                   F.concat(F.lit("Input "), F.col("pos"))).alias("name"),
        F.lit(0.1).alias("x"), (F.lit(0.15) + F.col("pos") * 0.08).alias("y"), F.lit(0.8).alias("w"),
        F.lit(0.06).alias("h"),
        ((F.lower(F.coalesce(quoted("type"), F.lit("text"))) == "password")
         | F.contains(F.lower(F.coalesce(quoted("name"), F.lit(""))), F.lit("pass"))).alias("is_sensitive"))
    counts = pages.select("page_id", F.size(all_matches(F.col("html"), inp)).alias("_n"))
    buttons = extract_buttons(pages).join(counts, "page_id").select(
        "page_id", (F.col("_n") + F.col("pos")).alias("idx"), F.lit("button").alias("role"),
        first_filled(F.col("text"), F.concat(F.lit("Button "), F.col("_n") + F.col("pos"))).alias("name"),
        F.lit(0.1).alias("x"), (F.lit(0.15) + (F.col("_n") + F.col("pos")) * 0.08).alias("y"),
        F.lit(0.3).alias("w"), F.lit(0.05).alias("h"), F.lit(False).alias("is_sensitive"))

    def surface(tag, name, w, h, order):
        return pages.filter(F.col("html").rlike(rf"(?i)<{tag}\s+")).select(
            "page_id", F.lit(1_000_000 + order).alias("idx"), F.lit(tag).alias("role"), F.lit(name).alias("name"),
            F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"),
            F.lit(True).alias("is_sensitive"))

    return reduce(DataFrame.unionByName, [
        inputs, buttons, surface("canvas", "Canvas Graphic Area", 0.6, 0.3, 0),
        surface("iframe", "External Frame", 0.7, 0.4, 1)])


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def derive_role(elements: DataFrame) -> DataFrame:
    """Role from ``tag, type, role_attr, haspopup, editable, cls``."""
    tag, role, kind = F.lower("tag"), F.lower(_text("role_attr")), F.lower(first_filled(F.col("type"), F.lit("text")))
    return elements.withColumn("role", (
        F.when(tag == "input", F.when(kind == "checkbox", F.lit("checkbox")).when(kind == "radio", F.lit("radio"))
               .when(kind.isin("button", "submit", "reset"), F.lit("button")).otherwise(F.lit("input")))
        .when((tag == "textarea") | (role == "searchbox") | F.coalesce("editable", F.lit(False)), F.lit("textarea"))
        .when((tag == "select") | role.isin("listbox", "combobox") | (F.lower(_text("haspopup")) == "listbox"),
              F.lit("select"))
        .when((tag == "button") | (role == "button"), F.lit("button"))
        .when((tag == "a") | (role == "link"), F.lit("link"))
        .when(role == "tab", F.lit("tab"))
        .when(role.isin("menuitem", "option") | F.contains(_text("cls"), F.lit("MuiListItemButton-root")),
              F.lit("menuitem"))
        .otherwise(F.lit("generic"))))


def derive_caps(elements: DataFrame) -> DataFrame:
    """Capabilities from ``role, tag, type, role_attr, editable, draggable``."""
    tag, kind = F.lower("tag"), F.lower(_text("type"))
    writes = F.col("role").isin("input", "textarea") | tag.isin("input", "textarea") | F.coalesce("editable", F.lit(False))
    typable = writes & ~kind.isin("checkbox", "radio", "button", "submit", "image")
    picks = (F.col("role") == "select") | (tag == "select") | (F.lower(_text("role_attr")) == "combobox")
    drags = F.coalesce("draggable", F.lit(False)) | (F.lower(_text("role_attr")) == "slider")
    return elements.withColumn("caps", F.array_compact(F.array(
        F.lit("click"), F.lit("hover"), F.when(typable, F.lit("type")),
        F.when(writes & (kind == "file"), F.lit("upload")), F.when(picks, F.lit("select")),
        F.when(drags, F.lit("drag")))))


def derive_name(elements: DataFrame) -> DataFrame:
    """Display name: fields and clickable elements each have their own order of preference."""
    def t(name):
        return trim_ws(_text(name))

    kind = F.lower(t("type"))
    as_button = kind.isin("submit", "button", "reset")
    field = first_filled(
        F.when(as_button, first_filled(t("value"), F.when(kind == "submit", F.lit("Submit")))),
        t("label_text"), t("aria_label"), t("placeholder"), t("title"),
        F.when(kind == "search", F.lit("Search")), t("name"), F.col("role"))
    href = F.lower(t("href"))
    known = F.lit(None).cast("string")
    for piece, label in reversed((
            ("/bookmarks", "Bookmarks"), ("/notifications", "Notifications"), ("/messages", "Messages"),
            ("/explore", "Explore"), ("/home", "Home"), ("/lists", "Lists"), ("/settings", "Settings"))):
        known = F.when(F.contains(href, F.lit(piece)), F.lit(label)).otherwise(known)
    file = first_match(href, r"/([^/?#]+\.(?:pdf|zip|csv|kmz|kml|doc|docx|xlsx|tif|geotiff))(?:[?#]|\z)", 1)
    control = first_filled(
        t("text"), t("aria_label"), t("title"), t("alt"), F.when(kind == "submit", F.lit("Submit")), known,
        F.concat(F.lit("Download "), F.regexp_replace(F.coalesce(F.try_url_decode(file), file), "[_-]+", " ")),
        F.col("role"))
    return elements.withColumn(
        "display_name", F.when(F.col("tag").isin("input", "textarea", "select"), field).otherwise(control))


def closest(pred) -> Column:
    """Whether any enclosing element satisfies ``pred``; the element itself is not looked at."""
    return F.exists("anc", pred)


def element_context(nodes: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Interactive nodes with container text, nearest heading, dialog and breadcrumb flags.

    The nearest heading is the first heading inside the closest sectioning element; container and
    heading text are looked up by node id, so only page-keyed equi-joins are needed. They are sorted and merged:
    files of like nodes shrink so much that their size says nothing about the rows, which a broadcast would gather on the driver.
    """
    cuts = cuts or PUBLISHED
    interactive = nodes.filter(F.col("tag").isin("a", "button", "input", "select", "textarea")
                               | F.col("role").isin("button", "link", "tab", "menuitem"))
    boxes = ("tr", "li", "td")

    def is_box(a):
        return (a["tag"].isin(*boxes) | a["role"].isin("row", "article", "gridcell")
                | F.concat(F.lit(" "), a["cls"], F.lit(" ")).contains(" card "))

    dialog = closest(lambda a: (a["tag"] == "dialog") | a["role"].isin("dialog", "alertdialog")
                     | a["cls"].rlike(r"(?:^|\s)(?:modal|dialog)(?:\s|\z)"))
    crumb = closest(lambda a: F.lower(a["cls"]).contains("breadcrumb"))
    base = interactive.select(
        "page_id", "node_id", "tag", F.coalesce("text", F.lit("")).alias("name"), F.try_element_at(
            F.transform(F.filter("anc", is_box), lambda a: a["id"]), F.lit(-1)).alias("_box"),
        F.try_element_at(F.transform(F.filter("anc", lambda a: a["tag"].isin(
            "section", "article", "div", "main")), lambda a: a["id"]), F.lit(-1)).alias("_sec"),
        dialog.alias("in_dialog"), crumb.alias("is_breadcrumb"))
    heads = nodes.filter(F.col("tag").isin("h1", "h2", "h3", "h4") | (F.col("role") == "heading")).select(
        "page_id", "node_id", trim_ws(F.coalesce("text", F.lit(""))).alias("_h"), F.explode("anc").alias("_a"))
    first_head = heads.groupBy("page_id", F.col("_a.id").alias("_sec")).agg(
        F.min_by("_h", "node_id").alias("_h"))
    texts = nodes.select("page_id", F.col("node_id").alias("_box"), F.col("text").alias("_t"))
    joined = base.join(texts.hint("merge"), ["page_id", "_box"], "left").join(first_head.hint("merge"), ["page_id", "_sec"], "left")
    context = _head(squash_ws(F.replace(F.coalesce("_t", F.lit("")), F.when(
        F.col("name") == "", F.lit("\u0000")).otherwise(F.col("name")), F.lit(""))), cuts.context_chars)
    return joined.select(
        "page_id", "node_id", "tag", "name",
        first_filled(context, F.when(F.col("is_breadcrumb"), F.lit("breadcrumb"))).alias("container"),
        F.when((F.col("_h") != "") & _below(F.col("_h"), cuts.heading_below), F.col("_h")).alias("heading"),
        "in_dialog", "is_breadcrumb")


# --- records -----------------------------------------------------------------

def clean_cell(text: Column) -> Column:
    return squash_ws(F.coalesce(text, F.lit("")))


@dataclass(frozen=True)
class Cuts:
    """How much of a page a summary takes. These are the published numbers; None switches a cut off (``ALL`` has none).

    ``*_chars`` cut a text, ``*_below`` leave out texts of that length or more, the others are counts.
    """

    context_chars: int | None = 180
    heading_below: int | None = 80
    counter_below: int | None = 100
    counter_chars: int | None = 60
    counters: int | None = 20
    spec_heading_below: int | None = 120
    columns: int | None = 6
    spec_rows: int | None = 8
    key_below: int | None = 50
    value_below: int | None = 150
    list_pairs: int | None = 6
    list_chars: int | None = 120
    posts: int | None = 8
    author_chars: int | None = 100
    post_chars: int | None = 320
    comment_chars: int | None = 180
    status_chars: int | None = 150
    dialog_chars: int | None = 100
    summary_lines: int | None = 45


PUBLISHED = Cuts()
ALL = Cuts(*[None] * len(fields(Cuts)))


def _head(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _below(text: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else F.length(text) < most


def _within(count: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else count <= most


def extract_tables(pages: DataFrame, schema: dict | None = None, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, row, record``: the table with most rows (at least two), one map per body row."""
    nodes = node_table(pages, text_tags=("th", "td", "a"), keep_tags=("table", "tr", "th", "td", "a")) if nodes is None else nodes
    table_id = F.try_element_at(F.transform(F.filter("anc", lambda a: a["tag"] == "table"), lambda a: a["id"]), F.lit(-1))
    outer_tables = F.transform(F.filter("anc", lambda a: a["tag"] == "table"), lambda a: a["id"])
    rows = nodes.filter("tag = 'tr'").select(
        "page_id", "node_id", F.exists("anc", lambda a: a["tag"] == "tbody").alias("_in_body"),
        F.exists("anc", lambda a: a["tag"] == "thead").alias("_in_head"), F.explode(outer_tables).alias("table_id"))
    best = rows.groupBy("page_id", "table_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("_in_body").alias("_has_body"), F.max("_in_head").alias("_has_head"),
        F.min("node_id").alias("_first_row"), F.min(F.when(F.col("_in_head"), F.col("node_id"))).alias("_first_head"))
    top = best.withColumn("_r", F.row_number().over(
        Window.partitionBy("page_id").orderBy(F.desc("n"), "table_id"))).filter("_r = 1 AND n >= 2").select(
        "page_id", "table_id", "_has_body", F.coalesce("_first_head", "_first_row").alias("_head_row"))
    row_id = F.try_element_at(F.transform(F.filter("anc", lambda a: a["tag"] == "tr"), lambda a: a["id"]), F.lit(-1))
    cells = nodes.filter("tag IN ('td', 'th')").select(
        "page_id", "node_id", "tag", row_id.alias("row_id"), table_id.alias("table_id"),
        clean_cell(F.col("text")).alias("text"), F.exists("anc", lambda a: a["tag"] == "tbody").alias("_in_body"),
    ).join(top, ["page_id", "table_id"])
    by_cell = Window.partitionBy("page_id", "row_id", "tag").orderBy("node_id")
    cells = cells.withColumn("idx", F.row_number().over(by_cell) - 1)
    head = cells.filter("row_id = _head_row")
    ths = head.groupBy("page_id").agg(F.max(F.col("tag") == "th").alias("_use_th"))
    headers = head.join(ths, "page_id").filter((F.col("tag") == "th") == F.col("_use_th")).select(
        "page_id", "idx", first_filled(F.col("text"), F.concat(F.lit("column_"), F.col("idx") + 1)).alias("header"))
    links = nodes.filter("tag = 'a'").filter(blank_to_null(F.col("attrs")["href"]).isNotNull()).select(
        "page_id", F.col("node_id").alias("_l"), F.col("attrs")["href"].alias("href"), F.try_element_at(F.transform(
            F.filter("anc", lambda a: a["tag"].isin("td", "th")), lambda a: a["id"]), F.lit(-1)).alias("node_id")
    ).groupBy("page_id", "node_id").agg(F.min_by("href", "_l").alias("href"))
    body = cells.filter("tag = 'td' AND (_in_body OR NOT _has_body)").join(headers, ["page_id", "idx"], "left").join(
        links, ["page_id", "node_id"], "left")
    column = F.coalesce("header", F.concat(F.lit("column_"), F.col("idx") + 1))
    value = masked_col("text")
    body = body.select("page_id", "row_id", "idx", column.alias("k"), value.alias("v"), "href")
    body = body.withColumn("v", F.when(F.col("href").isNull(), coerce_value(F.col("k"), F.col("v"), schema))
                           .otherwise(F.col("v")))
    entries = F.array_sort(F.collect_list(F.struct("idx", "k", "v", "href")))
    records = body.groupBy("page_id", "row_id").agg(entries.alias("_e"))
    pairs = F.flatten(F.transform("_e", lambda e: F.when(e["href"].isNull(), F.array(
        F.struct(e["k"].alias("key"), e["v"].alias("value")))).otherwise(F.array(
            F.struct(e["k"].alias("key"), e["v"].alias("value")),
            F.struct(F.concat(e["k"], F.lit("_url")).alias("key"), e["href"].alias("value"))))))
    records = records.withColumn("record", last_wins(pairs))
    numbered = F.row_number().over(Window.partitionBy("page_id").orderBy("row_id"))
    return records.withColumn("row", numbered).filter(_within(F.col("row"), limit)).select("page_id", "row", "record")


def last_wins(pairs: Column) -> Column:
    """``array<struct<key,value>>`` -> map; a repeated key keeps its first place and its last value."""
    keys = F.transform(pairs, lambda p: p["key"])
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"))))


def coerce_value(key: Column, value: Column, schema: dict | None) -> Column:
    """Columns declared ``number`` become their number when they have one."""
    numeric = [k for k, kind in (schema or {}).items() if kind == "number"]
    if not numeric:
        return value
    digits = F.regexp_replace(value, "[^0-9.-]", "")
    number = F.regexp_extract(digits, r"^-?(?:\d+\.?\d*|\.\d+)", 0)
    return F.when(key.isin(*numeric) & (number != ""), number).otherwise(value)


_PRICE = r"(?i)(?:[$€£₹]|USD|INR|EUR)\s*\d+(?:[.,]\d+)?"


def _has_class(c: Column, *names: str) -> Column:
    return c.rlike(r"(?:^|\s)(?:" + "|".join(names) + r")(?:\s|\z)")


def _first_class(cls: Column) -> Column:
    return first_filled(F.regexp_extract(trim_ws(cls), r"^\S+", 0), F.lit("none"))


def _is_loose(tag: Column, cls: Column, role: Column) -> Column:
    """What counts as a repeated item where no list holds the repetition."""
    return (tag == "article") | role.isin("article", "listitem") | _has_class(cls, "card", "item")


def _card_ids(nodes: Column) -> Column:
    """Ids of a page's cards: the members of its largest group of like siblings, else its loose items where there are two.

    Ties go to the earlier parent, then the earlier group. The children of lists are sorted by group, and one pass counts the runs.
    """
    def in_list(n):
        up = F.get(nodes, n["parent_id"])
        holds = (up["tag"].isin("ul", "ol", "main", "section") | up["role"].isin("list", "feed")
                 | _has_class(up["cls"], "results", "grid", "list"))
        return (n["parent_id"] >= 0) & holds & ~n["tag"].isin("script", "style", "noscript", "template")

    kids = F.array_sort(F.transform(F.filter(nodes, in_list), lambda n: F.struct(
        n["parent_id"].alias("parent_id"), n["tag"].alias("tag"), _first_class(n["cls"]).alias("cls"), n["node_id"].alias("node_id"))))
    none = F.lit(None).cast("struct<n:int,parent_id:int,first:int,tag:string,cls:string>")

    def step(a, k):
        same = F.coalesce((a["run"]["parent_id"] == k["parent_id"]) & (a["run"]["tag"] == k["tag"]) & (a["run"]["cls"] == k["cls"]), F.lit(False))
        run = F.struct(F.when(same, a["run"]["n"] - 1).otherwise(F.lit(-1)).alias("n"), k["parent_id"].alias("parent_id"),
                       F.when(same, a["run"]["first"]).otherwise(k["node_id"]).alias("first"), k["tag"].alias("tag"), k["cls"].alias("cls"))
        return let(run, lambda r: F.struct(r.alias("run"), F.when((r["n"] <= -2) & (a["best"].isNull() | (r < a["best"])), r).otherwise(a["best"]).alias("best")))

    best = F.aggregate(kids, F.struct(none.alias("run"), none.alias("best")), step, lambda a: a["best"])
    members = lambda g: F.filter(nodes, lambda n: (n["parent_id"] == g["parent_id"]) & (n["tag"] == g["tag"]) & (_first_class(n["cls"]) == g["cls"]))
    loose = F.filter(nodes, lambda n: _is_loose(n["tag"], n["cls"], n["role"]))
    ids = lambda found: F.transform(found, lambda n: n["node_id"])
    return let(best, lambda g: F.when(g.isNotNull(), ids(members(g))).otherwise(
        let(loose, lambda found: F.when(F.size(found) >= 2, ids(found)))))


def _inside(nodes: Column, of: Column) -> Column:
    """What an element holds, in document order."""
    return F.slice(nodes, of["node_id"] + 2, of["last_id"] - of["node_id"])


def extract_cards(pages: DataFrame, schema: dict | None = None, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, row, record``: title, url, description, tag and price of each repeated card."""
    trees = parse_pages(pages) if nodes is None else page_arrays(nodes)
    # The outer form and a filter: see detect.explode_spans.
    cards = trees.select("page_id", "nodes", F.posexplode_outer(_card_ids(F.col("nodes"))).alias("pos", "card_id")).filter(
        F.col("card_id").isNotNull() & _within(F.col("pos"), None if limit is None else limit - 1))
    card = F.get("nodes", F.col("card_id"))
    cards = cards.select("page_id", (F.col("pos") + 1).alias("pos"), card.alias("_card"), _inside(F.col("nodes"), card).alias("_in"))

    def first(cond, value):
        hit = F.get(F.filter("_in", lambda n: F.coalesce(cond(n), F.lit(False))), F.lit(0))
        return let(hit, value)

    def text(n):
        return F.when(n.isNotNull(), F.coalesce(n["text"], F.lit("")))

    about = [F.col("_card.tag").alias("_tag"), F.coalesce("_card.text", F.lit("")).alias("_all"),
             F.col("_card.attrs")["href"].alias("_own_href")]
    if schema:
        return _schema_cards(cards, schema, about, first, text)
    is_title = lambda n: (n["tag"].isin("h1", "h2", "h3", "h4", "h5", "h6", "strong", "b") | (n["role"] == "heading")
                          | _has_class(n["cls"], "title"))
    is_link = lambda n: (n["tag"] == "a") & blank_to_null(n["attrs"]["href"]).isNotNull()
    is_desc = lambda n: (n["tag"] == "p") | _has_class(n["cls"], "description", "summary", "snippet", "desc")
    is_badge = lambda n: _has_class(n["cls"], "badge", "tag", "label", "category") | (
        (n["tag"] == "span") & any_contains(n["cls"], ("badge", "tag")))
    link = first(is_link, lambda n: F.struct(n["attrs"]["href"].alias("href"), text(n).alias("text")))
    full = cards.select("page_id", "pos", *about, first(is_title, text).alias("_title"), link.alias("_link"),
                        first(is_desc, text).alias("_desc"), first(is_badge, text).alias("_badge"))
    full = full.withColumns({"_href": F.col("_link.href"), "_link_text": F.col("_link.text")})
    own_link = (F.col("_tag") == "a") & blank_to_null(F.col("_own_href")).isNotNull()
    full = full.select(
        "page_id", F.col("pos").alias("row"),
        F.when(own_link, F.col("_own_href")).otherwise(F.col("_href")).alias("url"),
        clean_cell(F.coalesce("_title", F.when(own_link, F.col("_all")).otherwise(F.col("_link_text")))).alias("_t"),
        (F.col("_title").isNotNull() | own_link | blank_to_null(F.col("_link_text")).isNotNull()).alias("_has_t"),
        clean_cell(F.col("_desc")).alias("_d"), F.col("_desc").isNotNull().alias("_has_d"),
        clean_cell(F.col("_badge")).alias("_b"), F.col("_badge").isNotNull().alias("_has_b"),
        trim_ws(first_match(F.coalesce("_all", F.lit("")), _PRICE)).alias("price"),
        clean_cell(F.col("_all")).alias("_c"))
    nothing = ~F.col("_has_t") & F.col("url").isNull() & ~F.col("_has_d") & ~F.col("_has_b") & F.col("price").isNull()
    # All text fields of a card go through one copy of the personal-data rules; the whole text only where it is shown.
    v = S.fresh()
    full = full.withColumn("_c", F.when(nothing, F.col("_c")))
    texts = settled(full, _m=F.expr(f"transform(array(_t, _d, _b, _c), {v} -> {masked(v)})"))
    for i, name in enumerate(("_t", "_d", "_b", "_c")):
        texts = texts.withColumn(name, F.col("_m")[i])
    pairs = F.filter(F.array(
        F.struct(F.lit("title").alias("key"), F.when(F.col("_has_t"), F.col("_t")).alias("value")),
        F.struct(F.lit("url").alias("key"), F.col("url").alias("value")),
        F.struct(F.lit("description").alias("key"), F.when(F.col("_has_d"), F.col("_d")).alias("value")),
        F.struct(F.lit("tag").alias("key"), F.when(F.col("_has_b"), F.col("_b")).alias("value")),
        F.struct(F.lit("price").alias("key"), F.col("price").alias("value")),
        F.struct(F.lit("content").alias("key"), F.when(nothing, blank_to_null(F.col("_c"))).alias("value")),
    ), lambda p: p["value"].isNotNull())
    return texts.select("page_id", "row", F.map_from_entries(pairs).alias("record")).filter(F.size("record") > 0)


def _schema_cards(cards: DataFrame, schema: dict, about: list[Column], first, text) -> DataFrame:
    """One declared field at a time, from the first matching element of the card."""
    wanted = []
    for i, (field, kind) in enumerate(schema.items()):
        norm = "".join(c for c in field.lower() if c.isalnum())
        if kind == "link":
            got = first(lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull(), lambda n: n["attrs"]["href"])
        elif kind == "image":
            got = first(lambda n: n["tag"] == "img", lambda n: n["attrs"]["src"])
        else:
            got = first(lambda n, f=field, c=norm: (_has_class(n["cls"], c, f) | (n["attrs"]["data-field"] == f) | (n["attrs"]["itemprop"] == f)), text)
        wanted.append(got.alias(f"_f{i}"))
    found = cards.select("page_id", "pos", *about, *wanted)
    pairs = []
    for i, (field, kind) in enumerate(schema.items()):
        name = f"_f{i}"
        if kind == "link":
            value = F.coalesce(F.when(F.col("_tag") == "a", F.col("_own_href")), F.col(name), F.lit(""))
        elif kind == "image":
            value = F.coalesce(name, F.lit(""))
        else:
            found = found.withColumn(name, clean_cell(F.coalesce(name, "_all")))
            found = settled(found, **{f"_m{i}": masked_col(name)})
            value = F.col(f"_m{i}")
            if kind == "number":
                value = F.coalesce(first_match(value, r"\d+(?:\.\d+)?"), F.lit("0"))
        pairs.append(F.struct(F.lit(field).alias("key"), value.alias("value")))
    return found.select("page_id", F.col("pos").alias("row"), F.map_from_entries(F.array(*pairs)).alias("record"))


def schema_fields(cards: DataFrame, schema: dict) -> DataFrame:
    """Typed columns out of card records."""
    types = {"number": "double"}
    return cards.select("page_id", "row", *[
        F.expr(f"try_cast(record['{f}'] as {types[k]})").alias(f) if k in types else F.col("record")[f].alias(f)
        for f, k in schema.items()])


def extract_kv(pages: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, row, record``: each ``dl`` as a map of term to description."""
    nodes = parse_nodes(pages, text_tags=("dt", "dd"), keep_tags=("dl", "dt", "dd")) if nodes is None else nodes
    lists = F.transform(F.filter("anc", lambda a: a["tag"] == "dl"), lambda a: a["id"])
    items = nodes.filter("tag IN ('dt', 'dd')").select(
        "page_id", "node_id", "tag", clean_cell(F.col("text")).alias("text"), F.explode(lists).alias("dl"))
    items = items.withColumn("i", F.row_number().over(
        Window.partitionBy("page_id", "dl", "tag").orderBy("node_id")))
    pairs = items.groupBy("page_id", "dl", "i").agg(
        F.max(F.when(F.col("tag") == "dt", F.col("text"))).alias("k"),
        F.max(F.when(F.col("tag") == "dd", F.col("text"))).alias("v")).filter("k <> '' AND v <> ''")
    pairs = pairs.withColumn("v", masked_col("v"))
    out = pairs.groupBy("page_id", "dl").agg(F.array_sort(F.collect_list(F.struct("i", "k", "v"))).alias("_e"))
    record = last_wins(F.transform("_e", lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))
    return out.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("dl")).alias("row"),
                      record.alias("record"))


def extract_sections(pages: DataFrame, limit: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``page_id, section, detail``: headings with the paragraph that directly follows."""
    tags = ("h1", "h2", "h3", "h4")
    nodes = parse_nodes(pages, text_tags=(*tags, "p")) if nodes is None else nodes
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    sib = nodes.select(
        "page_id", "node_id", "parent_id", "tag", "text", F.lead("tag").over(w).alias("_nt"),
        F.lead("text").over(w).alias("_np")).filter(F.col("tag").isin(*tags))
    sib = sib.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))).filter(
        _within(F.col("pos"), limit))
    out = sib.select("page_id", "pos", clean_cell(F.col("text")).alias("section"), F.when(
        F.col("_nt") == "p", clean_cell(F.col("_np"))).otherwise(F.lit("")).alias("detail")).filter("section <> ''")
    return out.withColumn("section", masked_col("section")).withColumn("detail", masked_col("detail"))


def extract_records(pages: DataFrame, schema: dict | None = None, limit: int | None = None) -> DataFrame:
    """``page_id, strategy, row, record``: tables, else cards, else key/values, else sections."""
    nodes = node_table(pages)
    sections = extract_sections(pages, limit, nodes).select("page_id", F.col("pos").alias("row"), F.create_map(
        F.lit("section"), F.col("section"), F.lit("detail"), F.col("detail")).alias("record"))
    tiers = [("table", extract_tables(pages, schema, limit, nodes)), ("cards", extract_cards(pages, schema, limit, nodes)),
             ("generic", extract_kv(pages, nodes)), ("section", sections)]
    both = reduce(DataFrame.unionByName, [
        df.select("page_id", F.lit(i).alias("_tier"), F.lit(n).alias("strategy"), "row", "record")
        for i, (n, df) in enumerate(tiers)])
    best = F.min("_tier").over(Window.partitionBy("page_id"))
    return both.withColumn("_best", best).filter("_tier = _best").drop("_tier", "_best")


def record_keys(records: DataFrame) -> DataFrame:
    """Union of record keys per page, first seen first."""
    keyed = records.select("page_id", "row", F.posexplode(F.map_keys("record")).alias("i", "key"))
    first = keyed.groupBy("page_id", "key").agg(F.min(F.struct("row", "i")).alias("at"))
    return first.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))),
                                                    lambda x: x["key"]).alias("keys"))


def to_markdown(records: DataFrame) -> DataFrame:
    """One markdown table per page."""
    def cell(v):
        return trim_ws(F.regexp_replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " "))

    def bar(cells):
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    # At most a hundred records per page, so a page's rows fit one array.
    rows = records.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", F.map_entries("record").alias("e")))),
                    lambda x: F.map_from_entries(x["e"])).alias("_r"))
    keyed = rows.withColumn("keys", F.array_distinct(F.flatten(F.transform("_r", lambda r: F.map_keys(r)))))
    lines = F.transform("_r", lambda r: bar(F.transform("keys", lambda k: cell(F.try_element_at(r, k)))))
    return keyed.select("page_id", F.concat_ws(
        "\n", bar(F.col("keys")), bar(F.transform("keys", lambda _: F.lit("---"))),
        F.array_join(lines, "\n")).alias("markdown"))


def concat_pages(records: DataFrame, key: str, n: int) -> DataFrame:
    """Records of a page chain, one per id or title, up to ``n`` per chain.

    ``records(chain_id, page_no, row, record)``.
    """
    ident = F.coalesce(F.try_element_at("record", F.lit(key)), F.try_element_at("record", F.lit("title")))
    firsts = records.withColumn("_id", ident).groupBy(
        "chain_id", F.coalesce("_id", F.concat_ws("/", F.lit("\u0000"), "page_no", "row")).alias("_id")).agg(
        F.min_by("record", F.struct("page_no", "row")).alias("record"),
        F.min(F.struct("page_no", "row")).alias("_at"))
    return firsts.withColumn("pos", F.row_number().over(Window.partitionBy("chain_id").orderBy("_at"))).filter(
        F.col("pos") <= n).select("chain_id", "pos", "record")


def links(pages: DataFrame) -> DataFrame:
    """Anchors with href, in page order, straight from the page text."""
    a = r"(?i)<a\s+([^>]*)>([\s\S]*?)</a>"
    return _tags(pages, a).select(
        "page_id", "pos", attr(F.regexp_extract("_raw", a, 1), "href").alias("href"),
        attr(F.regexp_extract("_raw", a, 1), "aria-label").alias("aria_label"),
        squash_ws(F.regexp_replace(F.regexp_extract("_raw", a, 2), _TAG, "")).alias("text")).filter("href IS NOT NULL")


def next_page(pages: DataFrame) -> DataFrame:
    """``page_id, href, text``: rel=next, else an aria label, else link text that says so."""
    nodes = node_table(pages, text_tags=("a", "button"), keep_tags=("a", "link", "button"))
    rel = F.concat(F.lit(" "), F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), F.lit(" "))
    aria = F.coalesce(F.col("attrs")["aria-label"], F.lit(""))
    text, href = trim_ws(F.coalesce("text", F.lit(""))), F.coalesce(F.col("attrs")["href"], F.lit(""))
    says = text.rlike(r"(?i)^(?:next(?:\s*(?:page|>|»|→))?|load\s*more|older(?:\s*posts)?)\z")
    way = (F.when(F.col("tag").isin("a", "link") & rel.contains(" next ") & (href != ""), F.lit(1))
           .when(F.col("tag").isin("a", "button") & F.lower(aria).contains("next"), F.lit(2))
           .when(F.col("tag").isin("a", "button") & says, F.lit(3)))
    shown = F.when(way == 2, first_filled(aria, text, F.lit("Next"))).otherwise(first_filled(text, F.lit("Next")))
    found = nodes.select("page_id", "node_id", way.alias("way"), href.alias("href"), shown.alias("text")).filter(
        "way IS NOT NULL")
    return found.groupBy("page_id").agg(F.min_by(F.struct("href", "text"), F.struct("way", "node_id")).alias("_b")
                                        ).select("page_id", "_b.href", "_b.text")


# --- page summaries ------------------------------------------------------------

_HEADS = ("h1", "h2", "h3", "h4")


def counters(pages: DataFrame, nodes: DataFrame | None = None, cuts: Cuts = PUBLISHED) -> DataFrame:
    """``page_id, pos, label, value`` of short texts with a number."""
    nodes = parse_nodes(pages) if nodes is None else nodes
    low = F.col("cls")
    marked = _has_class(low, "counter", "count") | any_contains(low, ("stat", "metric", "badge")) | F.col(
        "attrs")["data-count"].isNotNull()
    text = squash_ws(F.coalesce("text", F.lit("")))
    number = first_match(text, r"(?<![A-Za-z0-9_])\d(?:[\d,.]*\d)?(?![A-Za-z0-9_])")
    found = nodes.filter(marked).select("page_id", "node_id", text.alias("t"), number.alias("value")).filter(
        (F.col("value").isNotNull()) & _below(F.col("t"), cuts.counter_below))
    label = _head(first_filled(F.trim(F.regexp_replace(F.col("t"), F.concat(
        F.lit("^(.*?)"), F.lit("\\Q"), F.col("value"), F.lit("\\E")), "$1")), F.lit("Counter")), cuts.counter_chars)
    return found.withColumn("pos", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id"))).filter(
        _within(F.col("pos"), cuts.counters)).select("page_id", "pos", label.alias("label"), "value")


def page_specs(pages: DataFrame, nodes: DataFrame | None = None, cuts: Cuts = PUBLISHED) -> DataFrame:
    """Headings, table shapes, two-column rows and ``dl`` pairs as ``page_id, node_id, kind, key, value``."""
    nodes = node_table(pages, text_tags=(*_HEADS, "th", "td", "dt", "dd")) if nodes is None else nodes
    text = squash_ws(F.coalesce("text", F.lit("")))
    heads = nodes.filter(F.col("tag").isin(*_HEADS)).select(
        "page_id", "node_id", F.lit("heading").alias("kind"), F.lit(None).cast("string").alias("key"),
        text.alias("value")).filter((F.length("value") > 2) & _below(F.col("value"), cuts.spec_heading_below))
    of_table = F.transform(F.filter("anc", lambda a: a["tag"] == "table"), lambda a: a["id"])
    rows = nodes.filter("tag = 'tr'").select("page_id", "node_id", F.explode(of_table).alias("tbl"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "tbl").orderBy("node_id")))
    ths = nodes.filter("tag = 'th'").select("page_id", "node_id", trim_ws(F.coalesce("text", F.lit(""))).alias("t"),
                                            F.explode(of_table).alias("tbl")).filter("t <> ''")
    cols = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "t"))), lambda x: x["t"])
    names = ths.groupBy("page_id", "tbl").agg((cols if cuts.columns is None else F.slice(cols, 1, cuts.columns)).alias("cols"))
    order = nodes.filter("tag = 'table'").select("page_id", F.col("node_id").alias("tbl"), F.row_number().over(
        Window.partitionBy("page_id").orderBy("node_id")).alias("k"))
    shape = order.join(rows.groupBy("page_id", "tbl").agg(F.count(F.lit(1)).alias("n")), ["page_id", "tbl"], "left"
                       ).join(names, ["page_id", "tbl"], "left").select(
        "page_id", F.col("tbl").alias("node_id"), F.lit("table").alias("kind"), F.col("k").cast("string").alias("key"),
        F.concat(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)), F.lit(" records; columns: ["),
                 F.array_join(F.coalesce("cols", F.array().cast("array<string>")), ", "), F.lit("]")).alias("value"))
    of_row = F.try_element_at(F.transform(F.filter("anc", lambda a: a["tag"] == "tr"), lambda a: a["id"]), F.lit(-1))
    cells = nodes.filter("tag IN ('th', 'td')").select("page_id", "node_id", of_row.alias("row_id"), text.alias("t"))
    pairs = cells.groupBy("page_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "t"))).alias("c"))
    two = pairs.filter(F.size("c") == 2).join(rows.filter(_within(F.col("r"), cuts.spec_rows)).select(
        "page_id", F.col("node_id").alias("row_id"), "tbl"), ["page_id", "row_id"]).select(
        "page_id", F.col("row_id").alias("node_id"), F.lit("spec").alias("kind"),
        F.col("c")[0]["t"].alias("key"), F.col("c")[1]["t"].alias("value")).filter(
        (F.length("key") > 1) & _below(F.col("key"), cuts.key_below) & (F.col("value") != "") & _below(F.col("value"), cuts.value_below))
    of_dl = F.transform(F.filter("anc", lambda a: a["tag"] == "dl"), lambda a: a["id"])
    items = nodes.filter("tag IN ('dt', 'dd')").select("page_id", "node_id", "tag", text.alias("t"),
                                                       F.explode(of_dl).alias("dl"))
    items = items.withColumn("i", F.row_number().over(
        Window.partitionBy("page_id", "dl", "tag").orderBy("node_id"))).filter(_within(F.col("i"), cuts.list_pairs))
    dls = items.groupBy("page_id", "dl", "i").agg(
        F.max(F.when(F.col("tag") == "dt", F.col("node_id"))).alias("node_id"),
        F.max(F.when(F.col("tag") == "dt", F.col("t"))).alias("key"),
        _head(F.max(F.when(F.col("tag") == "dd", F.col("t"))), cuts.list_chars).alias("value")).filter(
        (F.col("key") != "") & (F.col("value") != "") & _below(F.col("key"), cuts.key_below)).select(
        "page_id", "node_id", F.lit("spec").alias("kind"), "key", "value")
    return reduce(DataFrame.unionByName, [heads, shape, two, dls])


def document_links(pages: DataFrame) -> DataFrame:
    """Links to downloadable files."""
    file = F.split_part(F.element_at(F.split("href", "/"), -1), F.lit("?"), F.lit(1))
    return links(pages).filter(F.col("href").rlike(r"(?i)\.(?:pdf|zip|csv|kmz)\z")).select(
        "page_id", "pos", first_filled(F.col("text"), F.col("aria_label"), file).alias("text"), file.alias("file"))


def posts(pages: DataFrame, nodes: DataFrame | None = None, cuts: Cuts = PUBLISHED) -> DataFrame:
    """Posts with a body and comments, with author and body."""
    trees = parse_pages(pages) if nodes is None else page_arrays(nodes)

    def is_post(n):
        return (n["tag"] == "article") | (n["role"] == "article")

    def is_comment(n):
        return _has_class(n["cls"], "comment", "comment-body") | (n["tag"] == "ytd-comment-thread-renderer")

    def testid(n):
        return F.coalesce(n["attrs"]["data-testid"], F.lit(""))

    def author(n):
        return ((testid(n) == "User-Name") | (n["attrs"]["rel"] == "author") | _has_class(n["cls"], "author")
                | F.lower(n["cls"]).contains("author-name"))

    def comment_author(n):
        return author(n) | F.lower(n["cls"]).contains("author") | F.lower(n["cls"]).contains("user")

    def post_body(n):
        return testid(n).isin("tweetText", "post-text") | _has_class(n["cls"], "post-content", "post-body") | (n["attrs"]["itemprop"] == "articleBody")

    def comment_body(n):
        return _has_class(n["cls"], "comment-text") | F.lower(n["cls"]).contains("content") | (n["tag"] == "p")

    def first(inner, cond):
        hit = F.get(F.filter(inner, lambda n: F.coalesce(cond(n), F.lit(False))), F.lit(0))
        return let(hit, lambda n: F.when(n.isNotNull(), squash_ws(F.coalesce(n["text"], F.lit("")))))

    def found(kind, holder, who, what, most, chars):
        def shape(h):
            def name(inner):
                said = F.coalesce(first(inner, who), F.lit(""))
                return _head(F.replace(said, F.lit(":"), F.lit(" ")), cuts.author_chars) if kind == "post" else said
            return let(_inside(F.col("nodes"), h), lambda inner: F.struct(
                h["node_id"].alias("node_id"), F.lit(kind).alias("kind"), name(inner).alias("author"), _head(first(inner, what), chars).alias("body")))
        told = F.filter(F.transform(F.filter("nodes", holder), shape), lambda x: x["body"] != "")
        kept = told if most is None else F.slice(told, 1, most)
        return F.transform(kept, lambda x, i: F.struct(x["node_id"].alias("node_id"), x["kind"].alias("kind"), x["author"].alias("author"), x["body"].alias("body"), (i + 1).alias("pos")))

    # What is a comment is no post.
    told = F.concat(found("post", lambda n: F.coalesce(is_post(n) & ~is_comment(n), F.lit(False)), author, post_body, cuts.posts, cuts.post_chars),
                    found("comment", lambda n: F.coalesce(is_comment(n), F.lit(False)), comment_author, comment_body, None, cuts.comment_chars))
    return trees.select("page_id", F.explode_outer(told).alias("_t")).filter("_t IS NOT NULL").select("page_id", "_t.*")


def status_lines(pages: DataFrame, nodes: DataFrame | None = None, cuts: Cuts = PUBLISHED) -> DataFrame:
    """Status, alert and badge texts, dialog titles."""
    nodes = node_table(pages) if nodes is None else nodes
    text = trim_ws(F.coalesce("text", F.lit("")))
    status = nodes.filter(F.col("role").isin("status", "alert") | _has_class(F.col("cls"), "badge")).select(
        "page_id", "node_id", F.lit("status").alias("kind"), _head(text, cuts.status_chars).alias("text"))
    low = F.lower("cls")
    is_dialog = ((F.col("tag") == "dialog") | (F.col("role") == "dialog") | (F.col("attrs")["aria-modal"] == "true")
                 | low.contains("drawer"))
    dialogs = nodes.filter(F.coalesce(is_dialog, F.lit(False)) & ~_has_class(F.col("cls"), "hidden"))
    titles = nodes.filter(F.col("tag").isin(*_HEADS) | low.contains("title")).select(
        "page_id", F.col("node_id").alias("_n"), text.alias("_t"), F.explode(
            F.transform("anc", lambda a: a["id"])).alias("node_id"))
    head = titles.groupBy("page_id", "node_id").agg(F.min_by("_t", "_n").alias("_t"))
    named = dialogs.join(head, ["page_id", "node_id"], "left").select(
        "page_id", "node_id", F.lit("dialog").alias("kind"),
        _head(first_filled(F.col("attrs")["aria-label"], F.col("_t")), cuts.dialog_chars).alias("text"))
    return status.unionByName(named).filter("text <> ''")


def page_summary(pages: DataFrame, cuts: Cuts = PUBLISHED) -> DataFrame:
    """Summary lines per page in emission order."""
    nodes = node_table(pages)
    specs = page_specs(pages, nodes, cuts)
    order = F.when(F.col("kind") == "heading", 1).when(F.col("kind") == "table", 2).otherwise(3)
    line = (F.when(F.col("kind") == "heading", F.concat(F.lit("Heading: "), F.col("value")))
            .when(F.col("kind") == "table", F.concat(F.lit("Table "), F.col("key"), F.lit(": "), F.col("value")))
            .otherwise(F.concat(F.lit("Spec: "), F.col("key"), F.lit(": "), F.col("value"))))
    a = specs.select("page_id", order.alias("o"), F.col("node_id").alias("p"), line.alias("line"))
    said = posts(pages, nodes, cuts)
    by = F.when(F.col("author") != "", F.concat(F.lit(" by "), F.col("author"))).otherwise(F.lit(""))
    b = said.select("page_id", F.when(F.col("kind") == "post", 0).otherwise(5).alias("o"), F.col("pos").alias("p"), F.when(
        F.col("kind") == "post", F.concat(F.lit("Visible post "), F.col("pos"), by, F.lit(": "), F.col("body"))
    ).otherwise(F.concat(F.lit("Comment: "), F.when(F.col("author") != "", F.concat(F.col("author"), F.lit(": "))).otherwise(
        F.lit("")), F.lit('"'), F.col("body"), F.lit('"'))).alias("line"))
    c = document_links(pages).select("page_id", F.lit(4).alias("o"), F.col("pos").alias("p"), F.concat(
        F.lit('Document: "'), F.col("text"), F.lit('" ('), F.col("file"), F.lit(")")).alias("line"))
    every = a.unionByName(b).unionByName(c)
    ranked = every.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("o", "p", "line"))).filter(
        _within(F.col("r"), cuts.summary_lines))
    return ranked.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))),
                                                     lambda x: x["line"]).alias("lines"))


def extract_metrics(pages: DataFrame, rules: list[dict], text: str = "text") -> DataFrame:
    """``page_id, metric_id, value``: the number that belongs to a label keyword.

    ``rules`` is a short catalog: ``metric_id``, ``keywords``, ``pattern``. For each occurrence of a
    keyword, in keyword then text order: a value after ``:``/``=``; the last value ending at most five
    characters before; a value at most fifteen characters after; any value in the window. Without a
    keyword hit, the first value with a keyword within 25 characters.
    """
    found = [F.struct(F.lit(r["metric_id"]).alias("metric_id"), _metric(r, text).alias("value")) for r in rules]
    return pages.select("page_id", F.explode(F.array(*found)).alias("_m")).select(
        "page_id", "_m.metric_id", "_m.value").filter("value IS NOT NULL")


def _metric(rule: dict, text: str) -> Column:
    pattern, t = rule["pattern"], F.col(text)
    lowered = [k.lower() for k in rule["keywords"]]

    def near(keyword):
        spots = F.expr(match_ranges(f"lower(`{text}`)", "\\Q" + keyword + "\\E"))
        n = len(keyword)

        def value(s):
            at = s["start"]
            before = F.substring(t, F.greatest(at - 25, F.lit(0)) + 1, F.least(at, F.lit(25)))
            after = F.substring(t, at + n + 1, F.lit(45))
            direct = blank_to_null(F.regexp_extract(after, r"^[\s:=]+([0-9][0-9,.]*[kKmMbB]?)", 1))
            tail = blank_to_null(F.regexp_extract(before, rf"(?:^|(?<![0-9,.]))({pattern})[^0-9]{{0,5}}\z", 1))
            close = blank_to_null(F.regexp_extract(after, rf"^[^0-9]{{0,15}}({pattern})", 1))
            anywhere = first_match(F.concat(before, F.substring(t, at + 1, F.lit(n)), after), pattern)
            return F.coalesce(direct, tail, close, anywhere)

        return F.get(F.filter(F.transform(spots, value), lambda v: v.isNotNull()), F.lit(0))

    any_keyword = "|".join("\\Q" + k + "\\E" for k in lowered)
    hits = F.expr(match_ranges(f"`{text}`", pattern))

    def labelled(m):
        begin = F.greatest(m["start"] - 25, F.lit(0))
        return F.lower(F.substring(t, begin + 1, m["end"] + 25 - begin)).rlike(any_keyword)

    return F.coalesce(*[near(k) for k in lowered], F.get(F.filter(hits, labelled), F.lit(0))["text"])


def classify_images(images: DataFrame) -> DataFrame:
    """Avatar and public-post flags from attribute hints; navigation icons drop out.

    Optional flag columns: ``in_navigation``, ``public_post``, ``account_shell``.
    """
    def flag(name):
        return F.coalesce(F.col(name), F.lit(False)) if name in images.columns else F.lit(False)

    def low(name):
        return F.lower(_text(name)) if name in images.columns else F.lit("")

    cls, alt, aria, src, tid = low("cls"), low("alt"), low("aria_label"), low("src"), low("testid")
    nav_icon = flag("in_navigation") & aria.isin("profile", "account", "user", "home", "bookmarks")
    # Hints that an image shows a person's profile.
    avatar = (
        any_contains(cls, ("avatar", "user-pic", "user-img", "user-photo", "author-img", "gravatar"))
        | any_contains(tid, ("avatar", "profile-pic"))
        | any_contains(alt, ("avatar", "user photo"))
        | (alt.contains("profile") & ~alt.contains("profile link") & ~alt.contains("view profile"))
        | (aria.contains("avatar") & ~flag("in_navigation"))
        | any_contains(src, ("profile_images", "avatar", "gravatar.com", "avatars.githubusercontent", "googleusercontent.com")))
    public = flag("public_post")
    return images.filter(~nav_icon).withColumn(
        "is_avatar", flag("account_shell") | (~public & avatar & ~flag("in_navigation"))).withColumn(
        "is_public", public & ~flag("account_shell"))


_AD = (
    r"\b(?:google_ad|googlesyndication|doubleclick|adnxs|adservice|ad-slot|adsystem|ads-|aswift|taboola|outbrain"
    r"|criteo|pubmatic|rubicon|adform|advertisement|banner-ad)\b|google_ads_iframe|godaddy")


def surface_status(nodes: DataFrame) -> DataFrame:
    """Surface rows with type, inspection status and reason; ad frames drop out.

    Columns used: ``tag, cls, html_id, type_attr, src, title, name, width, height`` and the flags
    ``is_map, is_public, is_signature, is_webgl, public_media, closed_shadow, same_origin, sensitive_text``.
    """
    def flag(name):
        return F.coalesce(F.col(name), F.lit(False)) if name in nodes.columns else F.lit(False)

    def low(name):
        return F.lower(_text(name)) if name in nodes.columns else F.lit("")

    def row(kind, status, reason):
        return F.struct(F.lit(kind).alias("surface_type"), F.lit(status).alias("status"), F.lit(reason).alias("reason"))

    small = (F.col("width") <= 60) & (F.col("height") <= 60)
    harmless = (flag("is_map") | flag("is_public") | flag("public_media") | small) & ~flag("is_signature")
    canvas = F.when(harmless, F.struct(
        F.lit("canvas").alias("surface_type"), F.lit("inspected_same_origin").alias("status"),
        F.when(flag("is_map"), F.lit("functional_geospatial_map")).when(flag("is_public"), F.lit("public_post_canvas"))
        .when(small, F.lit("decorative_ui_canvas")).otherwise(F.lit("public_media_canvas")).alias("reason"))
    ).when(flag("is_webgl"), row("webgl_canvas", "uninspectable_canvas", "webgl_hardware_canvas")).otherwise(
        row("canvas", "uninspectable_canvas", "uninspected_2d_canvas"))
    pdf = low("type_attr").contains("pdf") | low("src").endswith(".pdf")
    text_image = flag("sensitive_text") | any_contains(low("cls"), (
        "receipt", "invoice", "statement", "credit-card", "id-card", "passport", "national-id", "scanned-doc")) | any_contains(
        low("alt"), ("scanned document", "sensitive document"))
    marks = F.concat_ws(" ", low("html_id"), low("name"), low("title"), low("cls"), low("src"))
    tag = F.lower("tag")
    surface = (
        F.when(flag("closed_shadow"), row("shadow_root", "uninspectable_closed_shadow", "closed_shadow_root_inaccessible"))
        .when(tag == "canvas", canvas)
        .when(tag == "video", F.when(flag("public_media"), row("video", "inspected_same_origin", "public_media_stream"))
              .otherwise(row("video", "uninspectable_media", "video_media_stream")))
        .when(tag.isin("embed", "object", "applet"), F.when(pdf, row("pdf", "uninspectable_plugin", "embedded_pdf_document"))
              .otherwise(row("plugin", "uninspectable_plugin", "browser_plugin_content")))
        .when((tag == "img") & text_image & ~flag("is_public"),
              row("image_text", "uninspectable_image_text", "image_text_candidate"))
        .when((tag == "iframe") & flag("same_origin"), row("iframe", "inspected_same_origin", "same_origin_frame_inspected"))
        .when((tag == "iframe") & ~marks.rlike(_AD),
              row("iframe", "uninspectable_cross_origin", "cross_origin_or_inaccessible_iframe")))
    return nodes.withColumn("_s", surface).filter("_s IS NOT NULL AND width > 0 AND height > 0").select(
        *nodes.columns, "_s.surface_type", "_s.status", "_s.reason")
