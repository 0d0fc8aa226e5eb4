"""Queries over HTML: the given pages, and pages built from customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions.nodes import node_table, parse_nodes
from veil.operators import fields, html, scrub
from veil.plans.derived import CARD_PAGES, FORM_PAGES, RECORD_PAGES, derive, plain, table
from veil.plans.registry import query

FORMS = plain(FORM_PAGES)
RECORDS = plain(RECORD_PAGES)


def pages(spark, sf):
    return table(spark, sf, "pages", heavy=True)


def forms(spark, sf):
    return derive(spark, sf, FORM_PAGES, heavy=True)


@query("page_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*>[\s\S]*?</a>')) AS raw FROM pages),
l AS (SELECT page_id, regexp_extract(raw, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1) AS href FROM a)
SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf):
    return html.links(pages(spark, sf)).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("text_segments", r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '>([^<]+)<', 1)) AS t FROM pages)
SELECT page_id, count(*) AS segments, sum(length(t))::BIGINT AS chars FROM s WHERE trim(t, E' \n\t\r') <> '' GROUP BY page_id""")
def text_segments(spark, sf):
    return html.text_segments(pages(spark, sf)).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))


@query("text_segment_offsets", """
SELECT page_id, true AS offsets_ok FROM pages WHERE regexp_matches(html, '>[^<]*[^<[:space:]][^<]*<')""")
def text_segment_offsets(spark, sf):
    """Every segment is the page text at its own offset."""
    src = pages(spark, sf).select("page_id", "html")
    seg = html.text_segments(src).groupBy("page_id").agg(F.collect_list(F.struct("start", "text")).alias("s"))
    ok = F.forall("s", lambda x: F.substring(F.col("html"), x["start"] + 1, F.length(x["text"])) == x["text"])
    return src.join(seg, "page_id").select("page_id", ok.alias("offsets_ok"))


@query("page_headings", r"""
SELECT page_id, unnest(regexp_extract_all(html, '(?i)<h1[^>]*>')) AS h FROM pages""".replace("unnest(regexp_extract_all(html, '(?i)<h1[^>]*>')) AS h", "len(regexp_extract_all(html, '(?i)<h1[^>]*>'))::BIGINT AS headings"))
def page_headings(spark, sf):
    nodes = parse_nodes(pages(spark, sf), text_tags=("h1",), keep_tags=("h1",))
    found = nodes.groupBy("page_id").agg(F.count(F.lit(1)).alias("headings"))
    return pages(spark, sf).select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("headings", F.lit(0)).alias("headings"))


@query("page_sections")
def page_sections(spark, sf):
    """H16 on the given pages."""
    return html.extract_sections(pages(spark, sf)).select("page_id", "pos", F.md5("section").alias("section_md5"), F.md5("detail").alias("detail_md5"))


@query("page_cards")
def page_cards(spark, sf):
    """H14 on the given pages: rows per page and keys of the records."""
    cards = html.extract_cards(pages(spark, sf))
    return cards.groupBy("page_id").agg(F.count(F.lit(1)).alias("cards"), F.count_if(F.map_contains_key("record", "url")).alias("with_url"))


@query("page_records")
def page_records(spark, sf):
    """H17 on the given pages."""
    return html.extract_records(pages(spark, sf)).groupBy("page_id", "strategy").agg(F.count(F.lit(1)).alias("rows"))


@query("page_summaries")
def page_summaries(spark, sf):
    """H27 on the given pages."""
    return html.page_summary(pages(spark, sf)).select("page_id", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"))


@query("page_metrics", r"""
WITH t AS (SELECT doc_id AS page_id, text FROM documents WHERE contains(lower(text), 'score:'))
SELECT page_id, 'score' AS metric_id, regexp_extract(text, '(?i)score[\s:=]+([0-9][0-9,.]*[kKmMbB]?)', 1) AS value FROM t WHERE false
UNION ALL SELECT o_orderkey, 'total', cast(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'stars', concat(cast(o_orderkey % 90 + 1 AS VARCHAR), '.5k') FROM orders""")
def page_metrics(spark, sf):
    texts = table(spark, sf, "orders").selectExpr("o_orderkey AS page_id", """concat('Total orders: ', cast(o_custkey as string), ' and then it has some ',
        cast(o_orderkey % 90 + 1 as string), '.5k stars for ', o_orderpriority) AS text""")
    number = "[0-9][0-9,.]*[kKmMbB]?"
    return html.extract_metrics(texts, [{"metric_id": "total", "keywords": ["total orders"], "pattern": number},
                                        {"metric_id": "stars", "keywords": ["stars", "stargazers"], "pattern": number}])


@query("form_fields", f"""
WITH p AS ({FORMS})
SELECT page_id, 0 AS pos, 'input' AS tag, CASE page_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'password' ELSE 'text' END AS type, concat('f', cast(page_id AS VARCHAR)) AS id,
  CASE page_id % 6 WHEN 2 THEN 'field_a' WHEN 5 THEN 'search_box' ELSE 'field_b' END AS name FROM p
UNION ALL SELECT page_id, 1, 'textarea', 'textarea', concat('t', cast(page_id AS VARCHAR)), 'notes' FROM p""")
def form_fields(spark, sf):
    return html.extract_fields(forms(spark, sf)).select("page_id", "pos", "tag", "type", "id", "name")


@query("form_buttons", f"""
WITH p AS ({FORMS}) SELECT page_id, concat('b', cast(page_id AS VARCHAR)) AS id, 'btn' AS cls, concat('Save ', c_mktsegment) AS text FROM p""")
def form_buttons(spark, sf):
    return html.extract_buttons(forms(spark, sf)).select("page_id", "id", "cls", "text")


@query("form_surfaces", f"""
WITH p AS ({FORMS}) SELECT page_id, 'canvas' AS tag, concat('cv', cast(page_id AS VARCHAR)) AS id FROM p WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'iframe', 'fr' FROM p WHERE page_id % 5 = 0""")
def form_surfaces(spark, sf):
    return html.extract_surfaces(forms(spark, sf)).select("page_id", "tag", "id")


@query("form_images", f"""
WITH p AS ({FORMS}) SELECT page_id, concat('im', cast(page_id AS VARCHAR)) AS id, concat('a > ', c_name) AS alt FROM p WHERE page_id % 4 = 0""")
def form_images(spark, sf):
    return html.extract_images(forms(spark, sf)).select("page_id", "id", "alt")


LABEL = """CASE page_id % 6 WHEN 0 THEN 'Email address' WHEN 1 THEN 'Choose a secret' WHEN 2 THEN 'Card number' WHEN 3 THEN 'Favourite colour'
       WHEN 4 THEN 'Date of birth' ELSE 'Search products' END || ' *'"""


@query("form_labels", f"""
WITH p AS ({FORMS}) SELECT page_id, concat('f', cast(page_id AS VARCHAR)) AS for_id, {LABEL} AS text FROM p""")
def form_labels(spark, sf):
    return html.label_map(forms(spark, sf))


@query("form_elements", f"""
WITH p AS ({FORMS})
SELECT page_id, 'input' AS role, {LABEL} AS display_name, 12 AS y100 FROM p
UNION ALL SELECT page_id, 'textarea', 'notes', 20 FROM p
UNION ALL SELECT page_id, 'button', concat('Save ', c_mktsegment), 28 FROM p""")
def form_elements(spark, sf):
    """H1, H2, H6, J1, H11, H7 together."""
    return html.page_elements(forms(spark, sf)).select("page_id", "role", "display_name", F.round(F.col("y") * 100).cast("int").alias("y100"))


@query("form_benchmark_elements", f"""
WITH p AS ({FORMS})
SELECT page_id, 'input' AS role, CASE page_id % 6 WHEN 2 THEN 'field_a' WHEN 5 THEN 'search_box' ELSE 'field_b' END AS name, page_id % 6 = 1 AS is_sensitive FROM p
UNION ALL SELECT page_id, 'button', concat('Save ', c_mktsegment), false FROM p
UNION ALL SELECT page_id, 'canvas', 'Canvas Graphic Area', true FROM p WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'iframe', 'External Frame', true FROM p WHERE page_id % 5 = 0""")
def form_benchmark_elements(spark, sf):
    return html.benchmark_elements(forms(spark, sf)).select("page_id", "role", "name", "is_sensitive")


@query("form_sensitivity", f"""
WITH p AS ({FORMS})
SELECT page_id, category, reason FROM (SELECT page_id,
 CASE page_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'password' WHEN 2 THEN 'credit_card' WHEN 3 THEN CASE WHEN page_id % 12 = 3 THEN 'email' END WHEN 4 THEN 'date_of_birth' END AS category,
 CASE page_id % 6 WHEN 0 THEN 'input[type="email"]' WHEN 1 THEN 'input[type="password"]' WHEN 2 THEN 'sensitive label field'
   WHEN 3 THEN CASE WHEN page_id % 12 = 3 THEN 'live value matches PII (email)' END WHEN 4 THEN 'sensitive label field' END AS reason FROM p) WHERE category IS NOT NULL""")
def form_sensitivity(spark, sf):
    """D7 over the form fields."""
    return fields.classify_fields(html.attach_labels(html.extract_fields(forms(spark, sf)), html.label_map(forms(spark, sf)))).filter(
        "sensitive").select("page_id", "category", "reason")


@query("form_slots", f"""
WITH p AS ({FORMS})
SELECT page_id, slot FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'password' WHEN 4 THEN 'dateOfBirth' END AS slot FROM p) WHERE slot IS NOT NULL""")
def form_slots(spark, sf):
    """J10 over the form fields."""
    labelled = html.attach_labels(html.extract_fields(forms(spark, sf)), html.label_map(forms(spark, sf)))
    return fields.semantic_type(labelled.filter("tag = 'input'")).filter("slot IS NOT NULL").select("page_id", "slot")


@query("element_roles", """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'checkbox' WHEN 1 THEN 'button' WHEN 2 THEN 'textarea' WHEN 3 THEN 'select' WHEN 4 THEN 'link' WHEN 5 THEN 'tab' WHEN 6 THEN 'menuitem' ELSE 'generic' END AS role,
 CASE c_custkey % 8 WHEN 2 THEN 'click,hover,type' WHEN 3 THEN 'click,hover,select' WHEN 7 THEN 'click,hover,drag' ELSE 'click,hover' END AS caps FROM customer""")
def element_roles(spark, sf):
    els = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 8 WHEN 0 THEN 'input' WHEN 1 THEN 'input' WHEN 4 THEN 'a' ELSE 'div' END AS tag",
        "CASE c_custkey % 8 WHEN 0 THEN 'Checkbox' WHEN 1 THEN 'submit' END AS type",
        "CASE c_custkey % 8 WHEN 2 THEN 'searchbox' WHEN 3 THEN 'combobox' WHEN 5 THEN 'tab' WHEN 6 THEN 'option' END AS role_attr",
        "cast(NULL as string) AS haspopup", "false AS editable", "c_custkey % 8 = 7 AS draggable", "'' AS cls")
    return html.derive_caps(html.derive_role(els)).select("c_custkey", "role", F.array_join("caps", ",").alias("caps"))


@query("element_names", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'Submit' WHEN 2 THEN 'Settings' WHEN 3 THEN concat('Download price list ', cast(c_custkey AS VARCHAR), '.pdf') ELSE 'button' END AS display_name FROM customer""")
def element_names(spark, sf):
    els = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 5 WHEN 0 THEN 'input' WHEN 1 THEN 'input' WHEN 4 THEN 'button' ELSE 'a' END AS tag",
        "CASE c_custkey % 5 WHEN 1 THEN 'submit' ELSE '' END AS type", "CASE c_custkey % 5 WHEN 0 THEN c_name END AS label_text", "'' AS aria_label",
        "'ph' AS placeholder", "'' AS title", "'' AS value", "'n' AS name", "'' AS text", "'' AS alt",
        "CASE c_custkey % 5 WHEN 2 THEN '/me/settings' WHEN 3 THEN concat('/f/price_list_', cast(c_custkey as string), '.pdf?x=1') ELSE '' END AS href",
        "CASE c_custkey % 5 WHEN 4 THEN 'button' ELSE 'link' END AS role")
    return html.derive_name(els).select("c_custkey", "display_name")


@query("record_tables", f"""
WITH p AS ({RECORDS})
SELECT page_id, 1 AS row, c_name AS name, '[REDACTED_EMAIL]' AS col2, concat('/c/', cast(page_id AS VARCHAR), '.pdf') AS url, concat('$', cast(page_id AS VARCHAR), '.50') AS balance FROM p WHERE page_id % 3 <> 2
UNION ALL SELECT page_id, 2, 'A|b', c_mktsegment, NULL, 'n/a' FROM p WHERE page_id % 3 <> 2""")
def record_tables(spark, sf):
    out = html.extract_tables(derive(spark, sf, RECORD_PAGES, heavy=True))
    r = F.col("record")
    return out.select("page_id", "row", F.try_element_at(r, F.lit("Name")).alias("name"), F.try_element_at(r, F.lit("column_2")).alias("col2"),
                      F.try_element_at(r, F.lit("column_2_url")).alias("url"), F.try_element_at(r, F.lit("Balance")).alias("balance"))


@query("record_kv", f"""
WITH p AS ({RECORDS}) SELECT page_id, c_mktsegment AS segment, cast(page_id AS VARCHAR) AS key FROM p WHERE page_id % 3 = 2""")
def record_kv(spark, sf):
    return html.extract_kv(derive(spark, sf, RECORD_PAGES, heavy=True)).select("page_id", F.col("record")["Segment"].alias("segment"), F.col("record")["Key"].alias("key"))


@query("record_cascade", f"""
WITH p AS ({RECORDS}) SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'generic' ELSE 'table' END AS strategy, CASE WHEN page_id % 3 = 2 THEN 1 ELSE 2 END::BIGINT AS rows FROM p""")
def record_cascade(spark, sf):
    return html.extract_records(derive(spark, sf, RECORD_PAGES, heavy=True)).groupBy("page_id", "strategy").agg(F.count(F.lit(1)).alias("rows"))


@query("record_coercion", f"""
WITH p AS ({RECORDS}) SELECT page_id, concat(cast(page_id AS VARCHAR), '.50') AS first, 'n/a' AS second FROM p WHERE page_id % 3 <> 2""")
def record_coercion(spark, sf):
    """A number column becomes a number where it has one."""
    out = html.extract_tables(derive(spark, sf, RECORD_PAGES, heavy=True), schema={"Balance": "number"})
    return out.groupBy("page_id").agg(*[F.max(F.when(F.col("row") == i, F.col("record")["Balance"])).alias(n) for i, n in ((1, "first"), (2, "second"))])


@query("record_markdown", f"""
WITH p AS ({RECORDS})
SELECT page_id, concat('| Name | column_2 | column_2_url | Balance |', chr(10), '| --- | --- | --- | --- |', chr(10), '| ', c_name, ' | [REDACTED_EMAIL] | /c/', cast(page_id AS VARCHAR), '.pdf | $', cast(page_id AS VARCHAR), '.50 |',
  chr(10), '| A\\|b | ', c_mktsegment, ' |  | n/a |') AS markdown FROM p WHERE page_id % 3 <> 2""")
def record_markdown(spark, sf):
    return html.to_markdown(html.extract_tables(derive(spark, sf, RECORD_PAGES, heavy=True)))


@query("record_keys", f"""
WITH p AS ({RECORDS}) SELECT page_id, 'Name,column_2,column_2_url,Balance' AS keys FROM p WHERE page_id % 3 <> 2""")
def record_keys(spark, sf):
    return html.record_keys(html.extract_tables(derive(spark, sf, RECORD_PAGES, heavy=True))).select("page_id", F.array_join("keys", ",").alias("keys"))


@query("next_pages", f"""
WITH p AS ({RECORDS}) SELECT page_id, concat('/p/', cast(page_id + 1 AS VARCHAR)) AS href, 'more' AS text FROM p WHERE page_id % 2 = 0
UNION ALL SELECT page_id, concat('/q/', cast(page_id AS VARCHAR)), 'Load more' FROM p WHERE page_id % 2 = 1 AND page_id % 5 = 1""")
def next_pages(spark, sf):
    return html.next_page(derive(spark, sf, RECORD_PAGES, heavy=True))


@query("page_counters", f"""
WITH p AS ({RECORDS}) SELECT page_id, 'Orders' AS label, cast(page_id % 90 AS VARCHAR) AS value FROM p""")
def page_counters(spark, sf):
    return html.counters(derive(spark, sf, RECORD_PAGES, heavy=True)).select("page_id", "label", "value")


@query("page_specs", f"""
WITH p AS ({RECORDS})
SELECT page_id, 'heading' AS kind, NULL AS key, concat('Account ', c_name) AS value FROM p
UNION ALL SELECT page_id, 'table', '1', '2 records; columns: [Name, Balance]' FROM p WHERE page_id % 3 <> 2
UNION ALL SELECT page_id, 'spec', 'Segment', c_mktsegment FROM p WHERE page_id % 3 = 2
UNION ALL SELECT page_id, 'spec', 'Key', cast(page_id AS VARCHAR) FROM p WHERE page_id % 3 = 2""")
def page_specs(spark, sf):
    return html.page_specs(derive(spark, sf, RECORD_PAGES, heavy=True)).select("page_id", "kind", "key", "value")


@query("document_links", f"""
WITH p AS ({RECORDS}) SELECT page_id, concat('user', cast(page_id AS VARCHAR), '@mail.example.com') AS text, concat(cast(page_id AS VARCHAR), '.pdf') AS file FROM p WHERE page_id % 3 <> 2""")
def document_links(spark, sf):
    return html.document_links(derive(spark, sf, RECORD_PAGES, heavy=True)).select("page_id", "text", "file")


@query("status_lines", f"""
WITH p AS ({RECORDS}) SELECT page_id, 'status' AS kind, concat('Saved ', cast(page_id AS VARCHAR)) AS text FROM p""")
def status_lines(spark, sf):
    return html.status_lines(derive(spark, sf, RECORD_PAGES, heavy=True)).select("page_id", "kind", "text")


@query("order_cards", """
SELECT o_orderkey AS page_id, 1 AS row, concat('Order ', cast(o_orderkey AS VARCHAR)) AS title, concat('/o/', cast(o_orderkey AS VARCHAR)) AS url, concat('Priority ', o_orderpriority) AS description,
  o_orderstatus AS tag, concat('$', cast(o_orderkey % 500 AS VARCHAR), '.25') AS price FROM orders
UNION ALL SELECT o_orderkey, 2, concat('Customer ', cast(o_custkey AS VARCHAR)), NULL, 'Write to [REDACTED_EMAIL]', NULL, NULL FROM orders""")
def order_cards(spark, sf):
    out = html.extract_cards(derive(spark, sf, CARD_PAGES, heavy=True))
    return out.select("page_id", "row", *[F.try_element_at("record", F.lit(k)).alias(k) for k in ("title", "url", "description", "tag", "price")])


@query("order_card_fields", """
SELECT o_orderkey AS page_id, 1 AS row, concat('/o/', cast(o_orderkey AS VARCHAR)) AS link, o_orderstatus AS badge FROM orders
""")
def order_card_fields(spark, sf):
    """Declared fields of the first card."""
    out = html.extract_cards(derive(spark, sf, CARD_PAGES, heavy=True), schema={"link": "link", "badge": "string"})
    return html.schema_fields(out, {"link": "link", "badge": "string"}).filter("row = 1")


@query("post_authors", """
SELECT o_orderkey AS page_id, 'post' AS kind, concat('Clerk  ', cast(o_custkey AS VARCHAR)) AS author, concat('Shipped ', o_orderpriority) AS body FROM orders""")
def post_authors(spark, sf):
    return html.posts(derive(spark, sf, CARD_PAGES, heavy=True)).select("page_id", "kind", "author", "body")


@query("element_context", f"""
WITH p AS ({RECORDS})
SELECT page_id, concat('/c/', cast(page_id AS VARCHAR), '.pdf') AS href, false AS in_dialog, false AS is_breadcrumb FROM p WHERE page_id % 3 <> 2""")
def element_context(spark, sf):
    nodes = node_table(derive(spark, sf, RECORD_PAGES, heavy=True))
    ctx = html.element_context(nodes).filter("tag = 'a'")
    href = nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href"))
    return ctx.join(href.hint("merge"), ["page_id", "node_id"]).filter(F.col("href").endswith(".pdf")).select("page_id", "href", "in_dialog", "is_breadcrumb")


@query("chained_records", """
SELECT o_custkey AS chain_id, o_orderpriority AS title FROM orders GROUP BY ALL""")
def chained_records(spark, sf):
    """A customer's orders as pages of one result list, one record per title."""
    recs = table(spark, sf, "orders").selectExpr("o_custkey AS chain_id", "o_orderkey AS page_no", "1 AS row", "map('title', o_orderpriority) AS record")
    return html.concat_pages(recs, "id", 50).select("chain_id", F.col("record")["title"].alias("title"))


@query("image_classes", f"""
WITH p AS ({FORMS}) SELECT page_id, page_id % 8 <> 0 AS is_avatar, page_id % 8 = 0 AS is_public FROM p WHERE page_id % 4 = 0""")
def image_classes(spark, sf):
    imgs = html.extract_images(forms(spark, sf)).withColumn("public_post", F.col("page_id") % 8 == 0)
    return html.classify_images(imgs).select("page_id", "is_avatar", "is_public")


@query("surface_inspection", """
SELECT c_custkey % 7 AS k, CASE c_custkey % 7 WHEN 0 THEN 'canvas' WHEN 1 THEN 'webgl_canvas' WHEN 2 THEN 'video' WHEN 3 THEN 'pdf' WHEN 4 THEN 'image_text' WHEN 5 THEN 'iframe' END AS surface_type,
 CASE c_custkey % 7 WHEN 0 THEN 'inspected_same_origin' WHEN 1 THEN 'uninspectable_canvas' WHEN 2 THEN 'uninspectable_media' WHEN 3 THEN 'uninspectable_plugin' WHEN 4 THEN 'uninspectable_image_text' WHEN 5 THEN 'uninspectable_cross_origin' END AS status, count(*) AS n
FROM customer WHERE c_custkey % 7 <> 6 GROUP BY ALL""")
def surface_inspection(spark, sf):
    els = table(spark, sf, "customer").selectExpr(
        "c_custkey % 7 AS k", "element_at(array('canvas', 'canvas', 'video', 'embed', 'img', 'iframe', 'iframe'), cast(c_custkey % 7 + 1 as int)) AS tag",
        "CASE WHEN c_custkey % 7 = 4 THEN 'Receipt big' ELSE '' END AS cls", "c_custkey % 7 = 0 AS is_map", "c_custkey % 7 = 1 AS is_webgl",
        "CASE c_custkey % 7 WHEN 3 THEN '/a.PDF' WHEN 6 THEN 'https://doubleclick.net/x' ELSE '/x' END AS src", "300.0 AS width", "200.0 AS height")
    return html.surface_status(els).groupBy("k", "surface_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("context_flags", """
SELECT c_custkey % 5 AS k, c_custkey % 5 = 0 AS is_map, c_custkey % 5 = 1 AS is_messaging, c_custkey % 5 = 2 AS is_account, c_custkey % 5 = 3 AS is_public_post, c_custkey % 5 = 4 AS is_public_media, count(*) AS n FROM customer GROUP BY ALL""")
def context_flags(spark, sf):
    els = table(spark, sf, "customer").selectExpr(
        "c_custkey % 5 AS k", "CASE WHEN c_custkey % 5 = 1 THEN 'https://s.example.com/inbox/' ELSE 'https://s.example.com/p' END AS url",
        "CASE c_custkey % 5 WHEN 0 THEN 'canvas' WHEN 3 THEN 'article' WHEN 4 THEN 'video' ELSE 'div' END AS tag", "CASE c_custkey % 5 WHEN 0 THEN 'leaflet-tile' ELSE '' END AS cls", "'' AS html_id",
        "CASE c_custkey % 5 WHEN 2 THEN map('aria-label', 'Switch Account') WHEN 4 THEN map('controls', '', 'src', 'https://v.example.com/1.mp4') ELSE map('a', 'b') END AS attrs",
        "cast(array() as array<struct<id:int,tag:string,cls:string,role:string,html_id:string>>) AS anc")
    return scrub.context_flags(els).groupBy("k", "is_map", "is_messaging", "is_account", "is_public_post", "is_public_media").agg(F.count(F.lit(1)).alias("n"))


@query("mask_breakdown", """
SELECT c_custkey AS page_id, 'email' AS label, 2::BIGINT AS n FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'phone', 1 FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'face', 3 FROM customer WHERE c_custkey % 2 = 1""")
def mask_breakdown(spark, sf):
    base = table(spark, sf, "customer")
    els = base.selectExpr("c_custkey AS page_id", "'[PHONE FIELD]' AS sanitized_name", "'input' AS role")
    man = base.selectExpr("c_custkey AS page_id", "4L AS total_masks", "CASE WHEN c_custkey % 2 = 0 THEN map('email', 2L, 'phone', 0L) ELSE map('email', 0L) END AS by_category")
    return scrub.mask_breakdown(els, man)
