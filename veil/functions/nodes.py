"""HTML text -> node rows. The one place where Python reads pages: parsing markup.

The parser only turns tags into rows (document order, parent, attributes, text); every
question about the rows is asked in Spark.
"""

from __future__ import annotations

import re
import uuid
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.session import checkpoint_dir

NODE_SCHEMA = (
    "{key}, node_id int, parent_id int, depth int, tag string, cls string, role string, attrs map<string,string>, "
    "text string, anc array<struct<id:int,tag:string,cls:string,role:string,html_id:string>>"
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "noscript", "template"))
# An opening tag on the left ends an open element named on the right.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
    "tfoot": ("tbody", "tr", "td", "th"),
}
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split())
_SCOPE = frozenset(("table", "ul", "ol", "dl", "select", "body", "html"))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.pieces = [], [], []

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        attrs = {k: (v or "") for k, v in attrs}
        parent = self.open[-1] if self.open else None
        anc = [] if parent is None else parent["anc"] + [
            (parent["node_id"], parent["tag"], parent["cls"], parent["role"], parent["attrs"].get("id", ""))]
        row = {
            "node_id": len(self.rows), "parent_id": parent["node_id"] if parent else -1, "depth": len(anc),
            "tag": tag, "cls": attrs.get("class", ""), "role": attrs.get("role", ""), "attrs": attrs,
            "anc": anc, "from": len(self.pieces), "to": len(self.pieces),
        }
        self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1]["tag"] == tag:
            self._close()

    def handle_endtag(self, tag):
        if any(r["tag"] == tag for r in self.open):
            while self.open and self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not (self.open and self.open[-1]["tag"] in SILENT):
            self.pieces.append(data)

    def _imply_ends(self, tag):
        enders = _ENDS.get(tag, ()) + (("p",) if tag in _ENDS_P else ())
        while enders:
            at = next((i for i in range(len(self.open) - 1, -1, -1)
                       if self.open[i]["tag"] in enders or self.open[i]["tag"] in _SCOPE), None)
            if at is None or self.open[at]["tag"] not in enders:
                return
            while len(self.open) > at:
                self._close()

    def _close(self):
        self.open.pop()["to"] = len(self.pieces)

    def finish(self):
        self.close()
        while self.open:
            self._close()
        return self.rows, self.pieces


def page_nodes(html: str, text_tags=None) -> list[dict]:
    tree = _Tree()
    tree.feed(html or "")
    rows, pieces = tree.finish()
    for r in rows:
        begin, end = r.pop("from"), r.pop("to")
        wanted = r["tag"] not in ("html", "head", "body") if text_tags is None else r["tag"] in text_tags
        r["text"] = "".join(pieces[begin:end]) if wanted else None
    return rows


# Markup without entities, comments, raw text or loose quotes: one regex cuts it into tags and text. Anything else is HTMLParser's.
_RAW = "script|style|noscript|template|textarea|title|iframe|noembed|noframes|plaintext|xmp|svg|math"
_ATTRS = r"""(?: [a-z][a-z0-9_:-]*="[^"<>&]*")*"""
_TOKEN = re.compile(rf"<(/?)([a-z][a-z0-9]*)({_ATTRS})(/?)>|([^<&]+)")
_PLAIN = re.compile(rf"(?:</[a-z][a-z0-9]*>|<(?!(?:{_RAW})\b)[a-z][a-z0-9]*{_ATTRS}/?>|[^<&]++)*+")
_ATTR = re.compile(r' ([a-z][a-z0-9_:-]*)="([^"]*)"')
_NO_TEXT = frozenset(("html", "head", "body"))


def page_tree(html: str, keep_text: bool = True) -> list[list]:
    """``[parent_id, last_id, tag, attrs, text]`` of every element, in document order; ``last_id`` is the last one inside."""
    if not _PLAIN.fullmatch(html):
        found = page_nodes(html, None if keep_text else ())
        rows = [[r["parent_id"], i, r["tag"], r["attrs"], r["text"]] for i, r in enumerate(found)]
        for i in range(len(rows) - 1, -1, -1):
            up = rows[i][0]
            if up >= 0 and rows[up][1] < rows[i][1]:
                rows[up][1] = rows[i][1]
        return rows
    rows, pieces, opened, tags = [], [], [], []

    def close_to(depth):
        last, end = len(rows) - 1, len(pieces)
        for i in opened[depth:]:
            row = rows[i]
            row[1] = last
            if keep_text and row[2] not in _NO_TEXT:
                row[4] = "".join(pieces[row[4]:end])
            else:
                row[4] = None
        del opened[depth:], tags[depth:]

    for end_mark, tag, raw, slash, data in _TOKEN.findall(html):
        if data:
            pieces.append(data)
        elif end_mark:
            if tag in tags:
                depth = len(tags) - 1
                while tags[depth] != tag:
                    depth -= 1
                close_to(depth)
        else:
            enders = _ENDERS.get(tag)
            while enders:
                depth = len(tags) - 1
                while depth >= 0 and tags[depth] not in enders and tags[depth] not in _SCOPE:
                    depth -= 1
                if depth < 0 or tags[depth] not in enders:
                    break
                close_to(depth)
            rows.append([opened[-1] if opened else -1, 0, tag, dict(_ATTR.findall(raw)) if raw else {}, len(pieces)])
            opened.append(len(rows) - 1)
            tags.append(tag)
            if slash or tag in VOID:
                close_to(len(tags) - 1)
    close_to(0)
    return rows


_ENDERS = {tag: frozenset(_ENDS.get(tag, ()) + (("p",) if tag in _ENDS_P else ())) for tag in {*_ENDS, *_ENDS_P}}
_TREE = "nodes array<struct<node_id:int,parent_id:int,last_id:int,tag:string,cls:string,role:string,attrs:map<string,string>,text:string>>"


def _tree_batch(keys: list, trees: list[list[list]], key: str, key_type: pa.DataType) -> pa.RecordBatch:
    ends, ids, at = [0], [], 0
    for tree in trees:
        at += len(tree)
        ends.append(at)
        ids.extend(range(len(tree)))
    rows = [row for tree in trees for row in tree]
    parents, lasts, tags, attrs, texts = zip(*rows) if rows else ((),) * 5
    attr_ends, total = [0], 0
    for a in attrs:
        total += len(a)
        attr_ends.append(total)
    names, values = [k for a in attrs for k in a], [v for a in attrs for v in a.values()]
    columns = [pa.array(ids, pa.int32()), pa.array(parents, pa.int32()), pa.array(lasts, pa.int32()), pa.array(tags, pa.string()),
               pa.array([a.get("class", "") for a in attrs], pa.string()), pa.array([a.get("role", "") for a in attrs], pa.string()),
               pa.MapArray.from_arrays(pa.array(attr_ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())),
               pa.array(texts, pa.string())]
    nodes = pa.StructArray.from_arrays(columns, names=["node_id", "parent_id", "last_id", "tag", "cls", "role", "attrs", "text"])
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes)], names=[key, "nodes"])


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page with its elements in document order: element ``i`` holds the elements ``i + 1`` to ``last_id``.

    What is inside what needs no join and no shuffle then: it is a slice of the page's own array.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, {_TREE}"

    def parse(batches):
        for batch in batches:
            key_type, keys, trees, size = batch.column(0).type, [], [], 0
            for page_key, page_html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = page_tree(page_html or "")
                keys.append(page_key)
                trees.append(tree)
                size += len(tree)
                if size >= ROWS_PER_BATCH:
                    yield _tree_batch(keys, trees, key, key_type)
                    keys, trees, size = [], [], 0
            if keys:
                yield _tree_batch(keys, trees, key, key_type)

    return pages.select(key, html).mapInArrow(parse, schema)


def page_arrays(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """The rows of :func:`parse_pages` out of all the rows of :func:`parse_nodes`."""
    inside = nodes.select(key, F.explode(F.concat(F.transform("anc", lambda a: a["id"]), F.array("node_id"))).alias("id"), "node_id")
    last = inside.groupBy(key, F.col("id").alias("node_id")).agg(F.max("node_id").alias("last_id"))
    node = F.struct("node_id", "parent_id", "last_id", "tag", "cls", "role", "attrs", "text")
    # Maps cannot be ordered, so the arrays are put in order by the node's number alone.
    return nodes.join(last, [key, "node_id"]).groupBy(key).agg(F.collect_list(node).alias("nodes")).select(
        key, F.array_sort("nodes", lambda a, b: a["node_id"] - b["node_id"]).alias("nodes"))


ROWS_PER_BATCH = 8192
_ANC = pa.list_(pa.struct([("id", pa.int32()), ("tag", pa.string()), ("cls", pa.string()), ("role", pa.string()), ("html_id", pa.string())]))
_TYPES = {"node_id": pa.int32(), "parent_id": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "cls": pa.string(),
          "role": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "anc": _ANC}


def _anc_column(rows: list[dict]) -> pa.Array:
    """Ancestor lists column by column, which is far cheaper than one dict per ancestor."""
    offsets, flat = [0], []
    for r in rows:
        flat.extend(r["anc"])
        offsets.append(len(flat))
    ids, tags, cls, roles, html_ids = zip(*flat) if flat else ((), (), (), (), ())
    inner = pa.StructArray.from_arrays(
        [pa.array(ids, pa.int32()), *[pa.array(c, pa.string()) for c in (tags, cls, roles, html_ids)]],
        fields=list(_ANC.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def _batch(keys: list, rows: list[dict], key: str, key_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(keys, key_type)]
    for name, kind in _TYPES.items():
        if name == "anc":
            columns.append(_anc_column(rows))
        elif name == "attrs":
            columns.append(pa.array([list(r["attrs"].items()) for r in rows], kind))
        else:
            columns.append(pa.array([r[name] for r in rows], kind))
    return pa.RecordBatch.from_arrays(columns, names=[key, *_TYPES])


def parse_nodes(pages: DataFrame, key: str = "page_id", html: str = "html", text_tags=None,
                keep_tags=None) -> DataFrame:
    """One row per element. ``text_tags`` limits whose text content is carried; ``keep_tags`` which rows leave.

    Both keep the node table small when a job needs only a few kinds of element.
    """
    schema = NODE_SCHEMA.format(key=f"{key} {pages.schema[key].dataType.simpleString()}")
    text_tags = frozenset(text_tags) if text_tags is not None else None
    keep_tags = frozenset(keep_tags) if keep_tags is not None else None

    def parse(batches):
        keys, rows = [], []
        for batch in batches:
            key_type = batch.column(0).type
            for page_key, page_html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = page_nodes(page_html, text_tags)
                if keep_tags is not None:
                    found = [r for r in found if r["tag"] in keep_tags]
                keys.extend([page_key] * len(found))
                rows.extend(found)
                if len(rows) >= ROWS_PER_BATCH:
                    yield _batch(keys, rows, key, key_type)
                    keys, rows = [], []
            if rows:
                yield _batch(keys, rows, key, key_type)
                keys, rows = [], []

    return pages.select(key, html).mapInArrow(parse, schema)


def node_table(pages: DataFrame, key: str = "page_id", html: str = "html", text_tags=None, keep_tags=None) -> DataFrame:
    """:func:`parse_nodes`, written once to the shared folder.

    For jobs that ask several questions of the same nodes: each question then reads the columns it needs, and no page is parsed twice.
    """
    spark = pages.sparkSession
    nodes = parse_nodes(pages, key, html, text_tags, keep_tags)
    path = f"{checkpoint_dir(spark).rstrip('/')}/nodes-{uuid.uuid4().hex}"
    nodes.write.parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)
