"""Near-duplicate detection (operator 4): MinHash with tensored banding.

A text's set holds its distinct word shingles. Two small collections of ``HALVES`` min-hashes each make
``HALVES ** 2`` tables: table (i, j) has the key (i-th of the first, j-th of the second), so 49 tables cost 14
min-hashes. A pair of similarity s meets in some table with probability (1 - (1 - s)^7)^2, over 0.99997 at 0.8.

* Texts with equal sets are one representative, the smallest id.
* Passages that many documents share would fill a table's buckets with unlike documents. A min-hash value that more than
  ``COMMON`` representatives have is common, and a key of two common values is left out for documents with at least 7
  uncommon values: a partner at 0.8 or more lacks all of these with probability 0.2^7. So every other bucket has at most
  ``COMMON`` members, whose pairs (of sizes that allow the similarity, and with at least ``AGREE`` equal min-hashes) are the
  candidates. Documents made mostly of common shingles keep all keys; a bucket of theirs names its members as candidates
  by a star of links to its smallest member, not by pairs.
* Candidates are grouped to connected clouds. A cloud's members are dealt into blocks of ``BLOCK``, each pair of blocks is one group
  that holds whole texts, and there every pair is confirmed by counting its common shingles exactly. A group
  returns a spanning star of its links, not the pairs.

Shingles are compared by 64-bit hashes. Documents without words are linked with nothing; so are rows without an id, whose
component is NULL and which are kept. Rows that share an id are one node, and all of them get its component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import texts, utf8, written
from veil.llm.components import components
from veil.llm.shingles import mix, sets

HALVES = 7
COMMON = 32
AGREE = 5
BLOCK = 256
COLUMNS = 8192
SEEDS = mix(np.arange(1, 2 * HALVES + 1, dtype=np.uint64))
SKETCH = "doc_id bigint, n_shingles bigint, digest_a bigint, digest_b bigint, halves array<bigint>"


def _text_groups(batch: pa.RecordBatch, most: int = 2_000_000):
    """Parts of a batch (id, utf-8 text) of bounded size: the arrays of their shingles take some hundred bytes a word."""
    ids, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    at = 0
    while at < len(ids):
        end, size = at, 0
        while end < len(ids) and (end == at or size + len(values[end] or b"") <= most):
            size += len(values[end] or b"")
            end += 1
        yield ids[at:end], [v or b"" for v in values[at:end]]
        at = end


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            for ids, values in _text_groups(batch):
                found, offsets = sets(values, width)
                counts = np.diff(offsets)
                some = counts > 0
                starts = offsets[:-1][some]
                halves = np.zeros((len(ids), 2 * HALVES), dtype=np.uint64)
                digests = np.zeros((len(ids), 2), dtype=np.uint64)
                if len(starts):
                    for k in range(2 * HALVES):
                        halves[some, k] = np.minimum.reduceat(mix(found ^ SEEDS[k]), starts)
                    digests[some, 0] = np.add.reduceat(mix(found), starts)
                    digests[some, 1] = np.add.reduceat(mix(found + SEEDS[0]), starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "n_shingles": pa.array(counts, pa.int64()),
                    "digest_a": digests[:, 0].view(np.int64), "digest_b": digests[:, 1].view(np.int64),
                    "halves": pa.ListArray.from_arrays(np.arange(0, 2 * HALVES * len(ids) + 1, 2 * HALVES, dtype=np.int32), halves.view(np.int64).ravel())})

    return docs.select("doc_id", utf8(F.col("text"))).mapInArrow(sketch, SKETCH)


def _candidates(reps: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between representatives that may be similar."""
    halves = reps.select("doc_id", F.posexplode("halves").alias("half", "value"))
    common = written(halves.groupBy("half", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("half", "value"), "common-halves")
    marks = halves.join(common, ["half", "value"]).groupBy("doc_id").agg(F.collect_set("half").alias("common"))
    marked = written(reps.select("doc_id", "n_shingles", "halves").join(marks, "doc_id", "left").withColumn("common", F.coalesce("common", F.array().cast("array<int>"))), "marked")
    tables = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(HALVES + j).alias("j")) for i in range(HALVES) for j in range(HALVES)])
    rows = marked.withColumn("mostly", F.size("common") > HALVES).select("doc_id", "n_shingles", "mostly", "common", "halves", F.explode(tables).alias("t"))
    both = F.array_contains("common", F.col("t.i")) & F.array_contains("common", F.col("t.j"))
    key = F.xxhash64("t.i", "t.j", F.get("halves", F.col("t.i")), F.get("halves", F.col("t.j")))
    keyed = rows.withColumns({"both": both, "key": key})

    narrow = keyed.where(~F.col("both")).select("key", "doc_id", "n_shingles")
    left, right = narrow.alias("l"), narrow.alias("r")
    sized = F.least("l.n_shingles", "r.n_shingles") * 100 >= F.greatest("l.n_shingles", "r.n_shingles") * percent
    met = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.doc_id") > F.col("r.doc_id")) & sized)
    pairs = met.select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    values = marked.select("doc_id", "halves")
    agreed = pairs.join(values.toDF("a", "ha"), "a").join(values.toDF("b", "hb"), "b").where(
        F.aggregate(F.zip_with("ha", "hb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) >= AGREE).select("a", "b")

    wide = keyed.where(F.col("both") & F.col("mostly")).select("key", "doc_id")
    stars = wide.join(wide.groupBy("key").agg(F.min("doc_id").alias("b")), "key").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    return agreed.unionByName(stars)


def _common_counts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Shingles that each two of ``n`` sets share."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), dtype=np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        grid = np.zeros((n, COLUMNS), dtype=np.float32)
        grid[owner[part], column[part] - k * COLUMNS] = 1
        out += grid @ grid.T
    return out


def _linked(ids: list[int], values: list[bytes], width: int, percent: int) -> list[tuple[int, int]]:
    """A spanning star (member, smallest member) of each connected group of confirmed links."""
    order = np.argsort(np.array(ids), kind="stable")
    ids = np.array(ids)[order]
    found, offsets = sets([values[i] for i in order], width)
    sizes = np.diff(offsets)
    both = _common_counts(found, np.repeat(np.arange(len(ids)), sizes), len(ids))
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (sizes > 0)[:, None] & (sizes > 0)[None, :]
    np.fill_diagonal(linked, True)
    least = np.arange(len(ids))
    while True:
        moved = np.where(linked, least[None, :], len(ids)).min(axis=1)
        moved = np.minimum(moved, moved[moved])
        if (moved == least).all():
            return [(int(ids[i]), int(ids[m])) for i, m in enumerate(least) if i != m]
        least = moved


def _confirmed(docs: DataFrame, clouds: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: true links among the members of each cloud, as stars."""
    sizes = clouds.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = clouds.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    # The same join at every size: clouds grow with the documents, so they are not broadcast where they happen to be few.
    placed = dealt.hint("merge").join(docs, dealt["id"] == docs["doc_id"]).select("component", "id", "text", F.explode(others).alias("at"))
    grouped = placed.select("component", "at.x", "at.y", "id", utf8(F.col("text")).alias("text"))
    parted = grouped.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "id")

    def confirm(batches):
        key, ids, values = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = [c.to_pylist() for c in batch.columns]
            for *at, doc_id, text in zip(*rows):
                if at != key:
                    out += _linked(ids, values, width, percent) if len(ids) > 1 else []
                    key, ids, values = at, [], []
                ids.append(doc_id)
                values.append(text or b"")
            yield _pairs(out)
        yield _pairs(_linked(ids, values, width, percent) if len(ids) > 1 else [])

    return parted.mapInArrow(confirm, "a bigint, b bigint")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; links have 100 * intersection >= ``percent`` * union."""
    rows = texts(docs, id_col, text_col)
    sketched = written(sketches(rows, width), "sketches")
    known = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = ["digest_a", "digest_b", "n_shingles"]
    firsts = written(known.groupBy(*classes).agg(F.min_by("halves", "doc_id").alias("halves"), F.min("doc_id").alias("doc_id")), "representatives")
    clouds = written(components(_candidates(firsts, percent)), "clouds")
    links = written(_confirmed(rows, clouds, width, percent), "confirmed")
    copies = known.join(firsts.select(*classes, F.col("doc_id").alias("first")), classes).select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    found = components(links.unionByName(copies))
    out = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
