"""Line deduplication (operator 9): winnowing over line hashes.

A document is the sequence of its lines that are not blank, without blanks at either end. Each window of ``run`` lines
selects the line of least hash in it (the first of equals), so two equal windows select the same line: a
repeated run of ``run`` lines or more cannot escape. Shorter runs stay, so only ``run=1``, where each line is a window and selects itself,
takes every later copy of a line and reaches documents of one or two lines. Selected lines meet on their hash; those met again send the
windows that selected them to a second join, and each window that also starts earlier (smaller id, or the same id
and a smaller line number) is deleted. Matches are not extended line by line; neighbouring windows make up the longer runs. Judged on the
input, not on what is left.

Joins carry one row a selected line; a line that very many documents share is counted by partial sums, and the joins on it are
ones that Spark can split. Blank lines stay. Null text has no lines. Rows without an id stay as they are and are no source;
rows that share an id are one place, so what
they repeat among them at the same line number stays, and each loses lines of its own text only.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import texts, utf8, written

_BLANKS = b" \t\x0b\x0c\r"


def _selected(lines: list[int], run: int):
    """``place, windows``: selected lines, each with the (hash, start) of the windows that selected it."""
    found: dict[int, list[tuple[int, int]]] = {}
    for start in range(len(lines) - run + 1):
        window = lines[start:start + run]
        packed = b"".join(v.to_bytes(8, "little", signed=True) for v in window)
        found.setdefault(start + window.index(min(window)), []).append((_hash(packed), start))
    return found.items()


def _hash(value: bytes) -> int:
    return int.from_bytes(blake2b(value, digest_size=8).digest(), "little", signed=True)


def repeated_runs(docs: DataFrame, run: int) -> DataFrame:
    """``doc_id, version, starts``: the windows of ``run`` lines of a document that also start earlier."""

    def select(batches):
        for batch in batches:
            rows: dict[str, list] = {"line": [], "doc_id": [], "version": [], "windows": []}
            for doc_id, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                lines = [_hash(s) for s in (line.strip(_BLANKS) for line in (text.as_py() or b"").split(b"\n")) if s]
                for place, windows in _selected(lines, run):
                    rows["line"].append(lines[place])
                    rows["doc_id"].append(doc_id)
                    rows["version"].append(version)
                    rows["windows"].append([{"w": w, "start": s} for w, s in windows])
            yield pa.RecordBatch.from_pydict({
                "line": pa.array(rows["line"], pa.int64()), "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "version": pa.array(rows["version"], pa.int64()),
                "windows": pa.array(rows["windows"], pa.list_(pa.struct([("w", pa.int64()), ("start", pa.int64())])))})

    lines = docs.where("doc_id IS NOT NULL").select("doc_id", "version", utf8(F.col("text"))).mapInArrow(
        select, "line bigint, doc_id bigint, version bigint, windows array<struct<w:bigint,start:bigint>>")
    lines = written(lines, "selected-lines")
    met = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line")
    windows = written(lines.join(met, "line").select("doc_id", "version", F.explode("windows").alias("at")).select("doc_id", "version", "at.w", "at.start"), "line-windows")
    place = F.struct("doc_id", "start")
    first = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("w", "first")
    later = windows.join(first, "w").where(place > F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.collect_set("start").alias("starts"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 1) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row; ``text`` is what is left."""

    @F.arrow_udf("struct<n_lines:bigint,n_removed:bigint,text:string>")
    def cut(text: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for value, from_lines in zip(text, starts):
            whole, gone = value.as_py(), {s + k for s in from_lines.as_py() or [] for k in range(run)}
            kept, n = [], 0
            for line in (whole or b"").split(b"\n"):
                if not line.strip(_BLANKS):
                    kept.append(line)
                    continue
                if n not in gone:
                    kept.append(line)
                n += 1
            out.append({"n_lines": n, "n_removed": len(gone), "text": None if whole is None else b"\n".join(kept).decode("utf-8", "replace")})
        return pa.array(out, pa.struct([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))

    rows = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    joined = rows.join(repeated_runs(rows, run), ["doc_id", "version"], "left")
    return joined.select("doc_id", cut(utf8(F.col("text")), F.col("starts")).alias("c")).select("doc_id", "c.n_lines", "c.n_removed", "c.text")
