"""Benchmark decontamination (operator 1).

Every window of ``width`` consecutive words of a benchmark item (an item of fewer words is one window) is a
pattern of one Aho-Corasick automaton over normalised text: A-Z lowered, words joined by one blank. A
document is normalised the same way and scanned once; hits are mapped back to word numbers and to
character offsets of the original text.

The patterns travel to the executors, so their size is checked: beyond ``max_pattern_bytes`` they are dealt
by hash into several automata, and the documents are scanned by one after the other with a written table between.

Null and empty texts have no words and no hits. Rows are judged one by one, so repeated rows give repeated
results. An item without an id still marks words; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import utf8, written

# Every byte that is no digit, letter or part of a longer character parts words; A-Z become a-z.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,words:array<struct<first:bigint,last:bigint>>,spans:array<struct<start:bigint,end:bigint>>>"
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                         ("words", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _joined(words: list[bytes]) -> str:
    return " " + b" ".join(words).decode("latin-1") + " "


def windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``pattern, items``: the distinct windows of all items, with the ids they belong to."""

    def cut(batches):
        for batch in batches:
            patterns, ids = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").translate(_NORMAL).split()
                for at in range(max(1, len(words) - width + 1) if words else 0):
                    patterns.append(b" ".join(words[at:at + width]))
                    ids.append(item)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(patterns, pa.binary()), "item": pa.array(ids, pa.string())})

    rows = benchmark.select(F.col(id_col).cast("string"), utf8(F.col(text_col))).mapInArrow(cut, "pattern binary, item string")
    return rows.groupBy("pattern").agg(F.collect_set("item").alias("items"))


_AUTOMATON: dict[str, object] = {}


def _automaton(key: str, patterns):
    if key not in _AUTOMATON:
        import ahocorasick

        made = ahocorasick.Automaton()
        for pattern, items in patterns:
            made.add_word(_joined([pattern]), (len(pattern) + 2, pattern.count(b" ") + 1, items))
        made.make_automaton()
        _AUTOMATON.clear()
        _AUTOMATON[key] = made
    return _AUTOMATON[key]


def _scan(raw: bytes | None, automaton, found: dict | None) -> dict:
    flat = (raw or b"").translate(_NORMAL)
    words = flat.split()
    items = set(found["items"]) if found else set()
    ranges = [(w["first"], w["last"]) for w in found["words"]] if found else []
    hits = list(automaton.iter(_joined(words))) if words and len(automaton) else []
    if hits:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(lengths + 1) - lengths  # in the joined text, which starts with a blank
        firsts = np.searchsorted(begins, [end - size + 2 for end, (size, _, _) in hits])
        for first, (_, (_, count, ids)) in zip(firsts.tolist(), hits):
            ranges.append((first, first + count - 1))
            items.update(ids)
    merged: list[list[int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    spans = []
    if merged:
        places = [m.span() for m in _WORD.finditer(flat)]
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
        spans = [{"start": int(chars[places[a][0]]) - 1, "end": int(chars[places[b][1] - 1])} for a, b in merged]
    return {"n_words": len(words), "n_hit": sum(b - a + 1 for a, b in merged), "items": sorted(items),
            "words": [{"first": a, "last": b} for a, b in merged], "spans": spans}


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", out: str = "benchmark_hits",
                  max_pattern_bytes: int = 64_000_000) -> DataFrame:
    """``docs`` with a column ``out`` (it replaces one of that name): words, words hit, items, hit ranges in words and in characters."""
    spark = docs.sparkSession
    patterns = written(windows(benchmark, width), "windows")
    total = patterns.agg(F.coalesce(F.sum(F.length("pattern") + F.lit(64)), F.lit(0))).first()[0]
    shards = max(1, -(-total // max_pattern_bytes))
    frame = docs.withColumn(out, F.lit(None).cast(HITS))
    for shard in range(shards):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
        sent = spark.sparkContext.broadcast([(bytes(r["pattern"]), tuple(r["items"])) for r in part.toLocalIterator()])
        frame = frame.withColumn(out, _scanner(sent)(utf8(F.col(text_col)), F.col(out)))
        if shard < shards - 1:
            frame = written(frame, "scanned")
    return frame


def _scanner(sent):
    key = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def scan(text: pa.Array, found: pa.Array) -> pa.Array:
        automaton = _automaton(key, sent.value)
        before = found.to_pylist() if found.null_count < len(found) else [None] * len(found)
        return pa.array([_scan(t.as_py(), automaton, f) for t, f in zip(text, before)], _HITS_ARROW)

    return scan
