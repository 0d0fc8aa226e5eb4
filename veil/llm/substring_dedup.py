"""Substring deduplication (operator 8): suffix automata over shards of reference passages.

A word is removed when a window of ``width`` consecutive words covers it whose word sequence also starts in a
document of smaller id. An automaton over all reference text that every document streams through would cost
documents times shards; here a document meets only the shards that can hold its windows:

1. Each window selects the least of its ``GRAM``-word grams (grams of short words come last, then a hash decides), so
   equal windows select equal grams. Grams that one document alone selects are done with.
2. Neighbouring windows of one gram make a piece: ``width - 1`` words more than it has windows. The pieces of one repeated
   gram are a reference shard. In ascending order of their documents each streams through the suffix automaton of those
   before it, and its matching statistics show the windows that a smaller document has; then it is added. A piece equal
   to one of a smaller document is covered entirely.
3. The covered windows go back to their documents, and words under them are cut.

Both shuffles by gram are reduced before: of a gram (or piece) that several documents of one part of a partition share, only the
first goes to its shard. The others are settled where they are (such a gram is repeated, such a piece covered) and travel under their
own document's key. So a passage that a third of all documents share brings one row a part to a shard.
A gram with more than about ``hot`` pieces (a phrase that very many documents have with different words around it) has no shard: its
windows go one by one under the hash of all their words, so equal windows still meet and unlike ones spread over all tasks. These grams are
counted on a sample of one document in ``sample``; which ones are found decides where windows meet, not what is removed.
A shard of over ``SHARD_WORDS`` distinct words is continued in a further automaton, through which later pieces stream as well.

Null text has no words. Rows without an id lose nothing and are no source. Rows that share an id do not remove each
other's words; each of them is judged by its own text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import texts, utf8
from veil.llm.shingles import windows, words_of
from veil.llm.suffix_automaton import SuffixAutomaton

GRAM = 4
SHORT = 12  # letters of a gram; below that it is mostly function words
SHARD_WORDS = 200_000
HOT = 20_000  # pieces of a gram
SAMPLE = 64
_MOST = 16_000_000


def _pieces(values: list[bytes], width: int):
    """``doc, start, n, gram, begin, end`` of every piece: text number, first window, windows, gram hash, bytes in the joined texts."""
    hashes, begins, ends, offsets = words_of(values, fold=False)
    grams = windows(hashes, GRAM)
    n_windows = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(n_windows.sum())
    if total == 0:
        return [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=np.uint64)] + [np.zeros(0, dtype=np.int64)] * 2
    letters = np.concatenate(([0], np.cumsum(ends - begins)))
    short = (letters[GRAM:] - letters[:-GRAM]) < SHORT
    rank = (grams >> np.uint64(1)) | (short.astype(np.uint64) << np.uint64(63))
    span = width - GRAM + 1
    least = np.lib.stride_tricks.sliding_window_view(rank, span).argmin(axis=1)
    doc = np.repeat(np.arange(len(values)), n_windows)
    at = np.arange(total) - (np.cumsum(n_windows) - n_windows)[doc] + offsets[:-1][doc]
    place = at + least[at]
    new = np.ones(total, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, total))
    doc, at = doc[first], at[first]
    return doc, at - offsets[:-1][doc], n, grams[place[first]], begins[at], ends[at + n + width - 2]


def _parts(sizes: list[int]):
    """Ranges of a batch with a bounded number of bytes."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= _MOST):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def _spread(by: str):
    """Settled rows go by their document, the others to the shard of their gram."""
    return F.when(F.col("known"), F.xxhash64("doc_id")).otherwise(F.col(by))


def _repeated_grams(rows: DataFrame, width: int) -> DataFrame:
    """``doc_id, grams``: the selected grams of a document that others select, too (some more than once)."""

    def select(batches):
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), [v or b"" for v in batch.column(1).to_pylist()]
            for a, b in _parts(list(map(len, values))):
                doc, _, _, grams, _, _ = _pieces(values[a:b], width)
                order = np.lexsort((doc, grams))
                grams, doc = grams[order], doc[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
                grams, own = grams[new], ids[a:b][doc[new]]
                first = np.ones(len(grams), dtype=bool)
                first[1:] = grams[1:] != grams[:-1]
                group = np.cumsum(first) - 1
                shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else first
                yield pa.RecordBatch.from_pydict({
                    "gram": pa.array(np.concatenate((grams[first], grams[shared])).view(np.int64)),
                    "doc_id": pa.array(np.concatenate((own[first], own[shared])).astype(np.int64)),
                    "known": pa.array(np.concatenate((np.zeros(int(first.sum()), dtype=bool), np.ones(int(shared.sum()), dtype=bool))))})

    def repeated(batches):
        # The last row of a batch waits for the next one; ``met``: whether it equals the row before it.
        gram, doc, met = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
        for batch in batches:
            grams, ids, known = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            known = known.astype(bool)
            g, d = np.concatenate((gram, grams[~known])), np.concatenate((doc, ids[~known]))
            same = g[1:] == g[:-1]
            hit = np.append(same, False)
            hit[1:] |= same
            if len(hit):
                hit[0] |= met and len(gram) > 0
                gram, doc, met = g[-1:], d[-1:], bool(hit[-1])
                hit[-1] = False
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.concatenate((d[hit], ids[known]))), "gram": pa.array(np.concatenate((g[hit], grams[known])))})
        if met:
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "gram": pa.array(gram)})

    selected = rows.select("doc_id", utf8(F.col("text"))).mapInArrow(select, "gram bigint, doc_id bigint, known boolean")
    shards = selected.repartition(_spread("gram")).sortWithinPartitions("known", "gram")
    return shards.mapInArrow(repeated, "doc_id bigint, gram bigint").groupBy("doc_id").agg(F.collect_list("gram").alias("grams"))


def _hot_grams(rows: DataFrame, width: int, hot: int, sample: int) -> list[int]:
    """Sorted grams with more than ``hot`` pieces, as one document in ``sample`` tells."""

    def select(batches):
        for batch in batches:
            values = [v or b"" for v in batch.column(0).to_pylist()]
            for a, b in _parts(list(map(len, values))):
                grams, n = np.unique(_pieces(values[a:b], width)[3], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    some = rows.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id", "version"), F.lit(sample)) == 0)
    counted = some.select(utf8(F.col("text"))).mapInArrow(select, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return sorted(r["gram"] for r in counted.where(F.col("n") * sample > hot).select("gram").collect())


def _key(words: bytes) -> int:
    return int.from_bytes(blake2b(words, digest_size=8).digest(), "little", signed=True)


PIECES = "gram bigint, doc_id bigint, version bigint, start int, n int, words binary, known boolean"


def _repeated_pieces(rows: DataFrame, width: int, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    split = frozenset(_hot_grams(rows, width, hot, sample))

    def cut(batches):
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values, grams_of = [v or b"" for v in batch.column(2).to_pylist()], batch.column(3)
            for a, b in _parts(list(map(len, values))):
                doc, start, n, gram, begin, end = _pieces(values[a:b], width)
                joined = b"\n".join(values[a:b])
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                out: list[tuple] = []
                first: dict[tuple, int] = {}
                for i in sorted(range(b - a), key=lambda i: ids[a + i]):
                    x, y = edges[i], edges[i + 1]
                    found = np.flatnonzero(np.isin(gram[x:y].view(np.int64), grams_of[a + i].values.to_numpy())) + x
                    own = ids[a + i]
                    for g, s, k, p, q in zip(gram[found].view(np.int64).tolist(), start[found].tolist(), n[found].tolist(), begin[found].tolist(), end[found].tolist()):
                        words = joined[p:q].split()
                        if g in split:
                            runs = [b" ".join(words[j:j + width]) for j in range(k)]
                            parts = [(_key(run), s + j, 1, run) for j, run in enumerate(runs)]
                        else:
                            parts = [(g, s, k, b" ".join(words))]
                        for key, at, size, run in parts:
                            known = first.setdefault((key, run), own) < own
                            out.append((key, own, versions[a + i], at, size, None if known else run, known))
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES)], names=["gram", "doc_id", "version", "start", "n", "words", "known"])

    # The same join at every size, and the one that puts the cuts back uses the same exchange of the texts.
    wanted = rows.hint("merge").join(_repeated_grams(rows, width), "doc_id")
    return wanted.select("doc_id", "version", utf8(F.col("text")).alias("text"), "grams").mapInArrow(cut, PIECES)


_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
RANGES = "doc_id bigint, version bigint, first int, last int"


class _Shard:
    """The pieces of one gram, in ascending order of their documents."""

    def __init__(self, width: int):
        self.width = width
        self.seen: dict[bytes, tuple[int, list[int]]] = {}
        self.waiting: list[tuple[list[bytes], int]] = []
        self.automata: list[SuffixAutomaton] = []

    def covered(self, text: bytes, doc: int, n: int) -> list[tuple[int, int]]:
        """First and last of the piece's windows that a smaller document has."""
        known = self.seen.get(text)
        if known is None:
            while self.waiting and self.waiting[0][1] < doc:
                if not self.automata or self.automata[-1].words > SHARD_WORDS:
                    self.automata.append(SuffixAutomaton())
                self.automata[-1].add(self.waiting.pop(0)[0])
            words = text.split(b" ")
            hits = sorted({k - self.width + 1 for a in self.automata for k, size in enumerate(a.matches(words)) if size >= self.width})
            known = self.seen[text] = (doc, [(k, k) for k in hits])
            self.waiting.append((words, doc))
        return [(0, n - 1)] if known[0] < doc else known[1]


def _covered(width: int):
    def stream(batches):
        key, shard = None, _Shard(width)
        for batch in batches:
            out: list[tuple] = []
            for gram, doc_id, version, start, n, words, known in zip(*[c.to_pylist() for c in batch.columns]):
                if known:
                    out.append((doc_id, version, start, start + n - 1))
                    continue
                if gram != key:
                    key, shard = gram, _Shard(width)
                out += [(doc_id, version, start + a, start + b) for a, b in shard.covered(words, doc_id, n)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES[1:5])], names=["doc_id", "version", "first", "last"])

    return stream


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, n_removed, text`` of every row; ``text``: the words that are left, joined by one blank."""
    named = texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    rows = named.where("doc_id IS NOT NULL")
    shards = _repeated_pieces(rows, width, hot, sample).repartition(_spread("gram")).sortWithinPartitions("known", "gram", "doc_id")
    cuts = shards.mapInArrow(_covered(width), RANGES).groupBy("doc_id").agg(F.collect_list(F.struct("version", "first", "last")).alias("cuts"))

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,text:string>")
    def cut(text: pa.Array, version: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for value, own, found in zip(text, version, cuts):
            words = (value.as_py() or b"").split()
            n, ranges = len(words), [r for r in found.as_py() or [] if r["version"] == own.as_py()]
            if ranges:
                gone = np.zeros(n + 1, dtype=np.int64)
                for r in ranges:
                    gone[r["first"]] += 1
                    gone[r["last"] + width] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:n]) == 0).tolist()]
            out.append({"n_words": n, "n_removed": n - len(words), "text": b" ".join(words).decode("utf-8", "replace")})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))

    joined = rows.hint("merge").join(cuts, "doc_id", "left").select("doc_id", "text", "version", "cuts")
    nameless = named.where("doc_id IS NULL").select("doc_id", "text", "version", F.lit(None).cast(joined.schema["cuts"].dataType).alias("cuts"))
    return joined.unionByName(nameless).select("doc_id", cut(utf8(F.col("text")), F.col("version"), F.col("cuts")).alias("c")).select("doc_id", "c.n_words", "c.n_removed", "c.text")
