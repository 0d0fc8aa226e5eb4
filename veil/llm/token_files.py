"""Token ids in word-aligned blocks (operator 10).

A block holds whole documents, about ``BLOCK_IDS`` ids, as 64-bit words. The top four bits of a word
select how many ids share its other 60 bits; an id of more than 60 bits takes an escape word and one raw
word, and the block's head names the raw words, so that a reader can decode all words of one selector at
once. Blocks are rows of a Parquet table (payload, document ids, ids per document, place in the shard), so
any store that Spark writes can hold them and a failed task leaves nothing behind.

Order: ascending doc_id, rows with a null id first, rows that share an id in any order. A null text is an
empty one and yields just the end id.
"""

from __future__ import annotations

import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.common import texts

# ids in a word by selector; the selector is the place in this list. 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK_IDS = 1 << 16
CACHE_WORDS = 250_000
SLICE_BYTES = 1 << 20
BLOCK_SCHEMA = ("shard int, block int, start_in_shard bigint, doc_ids array<bigint>, counts array<bigint>, n_ids bigint, payload binary")


def encode(ids: np.ndarray) -> bytes:
    """Ids of up to 64 bits as one block payload."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return struct.pack("<III4x", 0, 0, 0)
    # Bits needed; the float may round a value of over 53 bits up, never down.
    need = np.zeros(n + COUNTS[0], dtype=np.uint8)
    need[:n] = np.frexp(ids.astype(np.float64))[1]
    padded = np.zeros(n + COUNTS[0], dtype=np.uint64)
    padded[:n] = ids
    take = np.zeros(n, dtype=np.uint8)
    widest, power = {1: need}, 1
    for count in reversed(COUNTS):
        while power * 2 <= count:
            half = widest[power]
            widest[power * 2] = np.maximum(half[:-power], half[power:])
            power *= 2
        run = widest[power]
        shift = count - power
        fits = np.maximum(run[:n], run[shift:shift + n]) <= 60 // count
        if not fits.any():
            break
        take[fits] = count
    steps, starts, at = take.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += steps[at] or 1
    first = np.array(starts, dtype=np.int64)
    count_at = take[first]
    escaped = count_at == 0
    place = np.arange(len(first)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(first) + int(escaped.sum()), dtype=np.uint64)
    for selector, count in enumerate(COUNTS):
        rows = np.flatnonzero(count_at == count)
        if len(rows) == 0:
            continue
        word = np.full(len(rows), selector << 60, dtype=np.uint64)
        for j in range(count):
            word |= padded[first[rows] + j] << np.uint64(60 // count * j)
        words[place[rows]] = word
    raw = place[escaped] + 1
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[raw] = ids[first[escaped]]
    return struct.pack("<III4x", n, len(words), len(raw)) + raw.astype("<u4").tobytes() + b"\0" * (4 * (len(raw) % 2)) + words.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    """All ids of a block, decoded selector by selector."""
    n, n_words, n_raw = struct.unpack_from("<III", payload)
    raw = np.frombuffer(payload, dtype="<u4", count=n_raw, offset=16)
    words = np.frombuffer(payload, dtype="<u8", count=n_words, offset=16 + 4 * (n_raw + n_raw % 2))
    selector = (words >> np.uint64(60)).astype(np.int64)
    selector[raw] = -1
    per = np.zeros(n_words, dtype=np.int64)
    for s, count in enumerate(COUNTS):
        per[selector == s] = count
    per[selector == ESCAPE] = 1
    begin = np.cumsum(per) - per
    out = np.zeros(n + COUNTS[0], dtype=np.uint64)
    for s, count in enumerate(COUNTS):
        rows = np.flatnonzero(selector == s)
        if len(rows) == 0:
            continue
        bits = 60 // count
        mask = np.uint64((1 << bits) - 1)
        # The last word of a block may hold padding; it lands behind n.
        for j in range(count):
            out[begin[rows] + j] = (words[rows] >> np.uint64(bits * j)) & mask
    out[begin[raw.astype(np.int64) - 1]] = words[raw]
    return out[:n]


# Latin letters, of which each is one character in every normal form and in lower case, and a run of marks behind them: neither
# an apostrophe, which begins a short form, nor what begins or ends a control token.
_PLAIN = r'^(?P<body>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)$'
_LOWER = re.compile("[a-zß-öø-ÿ]+")
# Arrow, as Python, also splits at these four, which the tokenizer does not hold for white space.
_ODD = "[\x1c-\x1f]"


class WordIds(dict):
    """Ids (uint32 bytes) of a word, kept for the words seen lately.

    The tokenizers this fits (``_fits`` tries them) never join characters over white space, lower case, and part a
    letter from the punctuation behind it, so a text's ids are its words' ids, and a word of plain small letters goes straight
    to the tokenizer's model. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.before: dict[str, bytes] = {}  # what was kept when it was last full
        letters = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.by_word = self._fits()

    def _fits(self) -> bool:
        """Whether the shortcuts give what the tokenizer gives, on words of every kind they tell apart."""
        text = "Word one,\n\tWORD Two! a.b état ÉTÉ: straße don't x1 so*** (it).\" A_-"
        if "Lowercase" not in str(self.tokenizer.normalizer) or self.tokenizer.model is None:
            return False
        return self._by_word(pa.array([text]))[0].tobytes() == self.encoded(text)

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is not None:
            pass
        elif _LOWER.fullmatch(word):
            mapped = word if word.isascii() else word.translate(self.mapped)
            ids = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
        else:
            ids = self.encoded(word)
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _by_word(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``values`` in a row and where each value's ids end. Only words that differ are looked up."""
        words = pc.utf8_split_whitespace(values)
        coded = words.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, _PLAIN)
        body = pc.coalesce(pc.utf8_lower(pc.struct_field(found, "body")), coded.dictionary).dictionary_encode()
        marks = pc.coalesce(pc.struct_field(found, "marks"), "").dictionary_encode()
        pieces = [self[w] for part in (body, marks) for w in part.dictionary.to_numpy(zero_copy_only=False)]
        order = np.column_stack([body.indices.to_numpy(), marks.indices.to_numpy() + len(body.dictionary)]).ravel()
        ids, ends = _gathered(np.frombuffer(b"".join(pieces), dtype="<u4"), np.cumsum([len(p) // 4 for p in pieces], dtype=np.int64), order)
        ids, ends = _gathered(ids, ends[1::2], coded.indices.to_numpy())
        return ids, np.append(0, ends)[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def of(self, values: pa.Array) -> list[bytes]:
        """Ids of each of ``values``; null is empty."""
        values = pc.fill_null(values, "")
        if not self.by_word:
            return [self.encoded(v.as_py()) for v in values]
        odd = pc.match_substring_regex(values, _ODD)
        ids, ends = self._by_word(pc.if_else(odd, "", values))
        begins = np.append(0, ends[:-1])
        return [self.encoded(v.as_py()) if o else ids[a:b].tobytes() for v, o, a, b in zip(values, odd.to_pylist(), begins, ends)]


def _gathered(values: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that end at ``ends``, taken in ``order``, and where they end now."""
    size = np.diff(ends, prepend=0)
    taken = size[order]
    to = np.cumsum(taken)
    places = np.arange(to[-1] if len(to) else 0) + np.repeat((ends - size)[order] - (to - taken), taken)
    return values[places], to


def _slices(batch: pa.RecordBatch):
    """Rows of about ``SLICE_BYTES`` of text at a time; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
        yield batch.slice(int(a), int(b - a))


_WORDS: dict[str, WordIds] = {}


def _block(shard: int, block: int, start: int, ids: list, counts: list[int], parts: list[bytes]) -> pa.RecordBatch:
    values = np.frombuffer(b"".join(parts), dtype="<u4")
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start_in_shard": pa.array([start], pa.int64()),
        "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
        "n_ids": pa.array([len(values)], pa.int64()), "payload": pa.array([encode(values)], pa.binary())})


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Tokenize ``docs`` and write them to ``path`` in ascending id order, each followed by ``end_id``.

    ``tokenizer`` is a path that every executor can open. One shuffle, by id ranges; a range is one shard.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def blocks(batches):
        words = _WORDS.get(tokenizer)
        if words is None:
            words = _WORDS[tokenizer] = WordIds(tokenizer)
        shard = TaskContext.get().partitionId()
        block = start = size = 0
        ids: list = []
        counts: list[int] = []
        parts: list[bytes] = []
        for rows in (rows for batch in batches for rows in _slices(batch)):
            for doc_id, part in zip(rows.column(0).to_pylist(), words.of(rows.column(1))):
                part += end
                ids.append(doc_id)
                counts.append(len(part) // 4)
                parts.append(part)
                size += counts[-1]
                if size >= block_ids:
                    yield _block(shard, block, start, ids, counts, parts)
                    block, start, size, ids, counts, parts = block + 1, start + size, 0, [], [], []
        if ids:
            yield _block(shard, block, start, ids, counts, parts)

    frame = texts(docs, id_col, text_col)
    frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document in the files.

    ``start`` counts the ids of all documents before it. Shards follow each other by their first id; their sizes, one row
    a shard, are all that is summed in one place.
    """

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"]).astype("<u4")
                counts = np.array(row["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                begins = ends - counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(begins + row["base"] + row["start_in_shard"], pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())})

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("size"), F.min(F.when(F.col("block") == 0, F.get("doc_ids", F.lit(0)))).alias("first"))
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    rows = blocks.join(F.broadcast(bases), "shard").select("base", "start_in_shard", "doc_ids", "counts", "payload")
    return rows.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
