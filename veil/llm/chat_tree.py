"""Chat formatting (operator 5): conversations as prefix trees.

Conversations that begin with the same turns share them. Each distinct turn after a distinct beginning is a node, and its
tokens are written once, all nodes in depth-first order. A node has its place in that order (``start``), its first
position id (``position``: tokens of the turns before it) and ``subtree_end``: the tokens in ``[start, subtree_end)`` are the
ones that may attend to the node, so token t sees key k when ``start(k) <= t < subtree_end(k)`` and k is not behind t.

A turn is written as its text between the marks of its role. Control strings inside a text get a backslash behind
their first character, and backslashes are doubled, which reading undoes. The loss covers the texts of assistant turns.

A conversation is sorted by (turn, role, text), so equal turn numbers have a defined order; null text and null role are
empty; rows without a conv_id belong to no conversation and are left out. A conversation is one value, as
its hash chain needs its turns in order; conversations meet only through grouped and joined node rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.llm.common import shared_path, written

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, ["\\", *(m for pair in MARKS.values() for m in pair), *OTHER])))
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE (?P<role>(?:[^\\\]]|\\.)*)\](?P<other>.*?)\[/ROLE\]", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return OTHER[0] + escape(role).replace("]", "\\]") + "]", OTHER[1]


def parse(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import tokenizers

        _TOKENIZERS[path] = tokenizers.Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True  # their strings in a text are ordinary text
    return _TOKENIZERS[path]


def _paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns, path``: sorted turns and the node id of each."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    none = F.array().cast("array<string>")
    chain = F.aggregate("turns", none, lambda path, t: F.concat(path, F.array(F.sha2(F.concat(
        F.coalesce(F.get(path, F.size(path) - 1), F.lit("")), F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256))))
    return turns.withColumn("path", chain)


NODES = "node string, parent string, depth int, shard int, start_in_shard bigint, n_tokens bigint, body_from int, body_to int, loss boolean, tokens array<int>"


def _tokens(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Rows in the order they come, with their tokens and their place in the partition."""

    def encode(batches):
        bpe, start, shard = _tokenizer(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                head, tail = marks(r["role"])
                parts = [bpe.encode(p, add_special_tokens=False).ids for p in (head, escape(r["text"]), tail)]
                tokens = parts[0] + parts[1] + parts[2]
                out.append({"node": r["node"], "parent": r["parent"], "depth": r["depth"], "shard": shard, "start_in_shard": start, "n_tokens": len(tokens),
                            "body_from": len(parts[0]), "body_to": len(parts[0]) + len(parts[1]), "loss": r["role"] == "assistant", "tokens": tokens})
                start += len(tokens)
            yield pa.RecordBatch.from_pylist(out, _NODES_ARROW)

    return nodes.mapInArrow(encode, NODES)


_NODES_ARROW = pa.schema([("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("shard", pa.int32()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()),
                          ("body_from", pa.int32()), ("body_to", pa.int32()), ("loss", pa.bool_()), ("tokens", pa.list_(pa.int32()))])


def write_chat_trees(conversations: DataFrame, path: str, tokenizer: str) -> None:
    """Tables ``nodes``, ``paths`` (leaf, its nodes from the root) and ``leaves`` (conv_id, leaf) under ``path``."""
    convs = written(_paths(conversations).withColumn("leaf", F.element_at("path", -1)), "conversations")
    convs.select("conv_id", "leaf").write.parquet(f"{path}/leaves")
    # Depth-first order of the nodes is the order of the paths; a beginning sorts before what continues it.
    distinct = convs.groupBy("leaf").agg(F.first("turns").alias("turns"), F.first("path").alias("path"))
    ranked = written(distinct.repartitionByRange("path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id()), "ranked")
    ranked.select("leaf", "path").write.parquet(f"{path}/paths")
    steps = ranked.select("rank", "path", F.posexplode("turns").alias("depth", "t")).select(
        "rank", "depth", F.get("path", F.col("depth")).alias("node"), F.get("path", F.col("depth") - 1).alias("parent"), "t.role", "t.text")
    nodes = steps.groupBy("node").agg(F.min("rank").alias("rank"), *[F.first(c).alias(c) for c in ("parent", "depth", "role", "text")])
    placed = written(_tokens(nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth"), tokenizer), "nodes")

    shards = placed.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    started = placed.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base", "shard", "start_in_shard")

    walked = ranked.select("leaf", F.posexplode("path").alias("depth", "node")).join(started.select("node", "start", "n_tokens"), "node")
    down = Window.partitionBy("leaf").orderBy("depth")
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = walked.select("node", F.coalesce(F.sum("n_tokens").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("position"),
                          F.last(F.col("start") + F.col("n_tokens")).over(whole).alias("leaf_end"))
    ends = spans.groupBy("node").agg(F.max("leaf_end").alias("subtree_end"), F.min("position").alias("position"))
    started.join(ends, "node").write.parquet(f"{path}/nodes")


def read_conversations(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """``conv_id, turns, formatted, learned`` decoded from the token tables; ``learned``: texts under the loss mask."""

    def decode(batches):
        bpe = _tokenizer(tokenizer)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                formatted, learned = [], []
                for node in r["nodes"]:
                    a, b, ids = node["body_from"], node["body_to"], node["tokens"]
                    parts = [bpe.decode(part, skip_special_tokens=False) if part else "" for part in (ids[:a], ids[a:b], ids[b:])]
                    formatted += parts
                    if node["loss"]:
                        learned.append(unescape(parts[1]))
                turns = [{"role": role, "text": text} for role, text in parse("".join(formatted))]
                out.append({"leaf": r["leaf"], "turns": turns, "formatted": "".join(formatted), "learned": learned})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("leaf", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("formatted", pa.string()), ("learned", pa.list_(pa.string()))])
    nodes = spark.read.parquet(f"{path}/nodes").select("node", F.struct("depth", "body_from", "body_to", "loss", "tokens").alias("n"))
    steps = spark.read.parquet(f"{path}/paths").select("leaf", F.explode("path").alias("node")).join(nodes, "node")
    whole = steps.groupBy("leaf").agg(F.sort_array(F.collect_list("n")).alias("nodes"))
    decoded = whole.mapInArrow(decode, "leaf string, turns array<struct<role:string,text:string>>, formatted string, learned array<string>")
    return spark.read.parquet(f"{path}/leaves").join(written(decoded, "read-back"), "leaf").drop("leaf")


def chat_trees(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Write the trees to the shared folder and read the conversations back."""
    path = shared_path(conversations.sparkSession, "chat-trees")
    write_chat_trees(conversations, path, tokenizer)
    return read_conversations(conversations.sparkSession, path, tokenizer)
