"""The pipeline stage by stage, each held against a brute-force version on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import AWKWARD, brute_components, windows_of
from veil.llm.common import table, written
from veil.llm.queries import ORACLES, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (rows in, rows out), from all documents and some awkward ones."""
    docs = table(spark, SF, "documents")
    odd = [(None if i is None else 10_000 + i, t, None, None, None) for i, t in AWKWARD]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out, rows = {}, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, docs, SF)
        if name != "token_output":
            assert frame.columns == docs.columns
        docs = written(frame, name)
        after = [tuple(r) for r in docs.collect()]
        out[name] = (rows, after)
        rows = after
    return out


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "token_output"]
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(ORACLES) <= set(QUERIES)


def test_language_keeps_every_text_with_letters(stages):
    before, after = stages["language"]
    assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))


def test_near_copies_go_but_the_first(stages):
    before, after = stages["near_dedup"]
    kept = brute_components([r[:2] for r in before], 5, 80)
    assert Counter(after) == Counter(r for r, k in zip(before, kept) if k[3])
    assert len(after) < len(before)


def test_rows_with_benchmark_passages_go(spark, stages):
    before, after = stages["decontamination"]
    patterns = {w for r in table(spark, SF, "benchmark").collect() for w in windows_of(r["text"], 10)[1]}

    def hit(text):
        words, _ = windows_of(text, 10)
        return any(tuple(words[i:i + n]) in patterns for n in {len(p) for p in patterns} for i in range(len(words) - n + 1))

    assert Counter(after) == Counter(r for r in before if not hit(r[1]))


def test_mixing_thins_out_toxic_rows_only(spark, stages):
    before, after = stages["mixing"]
    copies = Counter(after)
    assert set(after) <= set(before)
    labels = {r["doc_id"]: r for r in table(spark, SF, "labels").collect()}
    clean = [r for r in before if r[0] in labels and labels[r[0]]["toxic"] == 0]
    toxic = [r for r in before if r[0] in labels and labels[r[0]]["toxic"] == 1]
    assert np.mean([copies[r] >= 1 for r in clean]) >= 0.97
    assert sum(copies[r] for r in toxic) < 0.5 * len(toxic)


def test_mixing_keeps_clean_rows_when_most_are_of_low_quality(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    low = docs.join(labels.where("quality = 0 AND toxic = 0").select("doc_id").distinct(), "doc_id").select(docs.columns)
    more = low.crossJoin(spark.range(1, 16).withColumnRenamed("id", "k")).withColumn("doc_id", F.expr("doc_id + 1000000 * k")).select(docs.columns)
    before = written(docs.unionByName(more), "much-low")
    kept = {r[0] for r in corpus_pipeline.mixing(spark, before, "/root/testdata/sf0.01").select("doc_id").collect()}
    toxic = {r[0] for r in labels.where("toxic = 1").select("doc_id").collect()} & {r[0] for r in docs.select("doc_id").collect()}
    clean = [r[0] for r in more.select("doc_id").collect()] + [r[0] for r in docs.join(labels.where("toxic = 0"), "doc_id").select("doc_id").collect()]
    assert more.count() > 500 and np.mean([i in kept for i in clean]) >= 0.97
    assert len(toxic & kept) < 0.5 * len(toxic)


def test_tokens_read_back(stages):
    before, after = stages["token_output"]
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    after, at = sorted(after, key=lambda r: r[1]), 0
    assert [r[0] for r in after] == sorted((r[0] for r in before), key=lambda i: (i is not None, i or 0))
    wanted = Counter()
    for r in before:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        wanted[(r[0], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r[0], r[2], r[3]) for r in after) == wanted
    for r in after:
        assert r[1] == at
        at += r[2]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_batches_and_text_groups_are_small(spark, stages):
    import pyarrow as pa

    from veil.llm.common import BATCH_BYTES
    from veil.llm.near_dedup import _text_groups

    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": [b"x" * 500_000, None, *[b"y" * 900_000] * 6, b"z" * 5_000_000]})
    parts = list(_text_groups(batch))
    assert [i for ids, _ in parts for i in ids] == list(range(9))
    assert all(len(ids) == 1 or sum(map(len, values)) <= 2_000_000 for ids, values in parts)
