"""Centroid clustering (operator 12): Lloyd rounds over integer vectors with scalar lookup tables.

Vectors of ``dims`` finite components become integers floor(``scale`` * x) once, and are written as blocks of up to
``BLOCK`` vectors: for each dimension the integers that occur in the block, and for each vector their positions. A round
tabulates (integer - centroid component)^2 for every dimension, occurring integer and centroid of a block; a distance is then a
sum of ``dims`` table entries, gathered by position. Tasks return sums and counts by centroid, which Spark adds up as decimals, so
every mean is the exact floor of sum over count. The driver holds the centroids and nothing else; a block's table is
made for as many centroids at a time as ``TABLE_CELLS`` allows.

Ties go to the smaller number. Equal vectors all count. Rows without an id are clustered, but are never an initial centroid
before rows with one; rows that share an id start in the order of their vectors. With fewer than ``k`` vectors there
are as many centroids as vectors, without vectors no rows. Integers are held within +-2^62 and distances at 2^63 - 1 at most.
Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import written
from veil.llm.vectors import finite, list_array

BLOCK = 4096
TABLE_CELLS = 4_000_000
HOLD, MOST = 1 << 62, (1 << 63) - 1
BLOCKS = "ids array<bigint>, codes binary, sizes array<int>, integers array<bigint>"


def _integers(vector: Column, scale: int) -> Column:
    hold = F.lit(float(HOLD))
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))).cast("double"), hold), -hold).cast("long"))


def _blocks(kept: DataFrame, dims: int) -> DataFrame:
    """``kept``: vec_id, x. The blocks of the vectors, integers coded by dimension."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
                codes = np.column_stack([c.ravel() for _, c in found]).astype("<u2")
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "codes": pa.array([codes.tobytes()], pa.binary()),
                    "sizes": pa.array([[len(v) for v, _ in found]], pa.list_(pa.int32())), "integers": list_array(np.concatenate([v for v, _ in found])[None, :])})

    return kept.mapInArrow(code, BLOCKS)


def _nearest(codes: np.ndarray, values: list[np.ndarray], centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector of a block."""
    edges = [(min(int(v[0]), *(c[d] for c in centroids)), max(int(v[-1]), *(c[d] for c in centroids))) for d, v in enumerate(values)]
    # Within 64 bits where the largest distance there can be fits; else in Python's integers.
    kind = np.int64 if sum((b - a) ** 2 for a, b in edges) <= MOST else object
    cluster, least = np.zeros(len(codes), dtype=np.int32), None
    step = max(1, TABLE_CELLS // sum(map(len, values)))
    for first in range(0, len(centroids), step):
        some = np.array(centroids[first:first + step], dtype=kind)
        distance = np.zeros((len(codes), len(some)), dtype=kind)
        for d, v in enumerate(values):
            gap = v.astype(kind)[:, None] - some[None, :, d]
            distance += (gap * gap)[codes[:, d]]
        best = distance.argmin(axis=1)
        lowest = distance[np.arange(len(codes)), best]
        if least is None:
            cluster, least = (best + first).astype(np.int32), lowest
        else:
            better = (lowest < least).astype(bool)
            cluster[better], least[better] = best[better] + first, lowest[better]
    return cluster, least


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            sizes = batch.column(2)[k].as_py()
            codes = np.frombuffer(batch.column(1)[k].as_py(), dtype="<u2").reshape(-1, len(sizes))
            values = np.split(batch.column(3)[k].values.to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
            yield batch.column(0)[k], codes, values, *_nearest(codes, values, centroids)


def _round(centroids: list[list[int]]) -> Callable:
    """Counts and sums by centroid of a task's vectors."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [0] * len(centroids), np.zeros((len(centroids), len(centroids[0])), dtype=object)
        for _, codes, values, cluster, _ in _assigned(batches, centroids):
            order = np.argsort(cluster, kind="stable")
            there, starts, counts = np.unique(cluster[order], return_index=True, return_counts=True)
            kind = np.int64 if max(int(abs(v).max()) for v in values) * len(codes) <= MOST else object
            x = np.column_stack([v.astype(kind)[codes[:, d]] for d, v in enumerate(values)])[order]
            part = np.add.reduceat(x, starts, axis=0)
            for i, c in enumerate(there):
                n[c] += int(counts[i])
                sums[c] += part[i].astype(object)
        some = [c for c in range(len(centroids)) if n[c]]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(some, pa.int32()), "n": pa.array([n[c] for c in some], pa.int64()),
            "sums": pa.array([[Decimal(int(s)) for s in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0)))})

    return add


def _distances(centroids: list[list[int]]) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, cluster, least in _assigned(batches, centroids):
            held = least if least.dtype == np.int64 else np.array([min(int(v), MOST) for v in least], dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"vec_id": ids.values, "cluster": pa.array(cluster), "distance": pa.array(held)})

    return judge


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector of ``dims`` finite components.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``salt`` and id.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where((F.size("vector") == dims) & finite(F.col("vector")))
    kept = rows.select(F.col("vec_id").cast("long"), _integers(F.col("vector"), scale).alias("x"))
    start = kept.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("drawn"), "x").orderBy(F.asc_nulls_last("drawn"), "x").limit(k)
    centroids = [list(r["x"]) for r in start.collect()]
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where("false")
    blocks = written(_blocks(kept, dims), "vector-blocks")
    for _ in range(rounds):
        parts = blocks.mapInArrow(_round(centroids), "cluster int, n bigint, sums array<decimal(38,0)>")
        added = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
        before = [list(c) for c in centroids]
        for r in added.collect():  # k * dims numbers
            centroids[r["cluster"]][r["d"]] = int(r["s"]) // r["n"]
        if centroids == before:  # every later round would give the same
            break
    judged = blocks.mapInArrow(_distances(centroids), "vec_id bigint, cluster int, distance bigint")
    inertia = {r["cluster"]: min(int(r["s"]), MOST) for r in judged.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    each = [inertia.get(c, 0) for c in range(len(centroids))]
    return judged.select("vec_id", "cluster", "distance", of(each).cast("long").alias("cluster_inertia"), F.lit(min(sum(each), MOST)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))
