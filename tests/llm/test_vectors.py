"""Operators on embeddings against brute-force versions."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from veil.llm import embedding_dedup, whitening
from veil.llm.centroids import cluster_vectors
from veil.llm.embedding_dedup import near_embeddings, plan_tables
from veil.llm.spectrum import add_outer, add_spectrum, empty
from veil.llm.whitening import whiten

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind=FloatType()):
    # The further columns have names that the operators use, too.
    fields = [("vec_id", LongType()), ("embedding", ArrayType(kind)), ("n", StringType()), ("cluster", StringType()), ("id", StringType()), ("x", StringType())]
    schema = StructType([StructField(n, t) for n, t in fields])
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], schema)


def clusters_of_copies(rng, d=64):
    """Tight and loose groups, copies, a chain and noise."""
    rows = [list(map(float, v)) for v in rng.normal(size=(150, d))]
    for spread, size in ((0.02, 180), (0.2, 60), (0.27, 60)):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            noise = rng.normal(size=d)
            rows.append(list(centre + spread * rng.uniform(0.5, 1.2) * noise / np.linalg.norm(noise)))
    one, two = rng.normal(size=(2, d))
    for k in range(9):  # each linked to the next few only
        rows.append(list(math.cos(k / 4) * one / np.linalg.norm(one) + math.sin(k / 4) * two / np.linalg.norm(two)))
    rows += [rows[160]] * 40 + [[3 * x for x in rows[170]]]
    rng.shuffle(rows)
    return [(k, v) for k, v in enumerate(rows)]


def linked_by_force(rows, least=0.9):
    sound = [(k, np.array(v, dtype=float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for a, x in sound:
        for b, y in sound:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                near[a].append(b)
    out = []
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((rows[k][0], len(near[k]), min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *[(x is None, x) for x in r]))


def test_links_and_components(spark):
    rows = clusters_of_copies(np.random.default_rng(5))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    got = near_embeddings(frame(spark, rows)).collect()
    assert by_id(r[:3] for r in got) == by_id(linked_by_force(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_small_buckets_make_groups_that_meet(spark, monkeypatch):
    """Many groups, settled with each other member by member in several blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in clusters_of_copies(np.random.default_rng(6), d=16)]
    got = near_embeddings(frame(spark, rows), bucket=2, miss=1e-7).collect()
    assert by_id(r[:3] for r in got) == by_id(linked_by_force(rows))


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, NAN]), (6, [1.0, INF]), (7, [None, 1.0]), (8, [1.0, 1.0]), (9, [2.0, 2.0]), (10, [1.0, 1.0, 0.0]),
            (None, [1.0, 1.0]), (12, [1.0, 0.0]), (12, [1.0, 0.01]), (13, [-0.0, 5.0]), (14, [0.0, 5.0]), (None, [-3.0, 1.0]), (None, None), (15, [1e300, 1e300]), (16, [1e-300, 1e-300])]
    got = near_embeddings(frame(spark, rows, DoubleType())).collect()
    want = linked_by_force([(i, None if v is None or None in v else [x / max(map(abs, v)) if v and max(map(abs, v)) not in (0, INF) else x for x in v]) for i, v in rows])
    want = [(i, n, i if n == 0 else c) for i, n, c in want]
    assert by_id(r[:3] for r in got) == by_id(want)
    assert near_embeddings(frame(spark, [])).collect() == []


def test_tables_follow_the_bound():
    for n in (1, 100, 10 ** 6, 10 ** 10):
        bits, tables = plan_tables(n, 0.9, 16, 1e-4)
        assert n / 2 ** bits <= 16 and (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= 1e-4


def lloyd(rows, k=8, rounds=10, dims=64, scale=1024, salt="3:"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(x) for _, x in drawn[:k]]

    def assign():
        out = []
        for _, x in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((distances.index(min(distances)), min(distances)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [x for (_, x), (a, _) in zip(kept, found) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    each = [sum(d for a, d in found if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, a, d, each[a], sum(each), digest[a]) for (i, _), (a, d) in zip(kept, found)]


def test_rounds_are_exact(spark, monkeypatch):
    from veil.llm import centroids

    monkeypatch.setattr(centroids, "BLOCK", 50)
    monkeypatch.setattr(centroids, "TABLE_CELLS", 100)  # a few centroids at a time
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(400), rng.normal(size=(400, 6)))]
    rows += [(500 + i, rows[0][1]) for i in range(80)] + [(600, None), (601, [1.0]), (602, [NAN] * 6), (603, [None] * 6), (None, rows[3][1]), (3, rows[4][1])]
    assert by_id(cluster_vectors(frame(spark, rows), dims=6).collect()) == by_id(lloyd(rows, dims=6))


def test_large_integers_ties_and_few_vectors(spark):
    large = [(i, [float(s) * 2.0 ** 18, float(i)]) for i, s in enumerate([1, -1, 0, 1, -1, 3])]
    assert by_id(cluster_vectors(frame(spark, large, DoubleType()), k=3, dims=2).collect()) == by_id(lloyd(large, k=3, dims=2))
    even = [(1, [0.0]), (2, [2.0]), (3, [1.0]), (4, [1.0])]  # in the middle of two centroids
    assert by_id(cluster_vectors(frame(spark, even), k=2, dims=1).collect()) == by_id(lloyd(even, k=2, dims=1))
    assert by_id(cluster_vectors(frame(spark, even[:2]), dims=1).collect()) == by_id(lloyd(even[:2], dims=1))
    assert cluster_vectors(frame(spark, [(1, None)])).collect() == []
    held = cluster_vectors(frame(spark, [(1, [1e300]), (2, [-1e300])], DoubleType()), k=1, dims=1).collect()
    assert max(r["distance"] for r in held) == 2 ** 63 - 1


def whitened_by_force(rows, components=16, scale=64, shift=1_000_000):
    kept = [(i, [math.floor(scale * float(c)) + shift for c in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(x) for _, x in kept]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    out = {}
    for i, x in kept:
        gaps = [n * a - s for a, s in zip(x, sums)]
        white = (np.array([g / n for g in gaps]) @ basis)[:components] / np.sqrt(np.abs(values[:components]))
        out.setdefault(i, []).append((sum(g * g for g in gaps), white))
    return n, out, values / values.sum()


@pytest.mark.parametrize("partitions", [1, 23])
def test_whitening_by_force(spark, partitions):
    rng = np.random.default_rng(2)
    spread = np.exp(-np.arange(20) / 4)
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rng.normal(size=(700, 20)) @ np.linalg.qr(rng.normal(size=(20, 20)))[0] * spread)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)] + [(2000, None), (2001, []), (2002, [NAN] * 20), (2003, [None] * 20), (2004, [INF] * 20), (2005, [1.0, 2.0]), (None, rows[7][1])]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whiten(frame(spark, rows), components=16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    n, want, explained = whitened_by_force(rows)
    assert len(got) == 16 * sum(map(len, want.values())) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        deviation, white = want[r["vec_id"]][0]
        c = r["component"]
        assert r["deviation"] == deviation and abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(white[c - 1]) > 1e-3:
            signs.setdefault(c, np.sign(r["whitened"]) * np.sign(white[c - 1]))
            assert abs(r["whitened"] - signs[c] * white[c - 1]) < 1e-8
    assert len(signs) == 16


def test_whitening_without_variance(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whiten(frame(spark, [(k, [float(k), 5.0, float(-k)]) for k in range(6)])).collect()  # one direction
    assert {r["component"] for r in flat} == {1} and abs(sum(r["whitened"] ** 2 for r in flat) / 6 - 1) < 1e-12
    huge = whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], DoubleType())).collect()
    assert huge and all(r["deviation"] == 2 ** 63 - 1 for r in huge if r["vec_id"] != 3)


def test_rank_one_updates():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        for x in (rng.normal(size=(90, d)), np.round(rng.normal(size=(90, d))), np.repeat(rng.normal(size=(4, d)), 20, axis=0), rng.normal(size=(60, d)) * (np.arange(d) < d / 2)):
            halves = []
            for part in (x[: len(x) // 2], x[len(x) // 2:]):
                found = empty(d)
                for v in part:
                    found = add_outer(*found, v)
                halves.append(found)
            values, vectors = add_spectrum(*halves)
            whole = x.T @ x
            assert np.abs(vectors * values @ vectors.T - whole).max() <= 1e-12 * max(1.0, np.abs(whole).max())
            assert np.abs(vectors.T @ vectors - np.eye(d)).max() <= 1e-12


def test_spectra_do_not_meet_in_one_group(spark):
    """At most ``FAN`` spectra are combined at a time."""
    rng = np.random.default_rng(4)
    x = spark.createDataFrame([(list(map(int, v)),) for v in rng.integers(-50, 50, size=(64, 3))], "x array<bigint>").repartition(40)
    spectra = whitening._spectra(x, 3, 64, [0, 0, 0])
    first = whitening._combined(spectra, 3)
    assert first.count() == -(-spectra.count() // whitening.FAN) or first.count() <= 5
