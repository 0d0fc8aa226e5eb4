"""Queries on ``embeddings``: one an operator, with production parameters, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veil.llm.centroids import cluster_vectors
from veil.llm.common import table
from veil.llm.embedding_dedup import near_embeddings
from veil.llm.registry import query
from veil.llm.whitening import whiten

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query("op11_embedding_dedup", f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings WHERE {FINITE} AND len(embedding) > 0),
n AS MATERIALIZED (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.x LEFT JOIN counts ON e.vec_id = counts.x
""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return near_embeddings(table(spark, sf, "embeddings").select("vec_id", "embedding"), least=0.9)


def _lloyd_sql(rounds: int) -> str:
    """Round r assigns (a<r>) and moves the centroids (c<r+1>); a vector's choice is distance * 8 + number, so that ties go to the smaller one."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT id, vec_id, x, min(cast(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS bigint) * 8 + k) AS p FROM v, c{r} GROUP BY id, vec_id, x)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
      SELECT p % 8 AS k, i, cast(sum(x[i]) AS bigint) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY k) USING (k))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < 8),
{", ".join(steps)},
d AS (SELECT vec_id, p % 8 AS k, p // 8 AS distance FROM a{rounds})
SELECT vec_id, cast(d.k AS int) AS cluster, cast(distance AS bigint) AS distance, cast(sum(distance) OVER (PARTITION BY d.k) AS bigint) AS cluster_inertia,
  cast(sum(distance) OVER () AS bigint) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM d JOIN c{rounds} USING (k)
"""


@query("op12_centroids", _lloyd_sql(10))
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64, scale=1024, salt="3:")


# Eigenvectors are no SQL; tests compare with a brute-force decomposition.
@query("op13_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"), components=16, scale=64, shift=1_000_000)
