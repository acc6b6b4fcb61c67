"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import centroids, collisions, topk
from spanloom.llm.common import table


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_copies(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def rounds_sql(rounds: int = 5, clusters: int = 40, dim: int = 64) -> str:
    """Lloyd's rounds, each a pair of CTEs: the assignment and the centroids it leads to."""
    parts = [
        f"""WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS k, v
  FROM kept QUALIFY k < {clusters})"""
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT p.vec_id, p.v, c.k, CAST(list_sum(list_transform(range(1, {dim} + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d
  FROM kept p CROSS JOIN c{n} c
  QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY d, c.k) = 1)""")
        if n < rounds:
            parts.append(f"""m{n} AS (
  SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM (SELECT k, unnest(range(1, {dim} + 1)) AS i, unnest(v) AS x FROM a{n}) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v
  FROM c{n} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS v FROM m{n} GROUP BY k) m ON m.k = c.k)""")
    return (
        ",\n".join(parts)
        + f"""
SELECT a.vec_id, a.k AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""
    )


QUERIES = {"op7_top_k": op7_top_k, "op11_near_copies": op11_near_copies, "op13_centroids": op13_centroids}
SQL = {
    "op13_centroids": rounds_sql(),
    "op11_near_copies": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
of AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, of.component_id, e.vec_id = of.component_id AS kept
FROM embeddings e JOIN of ON of.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op7_top_k": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""
}
