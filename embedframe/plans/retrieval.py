"""Retrieval: ladder, exact k-NN, recall and the benchmark summary."""

from __future__ import annotations


from ..operators import knn as K
from ..sources.tables import table

DIMS = (64, 32, 16, 8)
K_NEIGHBOURS = 10


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


PRECISIONS = ("float32", "float16", "binary")


def retrieval_benchmark(spark, sf):
    return K.retrieval_benchmark(_emb(spark, sf), DIMS, K_NEIGHBOURS, precisions=PRECISIONS)


# DuckDB pieces shared by the oracle queries.
_LADDER_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT vec_id, d AS dim, list_slice(v, 1, d) AS v FROM e CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)),
n AS (SELECT vec_id, dim, v, sqrt(list_dot_product(v, v)) AS nv FROM l)
"""

_COSINE_TOPK_SQL = _LADDER_SQL + """,
p AS (SELECT q.dim, q.vec_id AS query_id, c.vec_id AS neighbor_id,
             round(CASE WHEN q.nv > 0 AND c.nv > 0 THEN list_dot_product(q.v, c.v) / (q.nv * c.nv) ELSE 0 END, 6) AS similarity
      FROM n q JOIN n c ON q.dim = c.dim AND q.vec_id <> c.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY dim, query_id ORDER BY similarity DESC, neighbor_id) AS rank
        FROM p QUALIFY rank <= 10)
"""

def _half_sql(x: str) -> str:
    ulp = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    r = f"(round_even({x} / {ulp}, 0) * {ulp})"
    return f"(CASE WHEN {x} = 0 THEN {x} WHEN abs({r}) > 65504 THEN sign({x}) * 'inf'::DOUBLE ELSE {r} END)"


_MODELS_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT vec_id, 'prefix-float32' AS model, v FROM e
      UNION ALL SELECT vec_id, 'prefix-float16', list_transform(v, lambda x: """ + _half_sql("x") + """) FROM e
      UNION ALL SELECT vec_id, 'prefix-binary', list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) FROM e),
l AS (SELECT vec_id, model, d AS dim, list_slice(v, 1, d) AS v FROM m CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)),
n AS (SELECT vec_id, model, dim, v, sqrt(list_dot_product(v, v)) AS nv FROM l),
p AS (SELECT q.model, q.dim, q.vec_id AS query_id, c.vec_id AS neighbor_id,
             round(CASE WHEN q.nv > 0 AND c.nv > 0 THEN list_dot_product(q.v, c.v) / (q.nv * c.nv) ELSE 0 END, 6) AS similarity
      FROM n q JOIN n c ON q.model = c.model AND q.dim = c.dim AND q.vec_id <> c.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY model, dim, query_id ORDER BY similarity DESC, neighbor_id) AS rank
        FROM p QUALIFY rank <= 10)
"""

ORACLE = {
    "retrieval_benchmark": "WITH " + _MODELS_SQL + """,
truth AS (SELECT query_id, neighbor_id FROM top WHERE dim = 64 AND model = 'prefix-float32'),
sizes AS (SELECT query_id, count(*) AS n_truth FROM truth GROUP BY query_id),
rec AS (SELECT t.model, t.dim, t.query_id, CAST(count(tr.neighbor_id) AS DOUBLE) / max(s.n_truth) AS accuracy
        FROM top t LEFT JOIN truth tr USING (query_id, neighbor_id) JOIN sizes s USING (query_id)
        GROUP BY t.model, t.dim, t.query_id)
SELECT model, CAST(dim AS INTEGER) AS dimension, count(accuracy) AS count,
       round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(min(accuracy), 6) AS min,
       round(quantile_cont(accuracy, 0.25), 6) AS p25, round(quantile_cont(accuracy, 0.5), 6) AS p50,
       round(quantile_cont(accuracy, 0.75), 6) AS p75, round(max(accuracy), 6) AS max
FROM rec GROUP BY model, dim
""",
}

QUERIES = {
    "retrieval_benchmark": retrieval_benchmark,
}
