"""The hyperplane search asks for every row, and its queries travel once a group of buckets."""

import numpy as np

from embedframe.operators import approx as A
from embedframe.operators import knn as K
from embedframe.plans import approximate


def vectors(n, dim, seed=4):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_every_row_is_a_query(spark, tmp_path):
    """only the rows with ids divisible by 50 were asked for, in 4 tables of 16, and the SQL was gone."""
    x = vectors(120, 64)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = approximate.knn_approx_lsh(spark, str(tmp_path)).toPandas()
    assert sorted(found["query_id"].unique()) == list(range(120)) and (found.groupby("query_id").size() == 10).all()
    assert approximate.LSH_ARGS["tables"] == 16 and "knn_approx_lsh" in approximate.ORACLE
    s = K.similarity_matrix(x, x, "cosine") - 9 * np.eye(120)
    exact = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(exact[q]) & set(rows["neighbor_id"])) for q, rows in found.groupby("query_id")]) >= 9


def test_a_query_travels_once_a_group(spark, monkeypatch):
    """a query was copied for each bucket that it probes, and each bucket gave out ten rows."""
    x, met = vectors(90, 6), []
    whole = K.blocked_cogroup
    monkeypatch.setattr(K, "blocked_cogroup", lambda q, c, *args, **kw: met.append((q, c)) or whole(q, c, *args, **kw))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.lsh_knn(df, 5, dim=6, tables=2, bits=5, seed=3, probes=12, block_rows=40)
    index = A.LshProbes(6, 2, 5, 3)
    own, probed = index.codes(x), index.probed(x, 12)
    s = K._round_half_up(K.similarity_matrix(x, x, "cosine"))
    want = set()
    for i in range(90):
        rows = [j for j in range(90) if j != i and any(own[j, t] in probed[i, t] for t in range(2))]
        want |= {(i, j, k) for k, (_, j) in enumerate(sorted((-s[i, j], j) for j in rows)[:5], 1)}
    assert {(r["query_id"], r["neighbor_id"], r["rank"]) for r in got.collect()} == want
    assert met[0][0].count() == 90 * 2 * 3 and met[0][1].count() == 90 * 2  # tables, and groups of 40 rows


def test_buckets_of_equal_rows_in_parts(monkeypatch):
    """Ties go to smaller ids, however a bucket is cut."""
    x = np.repeat(vectors(7, 4), 20, axis=0)
    ids, index = np.random.default_rng(2).permutation(140), A.LshProbes(4, 1, 3, 0)
    s = K._round_half_up(K.similarity_matrix(x, x, "cosine"))
    want = sorted((ids[i], j, -v) for i in range(140) for v, j in sorted((-s[i, j], ids[j]) for j in range(140) if j != i)[:6])
    for pairs in (64, 65536):
        monkeypatch.setattr(A, "PAIRS_AT_ONCE", pairs)
        got = A.bucket_topk(index, 0, x, np.full(140, np.inf), ids, x, ids, 6)
        assert sorted(zip(*(v.tolist() for v in got), strict=True)) == want
