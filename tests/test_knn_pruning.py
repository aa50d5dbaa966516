import numpy as np
import pytest

from embedframe.operators import approx as A
from embedframe.operators import knn as K
from embedframe.operators import learn as L


def clustered(spark, n, seed=0, centres=12, dim=8):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim)) * 10
    rows = [(int(i), (c[i % centres] + r.normal(size=dim) * 0.2).tolist()) for i in range(n)]
    return spark.createDataFrame(rows + [(n + 7, [0.0] * dim)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", K.PIVOT_METRICS)
def test_pivots_change_nothing(spark, metric):
    df = clustered(spark, 150)
    plain = {tuple(r) for r in K.knn(df, df, 15, metric).collect()}  # more neighbours than a cell has
    assert {tuple(r) for r in K.knn(df, df, 15, metric, pivots=10).collect()} == plain


def scored_pairs(df, k, pivots, metric="euclidean"):
    q, c, cells = K.pivot_cells(df, df, metric, pivots, "vec_id", "embedding")
    first = K.knn(df, df, k, metric)
    sizes = {r["cell"]: r["rows"] for r in cells.collect()}
    own = sum(sizes[r["cell"]] for r in q.collect())
    return own + sum(sizes[r["cell"]] for r in K.pivot_visits(q, first, cells, k, metric, "vec_id").collect())


def test_pairs_grow_less_than_quadratically_on_clusters(spark):
    """Clusters of constant size, more of them as the table grows, and a pivot for about each."""
    small = scored_pairs(clustered(spark, 240, centres=12), 5, 24)
    large = scored_pairs(clustered(spark, 960, centres=48), 5, 96)
    assert large < 8 * small and large < 0.3 * 961 ** 2


def test_minhash_collides_like_jaccard(spark):
    sets = {0: range(0, 60), 1: range(20, 80), 2: range(50, 110)}
    bits = spark.createDataFrame([(i, b) for i, bs in sets.items() for b in bs], "doc_id long, bit int")
    rows = {r["doc_id"]: r for r in A.minhash_signatures(bits, "doc_id", "bit", 400, 3).collect()}
    for a, b in ((0, 1), (0, 2), (1, 2)):
        jaccard = len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
        same = np.mean([rows[a][f"mh_{k}"] == rows[b][f"mh_{k}"] for k in range(400)])
        assert abs(same - jaccard) < 0.09


def test_bucket_sizes_follow_the_table():
    assert [A.lsh_bits(n) for n in (10, 500, 2000, 1 << 30)] == [1, 4, 6, 25] and A.ivf_cells(10_000) == 100


def test_queries_without_predictions_count_as_zero(spark):
    truth = spark.createDataFrame([(1, 2), (1, 3), (5, 6)], "query_id long, neighbor_id long")
    pred = spark.createDataFrame([(1, 2, "a"), (1, 9, "a")], "query_id long, neighbor_id long, model string")
    assert {tuple(r) for r in K.recall_at_k(truth, pred.drop("model")).collect()} == {(1, 0.5), (5, 0.0)}
    assert {tuple(r) for r in K.recall_at_k(truth, pred, ["model"]).collect()} == {("a", 1, 0.5), ("a", 5, 0.0)}
    nn = spark.createDataFrame([(1, 2, 64), (1, 3, 64), (5, 6, 64), (1, 2, 8)], "query_id long, neighbor_id long, dim int")
    assert {tuple(r) for r in K.ladder_recall(nn, 64).collect()} == {(64, 1, 1.0), (64, 5, 1.0), (8, 1, 0.5), (8, 5, 0.0)}


def test_small_distances_of_large_vectors():
    q = np.full((1, 64), 1e4)
    assert abs(-K.similarity_matrix(q, q + 0.001, "euclidean")[0, 0] - 0.008) < 1e-9
    far = np.vstack([q + 0.001, -q, q * 3])
    assert abs(-K.similarity_matrix(q, far, "euclidean")[0, 0] - 0.008) < 1e-9


def test_assigned_row_meets_a_member_with_its_own_id(spark):
    members = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    clusters = spark.createDataFrame([(1, 10, 0.1), (2, 20, 0.1)], "vec_id long, cluster long, core double")
    new = spark.createDataFrame([(1, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in L.assign_clusters(new, clusters, members).collect()] == [(1, 10, 1.0)]
