"""Exact and approximate neighbours, clustering, classification against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embedframe.operators import approx as A
from embedframe.operators import knn as K
from embedframe.operators import learn as L

METRICS = ["cosine", "dot", "tanimoto", "euclidean", "manhattan"]


def _vectors(spark, n=300, d=12, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(m)}))
    return df, m


def _brute(m, metric, k):
    s = K._round_half_up(K.similarity_matrix(m, m, metric))
    np.fill_diagonal(s, -np.inf)
    ids = np.arange(len(m))
    return {i: [int(j) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(m))}


@pytest.mark.parametrize("metric", METRICS)
def test_knn_blocks_equal_brute_force(spark, metric):
    df, m = _vectors(spark)
    nn = K.knn(df, df, 7, metric, block_rows=64).toPandas()  # 5 × 5 block pairs
    got = {q: list(g.sort_values("rank")["neighbor_id"]) for q, g in nn.groupby("query_id")}
    assert got == _brute(m, metric, 7)


def test_knn_ladder_recall_is_one_at_full_width(spark):
    df, _ = _vectors(spark, n=120, d=16)
    out = K.retrieval_benchmark(df, dims=(16, 8, 4), k=5, block_rows=50).toPandas().set_index("dimension")
    assert out.loc[16, "mean"] == 1.0 and out.loc[16, "count"] == 120
    assert 0.0 <= out.loc[4, "mean"] <= out.loc[16, "mean"]


def test_approximate_recall_floors(spark):
    df, m = _vectors(spark, n=400, d=16, seed=3)
    truth = K.knn(df, df, 10, "cosine").select("query_id", "neighbor_id")

    def recall(pred):
        return K.recall_at_k(truth, pred).agg(F.avg("accuracy")).first()[0]

    assert recall(A.lsh_knn(df, 10, dim=16, tables=16, bits=4, seed=1)) >= 0.5
    assert recall(A.ivf_knn(df, 10, cells=8, nprobe=8, seed=1)) == pytest.approx(1.0)  # probing every cell is exact


def _blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [10, 0], [0, 10]], dtype=float)
    pts = np.vstack([c + rng.normal(0, 0.5, (40, 2)) for c in centers] + [rng.uniform(-5, 15, (6, 2))])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(pts)), "embedding": list(pts)}))
    return df, pts


def _brute_clusters(pts, eps, m, min_size):
    d = np.round(np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)), 6)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, m - 1]
    is_core = core <= eps
    label = np.where(is_core, np.arange(len(pts)), -1)
    changed = True
    while changed:
        changed = False
        for i in np.nonzero(is_core)[0]:
            nb = np.nonzero(is_core & (d[i] <= eps))[0]
            lo = min([label[i]] + [label[j] for j in nb])
            for j in list(nb) + [i]:
                if label[j] != lo:
                    label[j] = lo
                    changed = True
    out = label.copy()
    for lab in set(label[label >= 0]):
        if (label == lab).sum() < min_size:
            out[label == lab] = -1
    return out


def test_density_clusters_equal_brute_force(spark):
    df, pts = _blobs(spark)
    got = L.density_clusters(df, eps=1.0, m=4, min_size=5, block_rows=32).toPandas().sort_values("vec_id")
    want = _brute_clusters(pts, 1.0, 4, 5)
    assert list(got.cluster) == list(want)
    assert len(set(want[want >= 0])) == 3


def test_connected_components_long_chain(spark):
    n = 200
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n - 1) if i != 99], "src long, dst long")
    cc = {r.id: r.component for r in L.connected_components(nodes, edges).collect()}
    assert all(cc[i] == 0 for i in range(100)) and all(cc[i] == 100 for i in range(100, n))


def test_assign_and_sweep(spark):
    df, pts = _blobs(spark)
    core = L.core_distance(df, 4)
    cl = L.density_clusters(df, 1.0, 4, 5, core=core)
    assigned = L.assign_clusters(df, cl, df).toPandas()
    assert assigned.probability.between(0, 1).all()
    members = cl.toPandas().set_index("vec_id")
    inside = assigned[assigned.vec_id.isin(members.index[members.cluster >= 0])]
    assert (inside.set_index("vec_id").cluster == members.loc[inside.vec_id, "cluster"]).mean() > 0.95
    pts_df = df.join(core.where(F.col("core") <= 1.0).select("vec_id"), "vec_id", "left_semi")
    comps = L.components_at(pts_df, core, 1.0, "vec_id", "embedding")
    sweep = L.cluster_sweep(comps, df.select("vec_id"), [5, 1000]).toPandas().set_index("min_size")
    assert sweep.loc[5, "n_clusters"] == 3 and sweep.loc[1000, "n_clusters"] == 0
    assert sweep.loc[1000, "n_noise"] == len(pts)


def test_classifier_learns_separable_labels(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 300)
    x = np.eye(3)[y] * 3 + rng.normal(0, 0.3, (300, 3))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(300), "embedding": list(x), "label": y}))
    train, test = df.where("vec_id < 200"), df.where("vec_id >= 200")
    for model in ("logistic", "mlp"):
        pred = L.classifier_fit_predict(train, test, "embedding", "label", model=model, max_iter=200)
        acc = pred.select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert acc > 0.9
    with pytest.raises(ValueError):
        L.classifier_fit_predict(train, test, "embedding", "label", model="tree")


def test_density_hierarchy_splits_blobs(spark):
    df, pts = _blobs(spark)
    out = L.density_hierarchy(df, [20.0, 8.0, 2.0, 1.0, 0.6], m=4, min_size=5, block_rows=32).toPandas()
    labels = out.set_index("vec_id").sort_index().cluster.to_numpy()
    found = set(labels[labels >= 0])
    assert len(found) == 3  # the root (everything at the widest radius) is never chosen
    for blob in range(3):
        members = labels[blob * 40:(blob + 1) * 40]
        assert (members == members[members >= 0][0]).mean() > 0.8


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "tanimoto"])
def test_block_size_changes_nothing(spark, metric):
    df, m = _vectors(spark, n=250, d=8, seed=5)
    queries = df.where("vec_id % 7 = 0")
    a = K.knn(queries, df, 5, metric).toPandas()
    b = K.knn(queries, df, 5, metric, block_rows=40).toPandas()
    key = ["query_id", "rank"]
    assert a.sort_values(key).reset_index(drop=True)[["query_id", "neighbor_id", "similarity", "rank"]].equals(
        b.sort_values(key).reset_index(drop=True)[["query_id", "neighbor_id", "similarity", "rank"]])


def test_multi_metric_equals_single_calls(spark):
    df, _ = _vectors(spark, n=150, d=6, seed=8)
    multi = K.knn(df, df, 4, ["cosine", "manhattan"], block_rows=40).toPandas()
    for m in ("cosine", "manhattan"):
        one = K.knn(df, df, 4, m, block_rows=40).toPandas()
        got = multi[multi.metric == m].drop(columns="metric").sort_values(["query_id", "rank"]).reset_index(drop=True)
        assert got.equals(one.sort_values(["query_id", "rank"]).reset_index(drop=True)[got.columns])


@pytest.mark.parametrize("metric", ["cosine", "dot", "tanimoto", "euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["random", "copies", "far", "grid"])
def test_block_topk_by_tiles(metric, kind):
    rng = np.random.default_rng(5)
    x = {"random": rng.standard_normal((700, 16)), "copies": np.repeat(rng.standard_normal((7, 16)), 100, axis=0),
         "far": rng.standard_normal((700, 16)) * 0.01 + 300, "grid": np.round(rng.standard_normal((700, 3)))}[kind]
    ids = rng.permutation(700)
    s = K._round_half_up(K.similarity_matrix(x, x, metric))
    want = {(i, int(ids[j])) for i in range(700) for j in [j for j in np.lexsort((ids, -s[i])) if j != i][:5]}
    old = K.TILE_QUERIES, K.TILE_ROWS, K.FIRST_ROWS
    K.TILE_QUERIES, K.TILE_ROWS, K.FIRST_ROWS = 50, 90, 40
    try:
        i, n, got = K.block_topk(x, x, ids, ids, [metric], 5, True)[metric]
        kth = got.reshape(700, 5)[:, 4]
        again = K.block_topk(x, x, ids, ids, [metric], 5, True, floor=kth)[metric]
    finally:
        K.TILE_QUERIES, K.TILE_ROWS, K.FIRST_ROWS = old
    differ = want ^ set(zip(i.tolist(), n.tolist(), strict=True))
    # sums in another order may differ in the last digit of the rounding
    place = {int(v): p for p, v in enumerate(ids)}
    assert all(abs(s[a, place[b]] - kth[a]) <= 1.5e-6 * max(1.0, abs(kth[a]) * 1e-6) for a, b in differ) and len(i) == 3500
    assert len(again[0]) == 3500 and np.allclose(again[2], got, atol=2e-6)


def test_a_table_of_medium_size_meets_in_few_blocks(spark):
    """Rows are copied once for a block of the other side: copies must not grow with the table before blocks are full."""
    df = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    sizes = K.blocked_cogroup(df, df, lambda key, l, r: pd.DataFrame({"l": [len(l)], "r": [len(r)]}), "l long, r long",
                              corpus_rows=K.CORPUS_FACTOR * K.BLOCK_ROWS).toPandas()
    assert len(sizes) == K.SPREAD ** 2 // 2 and (sizes["l"] * sizes["r"]).sum() == 9000 ** 2


@pytest.mark.parametrize(("eps", "kind"), [(0.6, "random"), (0.1, "grid"), (0.0, "copies")])
def test_links_of_whole_blocks_without_a_distance_matrix(eps, kind, monkeypatch):
    rng = np.random.default_rng(7)
    x = {"random": rng.standard_normal((400, 4)), "grid": np.round(rng.standard_normal((400, 3)), 1) + 500, "copies": np.zeros((400, 3))}[kind]
    ids = rng.permutation(400)

    def roots(pairs):
        root = list(range(400))
        for a, b in pairs:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        for i in range(400):
            root[i] = root[root[i]]
        return root

    d = -K._round_half_up(K.similarity_matrix(x, x, "euclidean"))
    want = roots((ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= eps), strict=True))
    monkeypatch.setattr(K, "TILE_QUERIES", 30)
    monkeypatch.setattr(K, "TILE_ROWS", 50)
    monkeypatch.setattr(K, "similarity_matrix", None)  # whole matrices would not fit larger blocks
    left, right = pd.DataFrame({"_qid": ids, "_qv": list(x), "_qb": 0}), pd.DataFrame({"_cid": ids, "_cv": list(x), "_cb": 0})
    found = pd.concat([L._local_star(eps)(None, left.iloc[a], right.iloc[b]) for a in (slice(150), slice(150, None)) for b in (slice(150), slice(150, None))])
    assert roots(zip(found["src"], found["dst"], strict=True)) == want
