"""NULL, non-finite, empty and odd-length vectors in the k-NN family."""

import numpy as np
import pytest

from embedframe.operators import knn as K
from embedframe.operators import learn as L

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    good = [(i, r.normal(size=4).tolist()) for i in range(30)]
    return good + [(100, None), (101, [NAN, 0.0, 0.0, 1.0]), (102, [1.0, INF, 0.0, 1.0]), (103, [1.0, None, 0.0, 1.0]),
                   (104, [1.0, 2.0]), (105, [1.0, 2.5]), (106, []), (107, [0.0, 0.0, 0.0, 0.0])]


def expected(rows, k, metric):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for i, v in ok:
        others = [(j, w) for j, w in ok if j != i and len(w) == len(v)]
        s = [(-round(float(K._round_half_up(K.similarity_matrix(v[None], w[None], metric))[0, 0]), 6), j) for j, w in others]
        out |= {(i, j, r, round(-d, 6)) for r, (d, j) in enumerate(sorted(s)[:k], 1)}
    return out


@pytest.mark.parametrize("pivots", [0, 5])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn(spark, rows, metric, pivots):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (1024, 6):
        got = K.knn(df, df, 3, metric, pivots=pivots, block_rows=block).collect()
        assert {(r["query_id"], r["neighbor_id"], r["rank"], round(r["similarity"], 6)) for r in got} == expected(rows, 3, metric)
    assert K.knn(df.limit(0), df, 3, metric, pivots=pivots).count() == 0


def test_density(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    core = {r["vec_id"]: r["core"] for r in L.core_distance(df, 2).collect()}
    assert set(core) == {i for i, v in rows if v is not None and len(v) == 4 and None not in v and np.isfinite(v).all()}
    clusters = {r["vec_id"]: r["cluster"] for r in L.density_clusters(df, 2.0, 2, 3).collect()}
    assert set(clusters) == {i for i, _ in rows} and all(clusters[i] == -1 for i in (100, 101, 102, 103, 104, 106))
    assigned = L.assign_clusters(df, L.density_clusters(df, 2.0, 2, 3), df).collect()
    assert {r["vec_id"] for r in assigned} <= set(core)
