import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedframe.operators import approx as A
from embedframe.operators import knn as K


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.default_rng(5).normal(size=(1200, 24))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").cache()
    return df, K.knn(df, df, 10, "cosine").select("query_id", "neighbor_id").cache()


def recall(truth, pred):
    return K.recall_at_k(truth, pred).agg(F.avg("accuracy")).first()[0]


def test_probes_are_the_cheapest_flips():
    index = A.LshProbes(6, 3, 5, 2)
    m = np.random.default_rng(1).normal(size=(20, 6))
    margins, own = ((m @ index.planes.T) ** 2).reshape(20, 3, 5), index.codes(m)
    for probes in (1, 2, 7, 31, 32):
        got = index.probed(m, probes)
        for i, t in itertools.product(range(20), range(3)):
            cost = {int(own[i, t]) ^ x: sum(margins[i, t, j] for j in range(5) if x >> j & 1) for x in range(32)}
            assert sorted(got[i, t]) == sorted(sorted(cost, key=cost.get)[:probes])


def test_lsh_probes_until_the_recall_is_reached(spark, vectors):
    df, truth = vectors
    args = dict(dim=24, tables=8, bits=A.lsh_bits(1200), seed=1)
    assert recall(truth, A.lsh_knn(df, 10, **args)) < 0.8
    assert recall(truth, A.lsh_knn(df, 10, least_recall=0.92, **args)) >= 0.9
    whole = A.lsh_knn(df, 10, probes=1 << args["bits"], block_rows=500, **args).select("query_id", "neighbor_id")
    assert whole.exceptAll(truth).count() == 0 == truth.exceptAll(whole).count()


@pytest.mark.parametrize("search", ["knn_approx_lsh", "knn_approx_ivf"])
@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_searches_reach_the_bar(spark, search, size):
    from embedframe.plans import approximate

    sf = f"/root/testdata/{size}"
    e = approximate._emb(spark, sf)
    truth = K.knn(e.where("vec_id % 50 = 0"), e, 10, "cosine").select("query_id", "neighbor_id")
    assert recall(truth, approximate.QUERIES[search](spark, sf)) >= 0.9


def by_lists(rows, books, k, nprobe, short):
    """IVF by given code words, one query at a time."""
    ids, unit = np.array([i for i, _ in rows]), A._unit(np.array([v for _, v in rows]))
    cell, codes = books.encode(unit)
    rebuilt = books.centers[cell] + np.concatenate([b[c] for b, c in zip(books.books, codes.T, strict=True)], axis=1)
    out = set()
    for i, v in zip(ids, unit, strict=True):
        probed = np.argsort(((books.centers - v) ** 2).sum(1), kind="stable")[:nprobe]
        at = np.flatnonzero(np.isin(cell, probed) & (ids != i))
        at = at[np.argsort(-(rebuilt[at] @ v), kind="stable")[:short]]
        best = sorted((-round(float(unit[j] @ v), 6), int(ids[j])) for j in at)[:k]
        out |= {(int(i), j, r) for r, (_, j) in enumerate(best, 1)}
    return out


def test_lists_with_given_code_words(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 8)) + r.normal(size=(5, 8))[r.integers(0, 5, 300)]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    books = A.Codebooks.train(A._unit(r.normal(size=(6, 8))), A._unit(x), 4, 16, 0)
    assert books.books.shape == (4, 16, 2)
    odd = [(900, None), (901, [1.0, None, 0, 0, 0, 0, 0, 0]), (902, [float("nan")] * 8), (903, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v]) for i, v in rows + odd], "vec_id long, embedding array<double>").repartition(3)
    for block in (8192, 13):  # blocks change neither the lists nor their best
        got = A.ivf_knn(df, 3, nprobe=2, short=40, books=books, block_rows=block)
        assert {(q["query_id"], q["neighbor_id"], q["rank"]) for q in got.collect()} == by_lists(rows, books, 3, 2, 40)
    few = A.ivf_knn(df, 3, nprobe=2, short=40, books=books, queries=df.where("vec_id % 50 = 0"))
    assert {(q["query_id"], q["neighbor_id"], q["rank"]) for q in few.collect()} == {t for t in by_lists(rows, books, 3, 2, 40) if t[0] % 50 == 0}
    assert A.ivf_knn(df.limit(0), 3).count() == 0 == A.lsh_knn(df.limit(0), 3, dim=8, least_recall=0.9).count()


def test_buckets_against_walking(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 6))
    x[7] = 0
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<double>")
    index = A.LshProbes(6, 2, 4, 3)
    own, probed = index.codes(x), index.probed(x, 3)
    s = K._round_half_up(K.similarity_matrix(x, x, "cosine"))
    want = set()
    for i in range(0, 200, 50):
        met = [j for j in range(200) if j != i and any(own[j, t] in probed[i, t] for t in range(2))]
        want |= {(i, j, k) for k, (_, j) in enumerate(sorted((-s[i, j], j) for j in met)[:5], 1)}
    for block in (8192, 9):
        got = A.lsh_knn(df, 5, dim=6, tables=2, bits=4, seed=3, probes=3, queries=df.where("vec_id % 50 = 0"), block_rows=block)
        assert {(q["query_id"], q["neighbor_id"], q["rank"]) for q in got.collect()} == want
