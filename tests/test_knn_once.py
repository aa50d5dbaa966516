"""Neighbours are searched once, and tiles equal plain sorting."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embedframe.operators import fingerprints as FP
from embedframe.operators import knn as K
from embedframe.operators import learn as L


def test_the_benchmark_scores_each_pair_of_blocks_once(spark, tmp_path, monkeypatch):
    """F2: the recall and the statistics each read their input twice, so all pairs were scored four times."""
    make, folder = K._local_topk, str(tmp_path)

    def counted(*args):
        body = make(*args)

        def run(key, left, right):
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return body(key, left, right)

        return run

    monkeypatch.setattr(K, "_local_topk", counted)
    m = np.random.default_rng(3).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    assert K.retrieval_benchmark(df, dims=(8, 4), k=3).count() == 2
    assert len(list(tmp_path.iterdir())) == 2  # a block for each width


def test_few_corpus_blocks_for_many_query_blocks(spark):
    """a table of medium size was cut into eight corpus blocks, and every query began anew in each."""
    df = spark.range(20000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))
    met = K.blocked_cogroup(df, df, lambda key, q, c: q[["_qb", "_cb"]].iloc[:1].assign(n=len(q), m=len(c)), "_qb int, _cb int, n long, m long").collect()
    assert len({r["_cb"] for r in met}) == 2 and len({r["_qb"] for r in met}) == 16
    assert sum(r["n"] * r["m"] for r in met) == 20000 ** 2


@pytest.mark.parametrize("metric", ["manhattan", "cosine", "euclidean"])
def test_first_look_at_a_tile_loses_no_row(metric):
    """steps of components and products with the norms in them, on plain, whole, far-off and unequal rows."""
    r = np.random.default_rng(8)
    for x in (r.normal(size=(700, 24)), np.round(r.normal(size=(700, 9))), r.normal(size=(700, 24)) * 1e-3 + 50, r.normal(size=(700, 8)) * 10.0 ** r.integers(-3, 4, (700, 1))):
        ids = r.permutation(5000)[:700]
        s = K._round_half_up(K.similarity_matrix(x, x, metric))
        i, n, got = K.block_topk(x, x, ids, ids, [metric], 6, True)[metric]
        found = {(a, b): c for a, b, c in zip(i, n, got, strict=True)}
        for a in range(0, 700, 23):
            want = sorted((-s[a, b], ids[b]) for b in range(700) if a != b)[:6]
            assert [c for b, c in sorted(((b, c) for (q, b), c in found.items() if q == a), key=lambda t: (-t[1], t[0]))] == pytest.approx([-c for c, _ in want], abs=2e-6)


def test_links_of_a_radius_with_blocks_that_do_not_divide(spark):
    """the sides of a radius' links had different numbers of blocks, and some pairs of blocks never met."""
    df = spark.range(7300).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 3650).cast("double")).alias("embedding"))
    links = L.eps_links(df, 0.5, block_rows=1300)
    assert L.connected_components(df, links, "vec_id").where("component <> vec_id % 3650").count() == 0


@pytest.mark.parametrize("width", [64, 320])
def test_bit_sets_in_the_order_of_sizes(width, monkeypatch):
    """every query met every set in products of floats; sizes that can't reach a k-th are passed over."""
    monkeypatch.setattr(K, "TILE_SETS", 32)
    monkeypatch.setattr(K, "TILE_OTHERS", 16)
    r, met, whole = np.random.default_rng(width), [], K.common_bits
    monkeypatch.setattr(K, "common_bits", lambda own, words: met.append(len(own) * len(words)) or whole(own, words))
    x = (r.random((600, width)) < r.uniform(0.02, 0.95, (600, 1))).astype(int)
    x[r.integers(0, 600, 150)] = x[r.integers(0, 600, 150)]
    x[:3], x[3:6] = 0, 1
    ids, common, size = r.permutation(4000)[:600], x @ x.T, x.sum(1)
    s = np.floor(common / np.maximum(size[:, None] + size - common, 1e-9) * 1e6 + 0.5) / 1e6
    asked = np.flatnonzero(ids % 3 == 0)
    words = K.packed_lists(pd.Series([np.flatnonzero(v) for v in x]), width)
    i, n, got = K.bits_topk(words[asked], words, ids[asked], ids, 4, True)
    want = sorted((ids[a], b, c) for a in asked for c, b in sorted(((s[a, j], ids[j]) for j in range(600) if j != a), key=lambda t: (-t[0], t[1]))[:4])
    assert sorted(zip(ids[asked][i].tolist(), n.tolist(), got.tolist(), strict=True)) == want
    assert sum(met) < 0.8 * len(asked) * 600



def test_packed_sets_fold_and_search_like_lists(spark):
    """each width's lists were folded again for every reader and travelled as lists."""
    r = np.random.default_rng(11)
    lists = [sorted(r.choice(256, int(n), replace=False).tolist()) for n in r.integers(0, 200, 90)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "doc_id long, bits array<int>")
    words = FP.packed_bits(df, ["doc_id"], 256)
    for w in (256, 128, 64):
        held = words.select("doc_id", FP.folded_words(F.col("words"), 4, w).alias("v"))
        plain = df.select("doc_id", F.array_distinct(F.transform("bits", lambda b: b % F.lit(w))).alias("v"))
        a, b = (K.knn(x, x, 3, "tanimoto", id_col="doc_id", vec_col="v", bits_width=w, packed=p) for x, p in ((held, True), (plain, False)))
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 270
    with pytest.raises(ValueError):
        K.knn(held, held, 3, "cosine", id_col="doc_id", vec_col="v", bits_width=64, packed=True)
    with pytest.raises(ValueError):
        FP.folded_words(F.col("words"), 4, 192)


def test_links_within_what_is_joined_are_not_looked_for(monkeypatch):
    """every pair of a radius was listed, also within a component that earlier tiles had joined."""
    monkeypatch.setattr(K, "TILE_QUERIES", 40)
    monkeypatch.setattr(K, "TILE_ROWS", 60)
    r, listed, whole = np.random.default_rng(12), [], L.near_pairs

    def counted(*args):
        for i, j in whole(*args):
            listed.append(len(i))
            yield i, j

    monkeypatch.setattr(L, "near_pairs", counted)
    x = np.concatenate([r.normal(size=(500, 3)) * 0.1, r.normal(size=(60, 3)) * 4, r.normal(size=(40, 3)) * 0.05 + 9])
    ids = r.permutation(600)
    side = {"_qb": 0, "_qid": ids, "_qv": list(x)}
    got = L._local_star(0.6)(None, pd.DataFrame(side), pd.DataFrame({"_cb": 0, "_cid": ids, "_cv": list(x)}))
    near, label = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.6, np.arange(600)
    for _ in range(600):
        label = np.where(near, label[None], 600).min(1)
    star = {int(i): int(i) for i in ids} | dict(zip(got["src"].tolist(), got["dst"].tolist(), strict=True))
    groups = lambda name: sorted(sorted(g) for g in pd.Series(ids).groupby(name).apply(list))
    assert groups(label) == groups(np.array([star[int(i)] for i in ids]))
    assert sum(listed) < near.sum() / 2
