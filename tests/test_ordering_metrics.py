"""Distributed ranks, correlations and losses against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embedframe.operators import metrics as M
from embedframe.operators.ordering import average_ranks, global_row_number


def test_row_number_with_hot_group(spark):
    rng = np.random.default_rng(0)
    n = 3000
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 50, n))  # one group holds a third
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": rng.integers(0, 100, n)})
    df = spark.createDataFrame(pdf)
    got = global_row_number(df, ["v", "id"], ["g"], partitions=7).toPandas().set_index("id")["row_number"]
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    assert (got.sort_index() == want.sort_index()).all()
    glob = global_row_number(df, ["v", "id"], partitions=5).toPandas().set_index("id")["row_number"]
    assert (glob.sort_index() == pdf.sort_values(["v", "id"]).reset_index(drop=True).reset_index()
            .set_index("id")["index"].sort_index() + 1).all()


def test_average_ranks_ties(spark):
    pdf = pd.DataFrame({"id": range(12), "g": [0] * 6 + [1] * 6, "v": [3, 1, 3, 2, 3, 1, 5, 5, 5, 5, 0, 9]})
    got = average_ranks(spark.createDataFrame(pdf), "v", ["g"], partitions=3).toPandas().set_index("id")["rank"]
    want = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got.sort_index().to_numpy(), want.to_numpy())


def test_spearman_pearson_against_pandas(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, 400).astype(float)
    y = x + rng.normal(0, 5, 400)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": x, "y": np.round(y, 1)})
    got = M.spearman(spark.createDataFrame(pdf), "x", "y", ["g"], digits=None).toPandas().set_index("g")["spearman"]
    for g, part in pdf.groupby("g"):
        want = part["x"].rank().corr(part["y"].rank())
        assert got[g] == pytest.approx(want, abs=1e-9)
    pe = M.pearson(spark.createDataFrame(pdf), "x", "y", digits=None).first()["pearson"]
    assert pe == pytest.approx(np.corrcoef(x, np.round(y, 1))[0, 1])


def test_p_value_known_values():
    # t = 0.5·√8/√0.75 = 1.633 with 8 degrees of freedom → two-sided p = 0.1411
    assert M.correlation_p_value(0.5, 10) == pytest.approx(0.14106, abs=1e-4)
    assert M.correlation_p_value(0.0, 50) == pytest.approx(1.0)
    assert M.correlation_p_value(1.0, 10) == 0.0
    assert math.isnan(M.correlation_p_value(0.3, 2))


def _cosent_brute(pdf, scale=20.0):
    out = {}
    for b, part in pdf.groupby("batch"):
        terms = [scale * (sj - si) for (li, si), (lj, sj) in itertools.product(zip(part.label, part.score), repeat=2)
                 if li > lj]
        out[b] = math.log1p(sum(math.exp(t) for t in terms)) if terms else 0.0
    return out


def test_cosent_without_pairs_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"batch": rng.integers(0, 4, 120), "label": np.round(rng.random(120), 1),
                        "score": rng.uniform(-1, 1, 120)})
    got = M.cosent_loss(spark.createDataFrame(pdf), "batch", "label", "score", digits=None).toPandas()
    want = _cosent_brute(pdf)
    for b, loss in zip(got.batch, got.loss):
        assert loss == pytest.approx(want[b], rel=1e-9)
    counts = M.theta_pair_counts(spark.createDataFrame(pdf), "batch", "label").toPandas().set_index("batch")["n_pairs"]
    for b, part in pdf.groupby("batch"):
        assert counts[b] == sum(1 for a, c in itertools.product(part.label, repeat=2) if a > c)


def test_classification_losses(spark):
    logits = [[2.0, 0.5, -1.0], [0.1, 0.2, 0.3]]
    labels = [0, 2]
    df = spark.createDataFrame(list(zip(logits, labels)), "logits array<double>, label int")
    ce = M.softmax_loss(df, "logits", "label", digits=None).first()["loss"]
    lg = np.array(logits)
    p = np.exp(lg) / np.exp(lg).sum(1, keepdims=True)
    assert ce == pytest.approx(float(np.mean(-np.log(p[[0, 1], labels]))))
    dice = M.self_adjusting_dice_loss(df, "logits", "label", digits=None).first()["loss"]
    pk = p[[0, 1], labels]
    f = (1 - pk) * pk
    assert dice == pytest.approx(float(np.mean(1 - (2 * f + 1) / (f + 2))))
    with pytest.raises(ValueError):
        M.self_adjusting_dice_loss(df, "logits", "label", reduction="none")


def test_matryoshka_weight_checks():
    M.check_matryoshka_weights([64, 32], [1.0, 1.0])
    with pytest.raises(ValueError):
        M.check_matryoshka_weights([64, 32], [2.0, 1.0])
    with pytest.raises(ValueError):
        M.check_matryoshka_weights([64, 32], [1.0])
    with pytest.raises(ValueError):
        M.check_matryoshka_weights([64], [0.0])


def test_error_metrics_mape_skips_zero_gold(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "g double, p double")
    r = M.error_metrics(df, "g", "p", digits=None).first()
    assert r.mae == pytest.approx(1.0) and r.max_error == pytest.approx(1.0)
    assert r.mape == pytest.approx((0.5 + 0.25) / 2 * 100)
    only_zero = spark.createDataFrame([(0.0, 1.0)], "g double, p double")
    assert M.error_metrics(only_zero, "g", "p").first().mape is None


def test_pooling_strategies(spark):
    rows = [(0, 1, [1.0, 2.0], 1), (0, 2, [3.0, 6.0], 1), (0, 3, [100.0, 100.0], 0)]
    df = spark.createDataFrame(rows, "g int, pos long, v array<double>, mask int")
    def pooled(strategy):
        out = M.vec_pool(df, ["g"], "v", "pos", strategy, mask_col="mask", digits=None).orderBy("pos").collect()
        return [r.value for r in out]
    assert pooled("mean") == [2.0, 4.0]
    assert pooled("max") == [3.0, 6.0]
    assert pooled("first") == [1.0, 2.0]
    assert pooled("mean_sqrt_len") == pytest.approx([4 / math.sqrt(2), 8 / math.sqrt(2)])
    assert pooled("weighted_mean") == pytest.approx([(1 + 2 * 3) / 3, (2 + 2 * 6) / 3])
    with pytest.raises(ValueError):
        M.vec_pool(df, ["g"], "v", "pos", "attention")
    layered = df.withColumn("layer", F.col("pos").cast("int"))
    with pytest.raises(ValueError):
        M.last_k_layers(layered, "layer", 4, ["g"])


def test_exact_quantiles_match_numpy(spark):
    from embedframe.operators.knn import describe_groups, exact_quantiles

    rng = np.random.default_rng(9)
    g = np.where(rng.random(2000) < 0.4, 0, rng.integers(1, 6, 2000))
    v = np.round(rng.normal(size=2000), 3)
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).toPandas()
    for _, r in got.iterrows():
        assert r.value == pytest.approx(np.quantile(pdf.v[pdf.g == r.g], r.q))
    a = describe_groups(df, ["g"], "v").toPandas().sort_values("g").reset_index(drop=True)
    for _, r in a.iterrows():
        own = pdf.v[pdf.g == r.g]
        assert [r[c] for c in ("p25", "p50", "p75")] == pytest.approx(np.quantile(own, [0.25, 0.5, 0.75]), abs=1e-6)
        assert r["count"] == len(own) and r["std"] == pytest.approx(own.std(), abs=1e-6)


def test_cosent_of_scores_far_apart(spark):
    rows = [("w", 1, -60.0), ("w", 2, 60.0), ("w", 3, 60.0), ("v", 1, 900.0), ("v", 2, -900.0), ("u", 1, 3.0)]
    got = {r.batch: r.loss for r in M.cosent_loss(spark.createDataFrame(rows, "batch string, label int, score double"),
                                                  "batch", "label", "score", digits=None).collect()}
    assert abs(got["w"] - math.log(2)) < 1e-12 and abs(got["v"] - 20 * 1800) < 1e-6 and got["u"] == 0
    near = [("x", 1, -60.0), ("x", 2, 0.0), ("x", 3, 0.0), ("x", 2, 60.0), ("x", 3, 60.0)]
    pdf = pd.DataFrame(near, columns=["batch", "label", "score"])
    loss = M.cosent_loss(spark.createDataFrame(pdf), "batch", "label", "score", digits=None).first().loss
    assert abs(loss - 20 * 60) < 1e-6  # exp(20 (60 - 0)): the shift by the batch's minimum alone lost it


def test_cosent_wide_scores_and_missing_values(spark):
    rows = [(0, 1.0, -9000.0), (0, 2.0, 9000.0), (0, 3.0, 8999.0), (0, None, 5.0), (0, 1.5, None),
            (1, 2.0, -4000.0), (1, 1.0, 4000.0), (2, None, 1.0), (3, 1.0, 2.0), (3, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "batch int, label double, score double")
    got = {r.batch: r.loss for r in M.cosent_loss(df, "batch", "label", "score", digits=None).collect()}
    assert got == {0: pytest.approx(20.0), 1: pytest.approx(160000.0), 2: 0.0, 3: 0.0}
    assert M.cosent_loss(df.limit(0), "batch", "label", "score").count() == 0


def _base_loss(name, part, d):
    """One base loss of one batch at one width, from its formula."""
    a, b = np.array(part.a.tolist())[:, :d], np.array(part.b.tolist())[:, :d]
    ab, aa, bb = (a * b).sum(1), (a * a).sum(1), (b * b).sum(1)
    cos, tan = ab / np.sqrt(aa * bb), ab / (aa + bb - ab)
    h, y = d // 2, part.target.to_numpy()
    ang = np.abs(ab + (a[:, h:] * b[:, :h]).sum(1) - (a[:, :h] * b[:, h:]).sum(1)) / np.sqrt(aa * bb)
    if name in M.RANKING_LOSSES:
        return _cosent_brute(pd.DataFrame({"batch": 0, "label": part.label, "score": {"cosent": cos, "tanimoto_sent": tan, "angle": ang}[name]}))[0]
    e = np.abs(tan - y)
    huber = np.where(e < 1, 0.5 * e * e, e - 0.5)
    return {"mse": e * e, "l1": e, "smooth_l1": huber, "huber": huber, "bin_cross_entropy": np.log1p(np.exp(tan)) - tan * y,
            "kldiv": y * (np.log(y) - tan), "cosine_embedding": np.where(part.sign > 0, 1 - cos, np.maximum(cos, 0))}[name].mean()


def test_matryoshka_every_base_loss(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"batch": rng.integers(0, 3, 60), "a": rng.normal(size=(60, 8)).tolist(), "b": rng.normal(size=(60, 8)).tolist(),
                        "label": rng.integers(0, 5, 60) / 5, "target": rng.uniform(0.1, 1, 60), "sign": rng.choice([-1, 1], 60)})
    df = spark.createDataFrame(pdf)
    dims, weights = [8, 4], [1.0, 2.0]
    got = M.matryoshka_losses(df, "batch", "a", "b", "label", dims, weights, target_col="target", sign_col="sign", digits=None).toPandas()
    assert len(got) == 3 * len(M.BASE_LOSSES)
    for r in got.itertuples():
        part = pdf[pdf.batch == r.batch]
        assert r.loss == pytest.approx(sum(w * _base_loss(r.base, part, d) for d, w in zip(dims, weights)), rel=1e-9), r.base
    only = M.matryoshka_losses(df, "batch", "a", "b", "label", dims, weights, bases=["l1"])
    assert {r.base for r in only.collect()} == {"l1"}
    below = M.matryoshka_losses(df.withColumn("target", -F.col("target")), "batch", "a", "b", "label", dims, weights, ["kldiv"], "target")
    assert all(r.loss is None for r in below.collect())
    with pytest.raises(ValueError, match="unknown"):
        M.matryoshka_losses(df, "batch", "a", "b", "label", dims, weights, ["triplet"])
    with pytest.raises(ValueError, match="sign_col"):
        M.matryoshka_losses(df, "batch", "a", "b", "label", dims, weights, ["cosine_embedding"])
