"""Tanh classification head: gradient, dropout, fit and prediction."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embedframe.operators import head as H


@pytest.mark.parametrize("loss", H.LOSSES)
@pytest.mark.parametrize("dropout", [0.0, 0.4])
def test_gradient_equals_finite_differences(loss, dropout):
    rng = np.random.default_rng(1)
    x, y, ids = rng.normal(size=(30, 5)), rng.integers(0, 3, 30), np.arange(30) * 977
    theta = H.Head.initial(5, 4, 3, seed=2).flat() + rng.normal(scale=0.3, size=4 * 5 + 4 + 3 * 4 + 3)
    f = lambda t: H.loss_and_gradient(H.Head.unflat(t, 5, 4, 3), x, y, ids, loss, dropout, 7)
    grad = f(theta)[1]
    for i in range(len(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        assert grad[i] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-6, abs=1e-5)


def test_dropout_mask_is_seeded_and_has_the_rate():
    ids = np.arange(-2000, 2000)
    m = H.dropout_mask(ids, 50, 0, 0.15, 3)
    assert set(np.unique(m)) == {0.0, 1 / 0.85}
    assert (m == 0).mean() == pytest.approx(0.15, abs=0.005)
    assert np.abs((m == 0).mean(axis=0) - 0.15).max() < 0.03 and np.abs((m == 0).mean(axis=1).mean() - 0.15) < 0.005
    assert (m == H.dropout_mask(ids, 50, 0, 0.15, 3)).all()
    assert (m[5:9] == H.dropout_mask(ids[5:9], 50, 0, 0.15, 3)).all()  # whatever the batch
    for other in (H.dropout_mask(ids, 50, 1, 0.15, 3), H.dropout_mask(ids, 50, 0, 0.15, 4)):
        assert ((m == 0) & (other == 0)).mean() == pytest.approx(0.15 ** 2, abs=0.004)
    assert H.dropout_mask(ids, 50, 0, 0.0, 3) == 1.0


def test_lbfgs_reaches_the_minimum():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 6))
    q, b = a.T @ a + 0.1 * np.eye(6), rng.normal(size=6)
    theta, values = H.lbfgs(lambda t: (0.5 * t @ q @ t - b @ t, q @ t - b), np.zeros(6), 100, tol=1e-9)
    assert np.allclose(theta, np.linalg.solve(q, b), atol=1e-6)
    assert all(x >= y for x, y in zip(values, values[1:]))


@pytest.fixture(scope="module")
def rings(spark):
    """Classes that no linear head tells apart: inside and outside of a ring."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 2))
    pdf = pd.DataFrame({"id": np.arange(600), "v": v.tolist(), "label": (np.hypot(*v.T) > 1.2).astype(int)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("loss", H.LOSSES)
def test_fit_learns_and_does_not_depend_on_partitions(rings, loss):
    pdf, df = rings
    args = dict(vec_col="v", label_col="label", id_col="id", dim=2, num_labels=2, hidden=8, loss=loss, dropout=0.02, max_iter=25)
    head, values = H.fit_head(df, **args)
    assert values[-1] < values[0] and all(a >= b for a, b in zip(values, values[1:]))
    got = H.head_predict(df, head, "v").toPandas().sort_values("id")
    if loss == "softmax":  # self_adj_dice is least where the label's probability is one half
        assert (got.prediction.to_numpy() == pdf.label.to_numpy()).mean() > 0.93
    assert np.allclose(np.stack(got.logits.to_numpy()), head.logits(np.array(pdf.v.tolist())))
    whole, first = H.fit_head(df.coalesce(1), **{**args, "max_iter": 3}), H.fit_head(df, **{**args, "max_iter": 3})
    assert np.allclose(whole[1], first[1], rtol=1e-9)


def test_odd_rows_and_bad_arguments(spark, rings):
    _, df = rings
    odd = spark.createDataFrame([(900, None, 1), (901, [1.0], 1), (902, [1.0, float("nan")], 0), (903, [None, 1.0], 1),
                                 (904, [1.0, float("inf")], 0), (905, [0.5, 0.5], None)], "id long, v array<double>, label int")
    args = dict(vec_col="v", label_col="label", id_col="id", dim=2, num_labels=2, hidden=3, max_iter=2)
    some = df.where("id < 50").select("id", "v", F.col("label").cast("int").alias("label"))
    assert np.allclose(H.fit_head(some, **args)[1], H.fit_head(some.unionByName(odd), **args)[1])
    head = H.Head.initial(2, 3, 2)
    got = {r.id: r.logits is None for r in H.head_predict(odd, head, "v").collect()}
    assert got == {900: True, 901: True, 902: True, 903: True, 904: True, 905: False}
    assert H.head_predict(odd.limit(0), head, "v").count() == 0
    with pytest.raises(ValueError, match="no row"):
        H.fit_head(odd, **args)
    with pytest.raises(ValueError, match="labels from"):
        H.fit_head(some.withColumn("label", F.lit(2)), **args)
    with pytest.raises(ValueError, match="unknown loss"):
        H.fit_head(some, **args, loss="hinge")
    with pytest.raises(ValueError, match="dropout"):
        H.fit_head(some, **args, dropout=1.0)
