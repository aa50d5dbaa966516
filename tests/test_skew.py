"""A key holding a third of all rows: results stay exact (compared with pandas)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from embedframe.operators import candidates as C
from embedframe.operators import metrics as M
from embedframe.operators import prep as P
from embedframe.operators.knn import exact_quantiles
from embedframe.operators.ordering import average_ranks


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": rng.normal(size=n).round(2),
                        "text": np.where(g == 0, "same text", [f"t{i}" for i in range(n)])})
    pdf["y"] = (pdf.x + rng.normal(0, 0.5, n)).round(2)
    return pdf, spark.createDataFrame(pdf)


def test_dedupe_hot_key(hot):
    pdf, df = hot
    got = sorted(r.id for r in P.dedupe_keep_first(df.select("id", "text"), ["text"], "id").collect())
    assert got == sorted(pdf.sort_values("id").drop_duplicates("text").id)


def test_topk_and_best_hot_group(hot):
    pdf, df = hot
    order = [F.col("x").desc(), F.col("id")]
    got = sorted(r.id for r in C.topk_per_group(df, ["g"], order, 5, reference_quirk=False).collect())
    want = sorted(pdf.sort_values(["x", "id"], ascending=[False, True]).groupby("g").head(5).id)
    assert got == want
    best = sorted(r.id for r in C.best_per_group(df.select("g", "id", "x"), ["g"], "x", ["id"]).collect())
    assert best == sorted(pdf.sort_values(["x", "id"], ascending=[False, True]).groupby("g").head(1).id)


def test_spearman_and_quantiles_hot_group(hot):
    pdf, df = hot
    sp = M.spearman(df, "x", "y", ["g"], digits=None).toPandas().set_index("g")["spearman"]
    part = pdf[pdf.g == 0]
    assert sp[0] == pytest.approx(part.x.rank().corr(part.y.rank()), abs=1e-9)
    q = exact_quantiles(df, ["g"], "x", [0.5]).where("g = 0").first()
    assert q.value == pytest.approx(np.quantile(part.x, 0.5))


def test_average_ranks_with_frequent_values_and_nulls(spark):
    rng = np.random.default_rng(3)
    n = 4000
    v = np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 900, n).astype(float))  # half of the rows on one value
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(rng.random(n) < 0.4, "a", "b"), "v": v})
    pdf.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn(
        "g", F.when(F.col("g") == "a", F.col("g")))  # one group is NULL
    got = average_ranks(df, "v", ["g"]).toPandas().set_index("id").sort_index()
    assert len(got) == n
    want = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    assert average_ranks(df.limit(0), "v", ["g"]).count() == 0
    same = df.withColumn("v", F.lit(1.0))
    assert {r["rank"] for r in average_ranks(same, "v").select("rank").distinct().collect()} == {(n + 1) / 2}


def test_frequent_values_make_no_hot_task(spark):
    """Half of the rows share a value; the join that serves the other values spreads them."""
    df = spark.range(0, 20000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    ranked = average_ranks(df, "v")
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and ranked.where("v = -1").select("rank").distinct().collect()[0][0] == 5000.5
    shuffled = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" in shuffled and max(sizes) < 20000 * 0.6
