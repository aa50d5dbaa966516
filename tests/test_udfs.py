"""Encoder, scorer and generator plug points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedframe.functions import udfs as U
from embedframe.functions import vectors as V


def _texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_embed_batches_shapes_norms_and_determinism(spark):
    df = _texts(spark, [(1, "CCO"), (2, "CC(C)O"), (3, "c1ccccc1"), (4, "C" * 500), (5, "!@#$%^&*()"), (6, None)])
    out = {r.id: r.embedding for r in U.embed_batches(df, "text", truncate_dim=16, batch_size=2).collect()}
    assert all(len(v) == 16 for v in out.values())
    for i in (1, 2, 3, 4):
        assert np.linalg.norm(out[i]) == pytest.approx(1.0) or np.linalg.norm(out[i]) == 0.0
    assert np.linalg.norm(out[5]) == 0.0 and np.linalg.norm(out[6]) == 0.0  # no tokens → zero vector
    again = {r.id: r.embedding for r in U.embed_batches(df, "text", truncate_dim=16).collect()}
    assert again == out
    empty = U.embed_batches(df.where("id < 0"), "text")
    assert empty.count() == 0
    binary = U.embed_batches(df, "text", precision="binary").where("id = 1").first().embedding
    assert set(binary) <= {0.0, 1.0}
    with pytest.raises(ValueError):
        U.embed_batches(df, "text", precision="int4")


def test_self_similarity_is_one(spark):
    df = _texts(spark, [(1, "alpha beta gamma"), (2, "delta")])
    e = U.embed_batches(df, "text")
    sims = [r.s for r in e.select(V.cosine("embedding", "embedding").alias("s")).collect()]
    assert sims == pytest.approx([1.0, 1.0])


def test_scorers(spark):
    df = _texts(spark, [(1, "Ab 12"), (2, "")])
    got = {r.id: r for r in df.select("id", *[U.score_function(n)(F.col("text")).alias(n)
                                              for n in ("n_chars", "n_tokens", "digit_ratio", "upper_ratio")]).collect()}
    assert (got[1].n_chars, got[1].n_tokens, got[1].digit_ratio, got[1].upper_ratio) == (5.0, 2.0, 0.4, 0.2)
    assert got[2].digit_ratio == 0.0
    with pytest.raises(ValueError, match="expected one of"):
        U.score_function("qed")
    U.register_scorer("twice_len", lambda t: F.length(t) * 2.0, overwrite=True)
    assert df.select(U.score_function("twice_len")(F.col("text")).alias("x")).first().x == 10.0


def test_generator_errors_give_no_candidates(spark):
    df = _texts(spark, [(1, "a.b.c"), (2, "boom.x"), (3, "single")]).withColumn("lane", F.col("id") % 2)

    def factory():
        base = U.sentence_drop_generator(2)()

        def gen(text):
            if text.startswith("boom"):
                raise RuntimeError("service failed")
            return base(text)
        return gen

    rows = U.generate_candidates(df, "id", "text", "lane", factory).collect()
    assert sorted((r.id, r.cand_idx, r.candidate) for r in rows if r.error is None) == [(1, 0, "b.c"), (1, 1, "a.c")]
    assert [(r.id, r.error) for r in rows if r.error] == [(2, "RuntimeError: service failed")]


def test_custom_similarity_registry():
    V.register_similarity("cos_sq_test", U.cosine_squared, overwrite=True)
    assert V.by_name("cos_sq_test") is U.cosine_squared
    with pytest.raises(ValueError):
        V.register_similarity("cosine", U.cosine_squared)
