"""What a worker holds at once in the per-row pieces."""

import numpy as np
import pytest

from embedframe.functions import udfs as U


@pytest.mark.parametrize("rows", [0, 1, 600])
def test_workers_hold_a_batch(spark, rows, monkeypatch):
    def encoder():
        def encode(texts):
            assert len(texts) <= 100
            return np.array([[len(t), 1.0] for t in texts], float).reshape(-1, 2)
        return encode

    df = spark.range(rows).selectExpr("id", "repeat('x', int(id % 7)) as text", "0 as lane").coalesce(1)
    got = U.embed_batches(df, "text", "v", encoder, batch_size=100, normalize=False).select("id", "v").collect()
    assert {r["id"]: r["v"] for r in got} == {i: [float(i % 7), 1.0] for i in range(rows)}
    monkeypatch.setattr(U, "CANDIDATE_ROWS", 50)
    made = U.generate_candidates(df, "id", "text", "lane", lambda: lambda t: [t + "a", t + "b"]).collect()
    assert sorted((r["id"], r["candidate"]) for r in made) == [(i, "x" * (i % 7) + c) for i in range(rows) for c in "ab"]
