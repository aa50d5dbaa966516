import math

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embedframe.llm import hard_negatives as hn
from embedframe.llm import queries
from embedframe.llm.common import table

from ..conftest import SF001

SCHEMA = "vec_id long, embedding array<double>, label int, id long, stats string, pos int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_sorting(rows, anchor, k=5, scale=256, low=80, high=100):
    """The result by scoring every pair with Python integers."""
    ok = {}
    for i, v, y, *_ in rows:
        if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v):
            here = (str(y), [x * scale for x in v])
            ok[i] = min(ok.get(i, here), here)
    ok = {i: (y, [math.floor(x) for x in v]) for i, (y, v) in ok.items()}
    score = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * z for x, z in zip(a, b, strict=True))))
    out = []
    for i, (y, v) in ok.items():
        if not anchor(i):
            continue
        others = sorted((-score(v, w), j, z == y) for j, (z, w) in ok.items() if j != i and len(w) == len(v))
        for s, p, _ in [o for o in others if o[2]][:k]:
            found = [(n, j) for n, j, same in others if not same and low * -s <= 100 * -n <= high * -s][:k]
            out += [(i, p, r, j, -s, -n) for r, (n, j) in enumerate(found, 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def clustered(seed, n, dims=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims)) + 1
    return [(i, (centres[r.integers(0, 5)] + r.normal(size=dims) * r.choice([0.0, 0.05, 0.5])).tolist(), int(r.integers(0, 3)), 1, "x", 2) for i in range(n)]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 70), st.integers(0, 2 ** 31), st.sampled_from([1, 30, 10 ** 4, 10 ** 12]))
def test_bounds_hold_scores(n, dims, seed, reach):
    r = np.random.default_rng(seed)
    x = np.floor(r.normal(size=(n, dims)) * reach + reach * r.normal())
    y = np.floor(r.normal(size=(7, dims)) * reach)
    score = x @ y.T
    widths = []
    for a, b in zip(hn.steps_of(hn.summaries(x), dims), hn.steps_of(hn.summaries(y), dims), strict=True):
        lo, hi = hn.bounds(a, b)
        assert (lo <= score).all() and (score <= hi).all()
        widths.append((hi - lo).sum())
    assert all(fine <= coarse * (1 + 1e-6) + 1e-3 for coarse, fine in zip(widths, widths[1:]))


def test_segments_spare_most_scores_of_clustered_rows():
    rows = clustered(1, 3000, 64)
    x = np.floor(np.array([r[1] for r in rows]) * 256)
    steps = hn.steps_of(hn.summaries(x), 64)
    score = hn.exact_scores(x[:50], x)
    high = np.sort(score, axis=1)[:, -20][:, None]
    counts = {}
    got = list(hn.best_in_windows(x[:50], [(m[:50], d[:50]) for m, d in steps], x, steps, np.arange(3000), np.ones((50, 3000), bool),
                                  high * 80 // 100, high, 5, counts))
    assert len(got) == 50 and counts["scored"] < 0.5 * 50 * 3000
    for r, _, ids, s in got:
        want = sorted((-v, j) for j, v in enumerate(score[r].tolist()) if high[r, 0] * 80 // 100 <= v <= high[r, 0])[:5]
        assert [(-v, j) for v, j in zip(s.tolist(), ids.tolist(), strict=True)] == want


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = clustered(2, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = by_sorting(rows, lambda i: i % 10 == 0)
    assert want
    for anchors, block, tile in ((16384, 8192, 2048), (7, 60, 11)):
        monkeypatch.setattr(hn, "ANCHOR_BLOCK", anchors)
        monkeypatch.setattr(hn, "ROW_BLOCK", block)
        monkeypatch.setattr(hn, "ROW_TILE", tile)
        assert collected(hn.mine(df, F.col("id") % 10 == 0)) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.01 * (i % 4), -0.2, 0.03 * i], i % 2, 1, "x", 2) for i in range(1, 14)] + [
        (20, None, 1, None, None, None), (40, [nan, 1.0, 0.0], 1, None, None, None), (60, [inf, 1.0, 0.0], 1, None, None, None),
        (80, [None, 1.0, 0.0], 1, None, None, None), (100, [0.0, 0.0, 0.0], 1, None, None, None), (120, [], 1, None, None, None),
        (140, [0.1, -0.2, 0.05], None, None, None, None), (None, [0.1, -0.2, 0.05], 1, None, None, None),
        (160, [1.0, 2.0], 0, None, None, None), (161, [1.0, 1.9], 0, None, None, None), (162, [1.0, 1.8], 1, None, None, None),
        (200, [1e9, 2e9, -3e9], 0, None, None, None), (201, [1e9, 2e9, -3e9], 1, None, None, None), (202, [1e9, 1.9e9, -3e9], 0, None, None, None),
        (210, [1e300, 2.0, 1.0], 0, None, None, None), (1, [0.5, 0.5, 0.5], 1, None, None, None)]
    rows += [rows[2]] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(hn.mine(df, F.lit(True))) == by_sorting(rows, lambda i: True)
    assert hn.mine(df.limit(0), F.lit(True)).count() == 0


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op13_hard_negatives']})").fetchall()
    assert collected(queries.op13_hard_negatives(spark, SF001)) == sorted(want) and want
    assert table(spark, SF001, "embeddings").count() == 500
