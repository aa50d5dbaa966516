import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embedframe.llm import bit_sliced, pstable, queries
from embedframe.llm.common import table

from ..conftest import SF001

SCHEMA = "vec_id long, embedding array<float>, label int, q string, class int, bucket string"


def odd_rows():
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * (i % 3), -0.2, 0.05 * i], i % 2, "x", 1, "y") for i in range(1, 12)]
    return good + [(20, None, 1, None, None, None), (40, [nan, 1.0, 0.0], 1, None, None, None), (60, [inf, 1.0, 0.0], 1, None, None, None),
                   (80, [None, 1.0, 0.0], 1, None, None, None), (100, [0.0, 0.0, 0.0], 1, None, None, None), (120, [], 1, None, None, None),
                   (140, [0.1, -0.2, 0.05], None, None, None, None), (None, [0.1, -0.2, 0.05], 1, None, None, None),
                   (160, [1.0, 2.0], 0, None, None, None), (0, [0.3, -0.2, 0.1], 0, None, None, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.integers(1, 25), st.integers(0, 2 ** 31), st.integers(1, 500))
def test_slices_against_sorting(n, dims, k, seed, reach):
    r = np.random.default_rng(seed)
    x = r.integers(-reach, reach + 1, (n, dims))
    ids = np.sort(r.choice(1000, n, replace=False)).astype(np.int64)
    q = r.integers(-reach, reach + 1, dims)
    own = int(ids[0]) if seed % 2 else None
    score = x @ q
    want = sorted(((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != own))[:k]
    assert bit_sliced.Slices.build(ids, x).top(q, k, own) == [(i, -s) for s, i in want]


def test_blocks_of_any_size_give_the_same(spark):
    vectors = table(spark, SF001, "embeddings")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    want = sorted(con.sql(queries.ORACLE["op1_bit_sliced_topk"]).fetchall())
    for block in (1 << 16, 70):
        rows = bit_sliced.top_k(vectors, F.col("id") % 20 == 0, block_rows=block)
        assert sorted(map(tuple, rows.collect())) == want


def test_top_k_edge_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = bit_sliced.top_k(df, F.lit(True), k=4).collect()
    floor = {r[0]: np.floor(64 * np.array(r[1], np.float32).astype(float)) for r in odd_rows()
             if r[0] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1])}
    for i, v in floor.items():
        want = sorted((-int(v @ w), j) for j, w in floor.items() if j != i and len(w) == len(v))[:4]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == set(floor) - {160}
    assert bit_sliced.top_k(df.limit(0), F.lit(True)).count() == 0


def linked(rows, threshold=0.93):
    """id -> (links, smallest id reachable), by comparing all pairs."""
    ok = [(i, np.array(v, np.float64), y) for i, v, y in rows if v is not None and y is not None and len(v) and np.isfinite(v).all() and np.any(v)]
    links, label = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    for a in range(len(ok)):
        for b in range(a):
            (i, v, y), (j, w, z) = ok[a], ok[b]
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if x == hi else x for k, x in label.items()}
    return {i: (links[i], label[i]) for i in links}


def clustered(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 16))
    rows = []
    for i in range(n):
        v = centres[r.integers(0, 6)] + r.normal(size=16) * r.choice([0.02, 0.1, 0.3, 2.0])
        rows.append((int(i), (v * r.choice([1, 3])).astype(np.float32).tolist(), int(i % 2)))
    return rows + [(n + i, rows[0][1], 0) for i in range(30)]  # a group of copies


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rows = clustered(3, 300)
    want = linked(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    for block in (4096, 9):
        monkeypatch.setattr(pstable, "BLOCK_ROWS", block)
        got = {r["vec_id"]: r for r in pstable.near_duplicates(df).collect()}
        assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
        assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
        assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.98 * len(want)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_edge_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pstable.near_duplicates(df).collect()}
    rows = [(r[0], r[1], r[2]) for r in odd_rows() if r[0] is not None and not (r[1] and None in r[1])]
    for i, w in linked(rows).items():
        assert got[i] == w
    assert got[80] == (0, 80) and got[None] == (0, None)
    assert pstable.near_duplicates(df.limit(0)).count() == 0
