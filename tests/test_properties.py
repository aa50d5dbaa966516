"""Property-based checks (randomised invariants) of the row-local vector functions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from embedframe.functions import vectors as V

finite = st.floats(min_value=-7e4, max_value=7e4, allow_nan=False, allow_infinity=False, width=32)
vectors = st.lists(finite, min_size=1, max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(vectors, min_size=1, max_size=8))
def test_half_round_equals_numpy_float16(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    got = [list(r.h) for r in df.select(V.half_round("v").alias("h")).collect()]
    for g, r in zip(got, rows):
        with np.errstate(over="ignore"):  # beyond 65504 both sides give ±infinity
            want = np.asarray(r, dtype=np.float64).astype(np.float16).astype(np.float64)
        assert np.array_equal(np.asarray(g), want)


@settings(max_examples=25, deadline=None)
@given(st.lists(vectors, min_size=1, max_size=8))
def test_bit_packing_round_trip(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    got = df.select(V.quantize_ubinary("v").alias("u"), V.unpack_bits(V.quantize_binary("v")).alias("b")).collect()
    for g, r in zip(got, rows):
        bits = np.asarray(r) > 0
        assert list(g.u) == np.packbits(bits).tolist()
        assert list(g.b)[: len(r)] == bits.astype(int).tolist()


@settings(max_examples=20, deadline=None)
@given(st.integers(min_value=1, max_value=12).flatmap(
    lambda d: st.lists(st.tuples(st.lists(st.floats(0, 10, allow_nan=False), min_size=d, max_size=d),
                                 st.lists(st.floats(0, 10, allow_nan=False), min_size=d, max_size=d)),
                       min_size=1, max_size=6)))
def test_tanimoto_symmetric_and_bounded_on_non_negative(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = df.select(V.tanimoto("a", "b").alias("ab"), V.tanimoto("b", "a").alias("ba")).collect()
    for r in got:
        assert abs(r.ab - r.ba) < 1e-12
        assert -1e-12 <= r.ab <= 1 + 1e-12
