"""Similarity maths and vector transforms (invariants of the reference's similarity tests)."""

import base64
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedframe.functions import vectors as V
from embedframe.functions.images import image_dims


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "a array<double>, b array<double>")


def _val(spark, fn, a, b):
    return _pairs(spark, [(a, b)]).select(fn("a", "b").alias("v")).first()["v"]


def test_tanimoto_hand_values(spark):
    assert _val(spark, V.tanimoto, [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]) == pytest.approx(20 / 23)
    assert _val(spark, V.tanimoto, [2.0, 3.0, 4.0], [1.0, 1.0, 1.0]) == pytest.approx(9 / (29 + 3 - 9))
    assert _val(spark, V.tanimoto, [1.0, 0.0], [0.0, 1.0]) == 0.0
    assert math.isfinite(_val(spark, V.tanimoto, [0.0, 0.0, 0.0], [1.0, 2.0, 3.0]))


@pytest.mark.parametrize("name", ["tanimoto", "cosine", "dot", "euclidean", "manhattan"])
def test_symmetry_and_identity(spark, name):
    rng = np.random.default_rng(1)
    rows = [(rng.random(8).tolist(), rng.random(8).tolist()) for _ in range(20)]
    df = _pairs(spark, rows)
    fn = V.by_name(name)
    got = df.select(fn("a", "b").alias("ab"), fn("b", "a").alias("ba"), fn("a", "a").alias("aa")).collect()
    for r, (a, _) in zip(got, rows):
        assert r.ab == pytest.approx(r.ba)
        if name in ("tanimoto", "cosine"):
            assert r.aa == pytest.approx(1.0)
            assert 0.0 <= r.ab <= 1.0 + 1e-12  # non-negative data
        if name in ("euclidean", "manhattan"):
            assert r.aa == pytest.approx(0.0)
            assert r.ab <= 0.0
        if name == "dot":
            assert r.aa == pytest.approx(float(np.dot(a, a)))


def test_cosine_zero_conventions(spark):
    assert _val(spark, V.cosine, [0.0, 0.0], [1.0, 0.0]) == 0.0
    assert _val(spark, V.cosine_paired, [0.0, 0.0], [1.0, 0.0]) == pytest.approx(0.5)
    assert _val(spark, V.cosine_paired, [0.0, 0.0], [0.0, 0.0]) == pytest.approx(1.0)
    assert _val(spark, V.cosine_paired, [1.0, 2.0], [2.0, 4.0]) == pytest.approx(1.0)


def test_dispatcher():
    assert V.by_name(None) is V.cosine
    assert V.by_name("DOT") is V.by_name("dot_product")
    with pytest.raises(ValueError, match="expected one of"):
        V.by_name("hamming")
    assert "manhattan" in V.possible_values()


def test_tanimoto_bits(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), (None, [1])], "a array<int>, b array<int>")
    got = [r.v for r in df.select(V.tanimoto_bits("a", "b").alias("v")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == 0.0 and got[2] is None


def test_half_round_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e-5, 200), rng.normal(0, 1e4, 100),
                           [0.0, 1.0, -1.0, 65504.0, 70000.0, -70000.0, 6e-8, 2.98e-8]])
    df = spark.createDataFrame([(vals.tolist(),)], "v array<double>")
    got = np.array(df.select(V.half_round("v").alias("h")).first()["h"])
    want = vals.astype(np.float16).astype(np.float64)
    assert np.array_equal(got, want)


def test_binary_quantisation_matches_packbits(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(0, 1, (20, 13))
    df = spark.createDataFrame([(r.tolist(),) for r in vals], "v array<double>")
    got = df.select(V.quantize_ubinary("v").alias("u"), V.quantize_binary("v").alias("s"),
                    V.unpack_bits(V.quantize_binary("v")).alias("bits")).collect()
    for r, v in zip(got, vals):
        packed = np.packbits(v > 0)
        assert list(r.u) == packed.tolist()
        assert list(r.s) == (packed.astype(int) - 128).tolist()
        assert list(r.bits)[: len(v)] == (v > 0).astype(int).tolist()


def test_truncation(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],)], "v array<double>")
    r = df.select(V.truncate("v", 2).alias("t"), V.truncate_renorm("v", 2).alias("tr"),
                  V.truncate_renorm("v", 3).alias("same")).first()
    assert list(r.t) == [3.0, 4.0]
    assert list(r.tr) == pytest.approx([0.6, 0.8])
    assert list(r.same) == [3.0, 4.0, 12.0]


def test_angle_matches_complex_formula(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=8), rng.normal(size=8)
    za, zb = a[:4] + 1j * a[4:], b[:4] + 1j * b[4:]
    z = za / zb * np.abs(zb) ** 2  # (a + bi)(c − di)
    want = abs(z.real.sum() + z.imag.sum()) / (np.linalg.norm(a) * np.linalg.norm(b))
    assert _val(spark, V.angle, a.tolist(), b.tolist()) == pytest.approx(want)


def _png(width: int, height: int) -> str:
    header = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x06\x00\x00\x00"
    return "data:image/png;base64," + base64.b64encode(header + b"\x00" * 16).decode()


def test_image_dims(spark):
    junk = "data:image/png;base64," + base64.b64encode(b"not a png at all, just text").decode()
    df = spark.createDataFrame([(_png(212, 194),), (_png(1, 65535),), (junk,), (None,)], "img string")
    got = [tuple(r) for r in df.select(image_dims("img")).collect()]
    assert got == [(212, 194), (1, 65535), (None, None), (None, None)]
