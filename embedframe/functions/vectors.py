"""Column builders for vector maths on ``array<float>`` / ``array<double>`` columns.

Everything is a plain ``pyspark.sql.functions`` expression, so it runs in the JVM next to
the scan.  All maths is done in double: each element is cast before it is multiplied.

Higher-order array functions are not whole-stage code generated.  They are the right tool
for per-row work that grows linearly with the table (paired similarities, truncation,
quantisation).  The quadratic query x corpus work of nearest-neighbour search is done by
``operators.knn`` with blocked numpy matrix products instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from .. import constants as C

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dbl(x: Column) -> Column:
    return x.cast("double")


def as_double(v: ColumnLike) -> Column:
    return F.transform(_c(v), _dbl)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Σ a_i·b_i in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: _dbl(x) * _dbl(y))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a: ColumnLike) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + _dbl(x) * _dbl(x))


def l2_norm(a: ColumnLike) -> Column:
    return F.sqrt(sq_norm(a))


def scale(a: ColumnLike, factor: Column) -> Column:
    """Multiply every element by one per-row scalar; the scalar is evaluated once per row."""
    a = _c(a)
    return F.zip_with(a, F.array_repeat(factor, F.size(a)), lambda x, s: _dbl(x) * s)


def normalize(a: ColumnLike) -> Column:
    """Unit length; a zero vector stays zero."""
    n = l2_norm(a)
    return scale(a, F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(1.0)))


def truncate(a: ColumnLike, d: int | Column) -> Column:
    """First ``d`` components, no renormalisation."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.slice(_c(a), F.lit(1), d)


def truncate_renorm(a: ColumnLike, d: int | Column) -> Column:
    """Truncate and renormalise, but only when the vector is longer than ``d``."""
    a = _c(a)
    d = F.lit(d) if isinstance(d, int) else d
    return F.when(F.size(a) > d, normalize(F.slice(a, F.lit(1), d))).otherwise(as_double(a))


# --- similarities -------------------------------------------------------------------------

def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """x̂·ŷ; 0 when either side is the zero vector."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def cosine_paired(a: ColumnLike, b: ColumnLike) -> Column:
    """1 − ½‖x̂ − ŷ‖² with zero rows left at zero: (0, unit) → 0.5, (0, 0) → 1."""
    na, nb = l2_norm(a), l2_norm(b)
    ia = F.when(na > 0, 1.0).otherwise(0.0)
    ib = F.when(nb > 0, 1.0).otherwise(0.0)
    return F.lit(1.0) - F.lit(0.5) * (ia + ib - F.lit(2.0) * cosine(a, b))


def euclidean(a: ColumnLike, b: ColumnLike) -> Column:
    """Negative Euclidean distance (larger is more similar)."""
    d2 = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (_dbl(x) - _dbl(y)) * (_dbl(x) - _dbl(y))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return -F.sqrt(d2)


def manhattan(a: ColumnLike, b: ColumnLike) -> Column:
    """Negative L1 distance."""
    d1 = F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: F.abs(_dbl(x) - _dbl(y))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return -d1


TANIMOTO_EPS = C.TANIMOTO_EPS


def tanimoto(a: ColumnLike, b: ColumnLike) -> Column:
    """Continuous Tanimoto ⟨x,y⟩ / max(Σx² + Σy² − ⟨x,y⟩, 1e-9)."""
    d = dot(a, b)
    return d / F.greatest(sq_norm(a) + sq_norm(b) - d, F.lit(TANIMOTO_EPS))


def tanimoto_bits(a: ColumnLike, b: ColumnLike) -> Column:
    """|a ∩ b| / |a ∪ b| of two on-bit lists; NULL if either is missing, 0 if both are empty."""
    a, b = _c(a), _c(b)
    inter = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(F.array_union(a, b)).cast("double")
    value = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(value)


def tanimoto_packed(a: ColumnLike, b: ColumnLike) -> Column:
    """``tanimoto_bits`` of fingerprints packed into integers: bit counts of AND and OR."""
    a, b = _c(a), _c(b)

    def ones(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))

    inter = ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))).cast("double")
    union = ones(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))).cast("double")
    value = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(value)


def angle(a: ColumnLike, b: ColumnLike) -> Column:
    """Angle similarity in the complex plane (AnglE): each vector is split into a real and an
    imaginary half; the value is |Σ(ac + bd + bc − ad)| / (‖x‖·‖y‖)."""
    a, b = _c(a), _c(b)
    half = (F.size(a) / 2).cast("int")
    re_x, im_x = F.slice(a, F.lit(1), half), F.slice(a, half + 1, half)
    re_y, im_y = F.slice(b, F.lit(1), half), F.slice(b, half + 1, half)
    s = dot(re_x, re_y) + dot(im_x, im_y) + dot(im_x, re_y) - dot(re_x, im_y)
    nx = F.sqrt(sq_norm(re_x) + sq_norm(im_x))
    ny = F.sqrt(sq_norm(re_y) + sq_norm(im_y))
    return F.when((nx > 0) & (ny > 0), F.abs(s) / (nx * ny)).otherwise(F.lit(0.0))


SimilarityFn = Callable[[ColumnLike, ColumnLike], Column]

_SIMILARITIES: dict[str, SimilarityFn] = {
    "tanimoto": tanimoto,
    "cosine": cosine,
    "dot": dot,
    "dot_product": dot,
    "euclidean": euclidean,
    "manhattan": manhattan,
}
DEFAULT_SIMILARITY = C.DEFAULT_SIMILARITY


def possible_values() -> list[str]:
    return sorted(_SIMILARITIES)


def register_similarity(name: str, fn: SimilarityFn, *, overwrite: bool = False) -> None:
    """Add another similarity name (``custom_similarity``)."""
    key = name.lower()
    if key in _SIMILARITIES and not overwrite:
        raise ValueError(f"similarity {name!r} already registered")
    _SIMILARITIES[key] = fn


def by_name(name: str | None) -> SimilarityFn:
    """Dispatcher: ``None`` gives the default (cosine); unknown names raise."""
    key = (name or DEFAULT_SIMILARITY).lower()
    if key not in _SIMILARITIES:
        raise ValueError(f"unknown similarity {name!r}; expected one of {possible_values()}")
    return _SIMILARITIES[key]


def similarity(name: str | None, a: ColumnLike, b: ColumnLike) -> Column:
    return by_name(name)(a, b)


# --- precision reduction ------------------------------------------------------------------

def half_round_scalar(x: Column) -> Column:
    """Round a double to the nearest IEEE-754 half value (ties to even), kept as a double.

    ulp = 2^(max(floor(log2|x|), −14) − 10); beyond the largest half (65504) → ±infinity.
    """
    x = _dbl(x)
    e = F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14.0))
    ulp = F.pow(F.lit(2.0), e - F.lit(10.0))
    r = F.rint(x / ulp) * ulp
    inf = F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (
        F.when(x.isNull(), F.lit(None).cast("double"))
        .when(x == 0, x)
        .when(F.isnan(x), x)
        .when(F.abs(r) > C.HALF_MAX, inf)
        .otherwise(r)
    )


def half_round(a: ColumnLike) -> Column:
    return F.transform(_c(a), half_round_scalar)


def quantize_ubinary(a: ColumnLike) -> Column:
    """Bit = x > 0, packed 8 per byte, most significant bit first; last byte zero padded."""
    a = _c(a)
    n_bytes = ((F.size(a) + 7) / 8).cast("int")

    def byte_at(i: Column) -> Column:
        bits = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda k: F.when((i * 8 + k < F.size(a)) & (F.get(a, i * 8 + k) > 0), F.lit(1)).otherwise(F.lit(0)),
        )
        return F.aggregate(bits, F.lit(0), lambda acc, b: acc * 2 + b).cast("smallint")

    return F.transform(F.sequence(F.lit(0), n_bytes - 1), byte_at)


def quantize_binary(a: ColumnLike) -> Column:
    """Signed variant: unsigned byte − 128."""
    return F.transform(quantize_ubinary(a), lambda b: (b - 128).cast("smallint"))


def unpack_bits(packed: ColumnLike, signed: bool = True) -> Column:
    """Packed bytes → 0/1 array (8 entries per byte, most significant first)."""
    p = _c(packed)
    offset = 128 if signed else 0
    return F.flatten(
        F.transform(
            p,
            lambda b: F.transform(
                F.sequence(F.lit(7), F.lit(0), F.lit(-1)),
                lambda k: (F.floor((b.cast("int") + offset) / F.pow(F.lit(2.0), k)) % 2).cast("int"),
            ),
        )
    )


# --- scores -------------------------------------------------------------------------------

def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def composite_score(score: ColumnLike, sim: ColumnLike, score_cutoff: float = C.SCORE_CUTOFF,
                    sim_cutoff: float = C.SIMILARITY_CUTOFF) -> Column:
    """clip(score/score_cutoff, 0, 1) + clip(sim/sim_cutoff, 0, 1), in [0, 2]."""
    return clip01(_dbl(_c(score)) / F.lit(score_cutoff)) + clip01(_dbl(_c(sim)) / F.lit(sim_cutoff))


def argmax(v: ColumnLike) -> Column:
    """0-based position of the first maximum."""
    v = _c(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def logsumexp(v: ColumnLike) -> Column:
    """log Σ exp(x), shifted by the maximum so large values do not overflow."""
    v = _c(v)
    m = F.array_max(as_double(v))
    s = F.aggregate(F.zip_with(v, F.array_repeat(m, F.size(v)), lambda x, mm: F.exp(_dbl(x) - mm)), F.lit(0.0), lambda acc, x: acc + x)
    return m + F.log(s)


def round_array(a: ColumnLike, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda x: F.round(_dbl(x), digits))
