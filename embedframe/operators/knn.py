"""Exact k-nearest-neighbour search and the retrieval benchmark built on it.

There is one plan, whatever the table sizes: nothing is collected or shipped by the driver.
Where the metric allows it (cosine, euclidean, manhattan) and ``pivots`` are asked for, rows lie in
the cells of a few pivots; each query meets its own cell first, and then only the cells that the
triangle inequality leaves a chance (``knn_pivots``).  Rows of a cell, or of the whole table, meet
without a cross join: both sides are hashed into blocks of bounded size, each (query
block, corpus block) pair meets in one ``cogroup`` task, numpy computes the similarities of
that block pair a tile at a time and the task emits only its local top-k per query.  A
``row_number`` window over ``(group, query)`` then merges the local lists; Catalyst adds a
partial ``WindowGroupLimit`` before that shuffle, so at most k rows per query and corpus
block cross the network.  Task memory is bounded by the vectors of two blocks and a tile whatever the
table size, and every block holds about the same number of rows because blocks come from
a hash of the row id, not from a data value (a hot ``by`` value is split like any other).

Rows whose vector is NULL or holds a NULL or non-finite component take no part: they are no query, no
neighbour and no pivot.  Vectors of different lengths don't meet; an empty vector meets empty ones, at
similarity 0.

Ordering contract (shared with the DuckDB oracle): similarity rounded to 6 decimals,
descending, ties by the smaller neighbour id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import scratch_path

METRICS = ("cosine", "dot", "dot_product", "tanimoto", "euclidean", "manhattan")


def truncate_ladder(df: DataFrame, dims: Sequence[int], vec_col: str = "embedding", dim_col: str = "dim",
                    renormalize: bool = False) -> DataFrame:
    """One row per (row, d) holding the first d components (``vec_truncate_ladder``)."""
    out = df.withColumn(dim_col, F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    trunc = V.truncate_renorm(vec_col, F.col(dim_col)) if renormalize else V.truncate(vec_col, F.col(dim_col))
    return out.withColumn(vec_col, trunc)


def _round_half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    scale = 10.0 ** digits
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


def similarity_matrix(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of every row of ``q`` with every row of ``c`` (double precision)."""
    metric = metric.lower()
    if metric == "cosine":
        qn = np.sqrt((q * q).sum(1))[:, None]
        cn = np.sqrt((c * c).sum(1))[None, :]
        denom = qn * cn
        return np.divide(q @ c.T, denom, out=np.zeros((q.shape[0], c.shape[0])), where=denom > 0)
    if metric in ("dot", "dot_product"):
        return q @ c.T
    if metric == "tanimoto":
        d = q @ c.T
        denom = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - d
        return d / np.maximum(denom, V.TANIMOTO_EPS)
    if metric == "euclidean":
        centre = c.mean(0) if len(c) else 0.0
        q, c = q - centre, c - centre
        size = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :]
        d2 = size - 2.0 * (q @ c.T)
        # digits cancel where the distance is small against the vectors: those from differences
        near = np.nonzero(d2 < 1e-3 * size)
        for i in range(0, len(near[0]), 1 << 16):
            a, b = near[0][i:i + (1 << 16)], near[1][i:i + (1 << 16)]
            d2[a, b] = ((q[a] - c[b]) ** 2).sum(1)
        return -np.sqrt(np.maximum(d2, 0.0))
    if metric == "manhattan":
        return -manhattan_distances(q, c)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is there and has no NULL, NaN or infinite component."""
    kind = df.schema[vec_col].dataType
    if not isinstance(kind, T.ArrayType):
        return df.where(F.col(vec_col).isNotNull())
    fine = lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf")))  # noqa: E731  NaN is above infinity here
    return df.where(F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), fine))


def same_length(left: pd.Series, right: pd.Series):
    """Places of the left and right vectors of each length that both sides have."""
    a, b = left.map(len).to_numpy(), right.map(len).to_numpy()
    for n in np.intersect1d(a, b):
        yield np.flatnonzero(a == n), np.flatnonzero(b == n)


def _stack(col: pd.Series, bits_width: int | None = None) -> np.ndarray:
    """Rows of a vector column as a float64 matrix; with ``bits_width`` the column holds on-bit
    index lists, expanded to dense 0/1 rows (Tanimoto on them is the Jaccard of the sets)."""
    if len(col) == 0:
        return np.zeros((0, bits_width or 0))
    if bits_width:
        out = np.zeros((len(col), bits_width), np.float32)  # counts of common bits are exact
        for i, bits in enumerate(col):
            if bits is not None and len(bits):
                out[i, np.asarray(bits, dtype=np.int64)] = 1.0
        return out
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


#: Rows of queries and of the corpus whose scores are computed at once, in a core's cache; a first tile is smaller.
TILE_QUERIES, TILE_ROWS, FIRST_ROWS = 128, 2048, 512


def pair_similarity(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of the pairs (q[i], c[j]) of rows, in double precision."""
    out, step = np.empty(len(i)), max(1, (1 << 22) // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        x, y = (m[p[at:at + step]].astype(np.float64, copy=False) for m, p in ((q, i), (c, j)))
        if metric == "euclidean":
            s = -np.sqrt(((x - y) ** 2).sum(1))
        elif metric == "manhattan":
            s = -np.abs(x - y).sum(1)
        else:
            s = np.einsum("ij,ij->i", x, y)
            if metric != "dot" and metric != "dot_product":
                xx, yy = (x * x).sum(1), (y * y).sum(1)
                if metric == "cosine":
                    denom = np.sqrt(xx) * np.sqrt(yy)
                    s = np.divide(s, denom, out=np.zeros(len(x)), where=denom > 0)
                else:
                    s = s / np.maximum(xx + yy - s, V.TANIMOTO_EPS)
        out[at:at + step] = s
    return out


def manhattan_distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, a component at a time over tiles that stay in a core's cache."""
    out, columns = np.zeros((len(q), len(c)), q.dtype), np.ascontiguousarray(c.T)
    for at in range(0, len(q), 32):
        part, total = q[at:at + 32], out[at:at + 32]
        gap = np.empty_like(total)
        for d, column in enumerate(columns):
            np.subtract(part[:, d, None], column[None, :], out=gap)
            np.abs(gap, out=gap)
            total += gap
    return out


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few true values of a tile, in its order: eight are looked at at once."""
    if mask.shape[1] % 8:
        return np.divmod(np.flatnonzero(mask), mask.shape[1])
    eights = np.flatnonzero(mask.view(np.uint64))
    at, place = np.nonzero(mask.reshape(-1, 8)[eights])
    return np.divmod(eights[at] * 8 + place, mask.shape[1])


#: Levels that components are rounded to for a first look at Manhattan distances: two of them fit a byte.
LEVELS = 127


class _Steps:
    """Manhattan distances from below: components rounded to ``LEVELS`` steps, whose smaller ones are added up as small integers.
    |x - y| is the sum of both less twice the smaller; what rounding took from a row is taken off."""

    def __init__(self, q: np.ndarray, c: np.ndarray):
        low, high = min(q.min(), c.min()), max(q.max(), c.max())
        self.step = (high - low) / LEVELS
        self.fits = q.shape[1] <= 250 and 1e-150 < self.step < 1e150
        if self.fits:
            (self.q, self.sum_q, self.off_q), (self.c, self.sum_c, self.off_c) = self._levels(q, low), self._levels(c, low)

    def _levels(self, x: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = np.clip(np.rint((x - low) / self.step), 0, LEVELS)
        off = np.abs((x - low) / self.step - level).sum(1) * (1 + 1e-9) + 1e-6
        return np.ascontiguousarray(level.T.astype(np.uint8)), level.sum(1), off

    def near(self, rows: slice, cols: slice, low: np.ndarray) -> np.ndarray:
        """Which pairs may have a similarity above ``low``."""
        shape = rows.stop - rows.start, cols.stop - cols.start
        total, part, least = np.zeros(shape, np.int16), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
        for d in range(0, len(self.q), 2):
            np.minimum(self.q[d, rows, None], self.c[d, None, cols], out=part)
            if d + 1 < len(self.q):
                np.minimum(self.q[d + 1, rows, None], self.c[d + 1, None, cols], out=least)
                part += least
            total += part
        total -= np.floor((self.sum_c[cols] - self.off_c[cols]) / 2).astype(np.int16)
        need = np.floor((self.sum_q[rows] - self.off_q[rows] + low / self.step) / 2)
        return total >= np.clip(need, -32768, 32767).astype(np.int16)[:, None]


class _Sieve:
    """Which pairs of a tile may have a rounded similarity above a query's bound: a pass over the tile's inner products,
    in single precision with room for its rounding, and again in double where that lets many pairs through.
    What passes is scored exactly.  Without ``shared`` products a sieve has its own, with the rows' norms in them."""

    def __init__(self, q: np.ndarray, c: np.ndarray, metric: str, shared: bool):
        self.metric, self.q, self.c = metric, q, c
        self.qq, self.cc = np.einsum("ij,ij->i", q, q, dtype=np.float64), np.einsum("ij,ij->i", c, c, dtype=np.float64)
        n = np.sqrt(self.cc)
        self.scale = np.divide(1.0, n, out=np.zeros(len(n)), where=n > 0)
        self.most = self.cc.max(initial=0.0)
        self.steps = _Steps(q, c) if metric == "manhattan" else None
        self.own = None
        if not shared and metric in ("cosine", "euclidean") and max(self.most, self.qq.max(initial=0.0)) < 1e30:
            other = c * self.scale[:, None] if metric == "cosine" else np.column_stack([c, -self.cc / 2])
            first = q if metric == "cosine" else np.column_stack([q, np.ones(len(q))])
            self.own = first.astype(np.float32), other.astype(np.float32)

    def tile(self, rows: slice, cols: slice, products: np.ndarray | None, bound: np.ndarray, kind: type, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        low = bound + np.where(np.abs(bound) < 1e6, 4e-7, -1e-15 * np.abs(bound))  # half a step of the rounding, less some
        qn = np.sqrt(self.qq[rows])
        eps = np.finfo(kind).eps * (self.q.shape[1] + 4)
        slack = 2.0 * eps * qn * np.sqrt(self.most)  # of an inner product
        if self.metric == "cosine":
            score = products if own else products * self.scale[cols].astype(kind)
            least = np.where(qn > 0, low * np.where(qn > 0, qn, 1.0) - 2.0 * eps * qn, np.where(low < 0, -np.inf, np.inf))
        elif self.metric == "tanimoto":  # p / (qq + cc - p) > t: p (1 + t) > t (qq + cc), as the sum is never below 2 p
            low = np.where(low > -0.5, low, -np.inf)  # -1/3 is the least there is
            t = np.where(low > -0.5, low / (1.0 + np.where(low > -0.5, low, 0.0)), 0.0)
            score = products - np.multiply.outer(t.astype(kind), self.cc[cols].astype(kind))
            least = np.where(low > -0.5, t * self.qq[rows] - slack - 2.0 * eps * (self.qq[rows] + self.most) - V.TANIMOTO_EPS, -np.inf)
        elif self.metric == "euclidean":
            reach = low ** 2 + 4.0 * eps * (self.qq[rows] + self.most)
            score = products if own else products - (self.cc[cols] / 2).astype(kind)
            least = np.where(low > 0, np.inf, (self.qq[rows] - reach) / 2)
        elif self.metric == "manhattan":
            q, c = self.q[rows].astype(kind), self.c[cols].astype(kind)
            score, least = -manhattan_distances(q, c), low - eps * (np.abs(q).sum(1) + np.abs(c).sum(1).max(initial=0.0))
        else:
            score, least = products, low - slack
        return _hits(score > np.nextafter(least.astype(kind), -np.inf, dtype=kind)[:, None])

    def above(self, rows: slice, cols: slice, products: np.ndarray | None, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.float64 if products is None and max(self.most, self.qq.max(initial=0.0)) > 1e30 else np.float32 if products is None else products.dtype.type
        width = cols.stop - cols.start
        if self.steps is not None and self.steps.fits:
            i, j = _hits(self.steps.near(rows, cols, bound + 4e-7))
            if len(i) <= len(bound) * width // 24:
                return i, j
        if self.own is not None:
            i, j = self.tile(rows, cols, self.own[0][rows] @ self.own[1][cols].T, bound, np.float32, True)
            kind = np.float32
        else:
            i, j = self.tile(rows, cols, products, bound, kind)
        if kind is np.float32 and len(i) > len(bound) * width // 16:
            whole = self.q[rows].astype(np.float64) @ self.c[cols].astype(np.float64).T if self.metric != "manhattan" else None
            i, j = self.tile(rows, cols, whole, bound, np.float64)
        return i, j

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rounded similarity of the pairs (q[i], c[j]) of rows, in double precision."""
        if self.metric in ("euclidean", "manhattan"):
            return _round_half_up(pair_similarity(self.q, self.c, i, j, self.metric))
        s = pair_similarity(self.q, self.c, i, j, "dot")
        if self.metric == "cosine":
            denom = np.sqrt(self.qq[i]) * np.sqrt(self.cc[j])
            s = np.divide(s, denom, out=np.zeros(len(s)), where=denom > 0)
        elif self.metric == "tanimoto":
            s = s / np.maximum(self.qq[i] + self.cc[j] - s, V.TANIMOTO_EPS)
        return _round_half_up(s)


class _Best:
    """The ``k`` best rows of each query of a tile, best first; rows come in the order of their places, and of equal ones the first
    stays.  With ``ids`` rows come in any order, and of equal ones the smaller id stays."""

    def __init__(self, lowest: np.ndarray, k: int, ids: np.ndarray | None = None):
        self.ids = ids
        self.lowest, self.score, self.place = lowest, np.full((len(lowest), k), -np.inf), np.zeros((len(lowest), k), np.int64)
        self.kth = lowest

    def add(self, i: np.ndarray, j: np.ndarray, got: np.ndarray) -> None:
        """Pairs in the order of (i, j)."""
        rows, first, times = np.unique(i, return_index=True, return_counts=True)
        at, col = np.repeat(np.arange(len(rows)), times), np.arange(len(i)) - np.repeat(first, times)
        k = self.score.shape[1]
        score, place = np.full((len(rows), k + times.max()), -np.inf), np.zeros((len(rows), k + times.max()), np.int64)
        score[:, :k], place[:, :k] = self.score[rows], self.place[rows]
        score[at, k + col], place[at, k + col] = got, j
        best = (np.argsort(-score, axis=1, kind="stable") if self.ids is None else np.lexsort((self.ids[place], -score), axis=1))[:, :k]
        self.score[rows], self.place[rows] = np.take_along_axis(score, best, axis=1), np.take_along_axis(place, best, axis=1)
        self.kth = np.maximum(self.score[:, -1], self.lowest)


def block_topk(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, metrics: Sequence[str], k: int,
               exclude_self: bool, floor: np.ndarray | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query place, neighbour id, rounded similarity) of each query's ``k`` best rows of a block, for each metric.

    The corpus goes by in tiles in the order of ids.  The first tile gives every query ``k`` rows; of a later one only
    pairs above the k-th so far count, for at equal similarity the smaller id has gone by.  ``floor``: lowest
    similarities wanted, known from other blocks."""
    order = np.argsort(cid, kind="stable")
    c, cid = c[order], cid[order]
    shared = len([m for m in metrics if m != "manhattan"]) > 1
    sieves = {m: _Sieve(q, c, m, shared) for m in metrics}
    products = any(m != "manhattan" and sieves[m].own is None for m in metrics)
    small = all(x.max(initial=0.0) < 1e15 and x.min(initial=0.0) > -1e15 for x in (q, c))
    q_low, c_low = (x.astype(np.float32) if small else x for x in (q, c))
    parts = {m: [] for m in metrics}
    for at in range(0, len(q), TILE_QUERIES):
        rows = slice(at, min(at + TILE_QUERIES, len(q)))
        n = rows.stop - at
        lowest = np.full(n, -np.inf) if floor is None else floor[rows] - np.maximum(1e-6, 1e-12 * np.abs(floor[rows]))  # equal ones may have smaller ids
        held = {m: _Best(lowest, k) for m in metrics}
        cuts = sorted({0, min(FIRST_ROWS, TILE_ROWS), *range(TILE_ROWS, len(c), TILE_ROWS)}) if floor is None else range(0, len(c), TILE_ROWS)
        for low, high in zip(cuts, [*cuts[1:], len(c)], strict=True):
            cols = slice(low, high)
            if low >= high:
                continue
            dots = None
            for m in metrics:
                if low == 0 and floor is None:
                    s = _round_half_up(similarity_matrix(q[rows].astype(np.float64), c[cols].astype(np.float64), m))
                    fine = ~np.isnan(s)
                    if exclude_self:
                        fine &= qid[rows, None] != cid[None, cols]
                    s[~fine] = -np.inf
                    kk = min(k, s.shape[1])
                    i, j = np.nonzero(fine & (s >= np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk, None]))
                    got = s[i, j]
                else:
                    if dots is None and products and sieves[m].own is None and m != "manhattan":
                        dots = q_low[rows] @ c_low[cols].T
                    i, j = sieves[m].above(rows, cols, dots if m != "manhattan" else None, held[m].kth)
                    if exclude_self and len(i):
                        other = qid[at + i] != cid[low + j]
                        i, j = i[other], j[other]
                    if not len(i):
                        continue
                    got = sieves[m].exact(at + i, low + j)
                    better = got > held[m].kth[i]
                    i, j, got = i[better], j[better], got[better]
                if len(i):
                    held[m].add(i, low + j, got)
        for m in metrics:
            i, col = np.nonzero(held[m].score > -np.inf)
            parts[m].append((at + i, cid[held[m].place[i, col]], held[m].score[i, col]))
    return {m: tuple(np.concatenate(x) for x in zip(*found, strict=True)) for m, found in parts.items()}


#: Queries and rows of a tile of bit sets, and the step in which the second of two rows that share a column is counted.
TILE_SETS, TILE_OTHERS, SECOND = 256, 512, 4096


def packed_lists(lists: pd.Series, width: int) -> np.ndarray:
    """On-bit lists as rows of packed 64-bit words."""
    words = np.zeros((len(lists), -(-width // 64)), np.uint64)
    for at in range(0, len(lists), 1024):
        part = [np.asarray(() if v is None else v, np.int64) for v in lists.iloc[at:at + 1024]]
        on = np.zeros((len(part), words.shape[1] * 64), np.uint8)
        on[np.repeat(np.arange(len(part)), [len(v) for v in part]), np.concatenate(part)] = 1
        words[at:at + len(part)] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)
    return words


def common_bits(own: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many bits the sets of ``own`` (rows of 0.0 and 1.0) have in common with packed ones, exactly.  Where both counts fit a
    float's 24 digits, two sets share a column of the product."""
    other = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    half = len(other) // 2
    if own.shape[1] >= SECOND or not half:
        return own @ other.T
    both = own @ (other[:len(other) - half] + np.concatenate([SECOND * other[len(other) - half:], np.zeros((len(other) - 2 * half, own.shape[1]), np.float32)])).T
    out = np.empty((len(own), len(other)), np.float32)
    second = out[:, len(other) - half:]
    np.floor(np.multiply(both[:, :half], 1.0 / SECOND, out=second), out=second)
    np.subtract(both[:, :half], second * SECOND, out=out[:, :half])
    out[:, half:len(other) - half] = both[:, half:]
    return out


def bits_topk(q: np.ndarray, c: np.ndarray, qid: np.ndarray, cid: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, neighbour id, rounded Tanimoto similarity) of each query's ``k`` best rows of a block of packed sets.

    Sets come in the order of their sizes, and a tile of queries meets those of its own size first: two sets are at most
    as similar as the smaller size over the larger, so it stops on either side where no size can reach a k-th any more."""
    size_q, size_c = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (q, c))
    order = np.lexsort((cid, size_c))
    c, cid, size_c, parts = c[order], cid[order], size_c[order].astype(np.float64), []
    by_size = np.argsort(size_q, kind="stable")
    for at in range(0, len(q), TILE_SETS):
        rows = by_size[at:at + TILE_SETS]
        own, size = np.unpackbits(q[rows].view(np.uint8), axis=1, bitorder="little").astype(np.float32), size_q[rows].astype(np.float64)
        best = _Best(np.full(len(rows), -np.inf), k, cid)

        def meet(low: int, high: int) -> bool:
            """Whether rows of these places could be among the best of a query; if so they have been offered."""
            reach = np.minimum(np.where(size > size_c[high - 1], size_c[high - 1], size), np.maximum(size, 1e-9)) / np.maximum(np.maximum(size, size_c[low]), 1e-9)  # noqa: B023 - called in this round
            some = np.flatnonzero(reach + 2e-6 >= best.kth)  # noqa: B023
            if not len(some):
                return False
            common = common_bits(own if len(some) == len(own) else own[some], c[low:high])  # noqa: B023
            total = size[some, None] + size_c[None, low:high]  # noqa: B023
            t = np.maximum(best.kth[some], 0.0) - 2e-6  # noqa: B023
            i, j = _hits(common >= (t / (1 + t))[:, None] * total - 1e-3)
            union = total[i, j] - common[i, j]
            s = _round_half_up(common[i, j] / np.maximum(union, V.TANIMOTO_EPS))
            i, j = some[i], low + j
            fine = s >= best.kth[i]  # noqa: B023
            if exclude_self:
                fine &= qid[rows[i]] != cid[j]  # noqa: B023
            if fine.any():
                best.add(i[fine], j[fine], s[fine])  # noqa: B023
            return True

        middle = int(np.searchsorted(size_c, np.median(size))) // TILE_OTHERS * TILE_OTHERS
        below, above = range(middle - TILE_OTHERS, -1, -TILE_OTHERS), range(middle, len(c), TILE_OTHERS)
        sides = [iter(above), iter(below)]
        while sides:
            for side in list(sides):
                low = next(side, None)
                if low is None or not meet(low, min(low + TILE_OTHERS, len(c))):
                    sides.remove(side)
        i, col = np.nonzero(best.score > -np.inf)
        parts.append((rows[i], cid[best.place[i, col]], best.score[i, col]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _local_topk(by: Sequence[str], k: int, metric, exclude_self: bool, bits_width: int | None = None, packed: bool = False):
    """Task body: local top-k per query of one block pair, for one metric or a list of them
    (then a ``metric`` column is added; the vectors are stacked once for all metrics).  With a column
    ``_kth`` queries bring the similarity of a k-th row found before, and only rows that reach it are given."""
    metrics = [metric] if isinstance(metric, str) else list(metric)
    multi = not isinstance(metric, str)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = list(by) + (["metric"] if multi else []) + ["query_id", "neighbor_id", "similarity"]
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({c: [] for c in cols})
        if not bits_width and (left["_qv"].map(len).nunique() > 1 or right["_cv"].map(len).nunique() > 1 or len(left["_qv"].iloc[0]) != len(right["_cv"].iloc[0])):
            parts = [run(key, left.iloc[a], right.iloc[b]) for a, b in same_length(left["_qv"], right["_cv"])]
            return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in cols})
        qid, cid = left["_qid"].to_numpy(), right["_cid"].to_numpy()
        if bits_width and metrics == ["tanimoto"] and not multi and "_kth" not in left:
            sides = [np.stack(v.to_numpy()).astype(np.int64).view(np.uint64) if packed else packed_lists(v, bits_width) for v in (left["_qv"], right["_cv"])]
            i, neighbor, s = bits_topk(*sides, qid, cid, k, exclude_self)
            return pd.DataFrame({**{b: left[b].iloc[0] for b in by}, "query_id": qid[i].astype(np.int64), "neighbor_id": neighbor.astype(np.int64), "similarity": s})
        q, c = _stack(left["_qv"], bits_width), _stack(right["_cv"], bits_width)
        floor = left["_kth"].to_numpy(np.float64, na_value=-np.inf) if "_kth" in left else None
        frames = []
        for m, (i, neighbor, s) in block_topk(q, c, qid, cid, metrics, k, exclude_self, floor).items():
            res = pd.DataFrame({"query_id": qid[i].astype(np.int64), "neighbor_id": neighbor.astype(np.int64), "similarity": s})
            if multi:
                res.insert(0, "metric", m)
            frames.append(res)
        res = pd.concat(frames, ignore_index=True)
        for name in reversed(list(by)):
            res.insert(0, name, left[name].iloc[0])
        return res[cols]

    return run


#: Rows of a block of queries; how many blocks a side has at least, so that tables of medium size keep many cores busy.
BLOCK_ROWS, SPREAD = 16384, 8
#: A corpus block has so many times the rows of a query block: fewer local lists of each query.
CORPUS_FACTOR = 4


def blocked_cogroup(queries: DataFrame, corpus: DataFrame, fn, schema: T.StructType, *, id_col: str = "vec_id",
                    vec_col: str = "embedding", by: Sequence[str] = (), block_rows: int = BLOCK_ROWS, corpus_rows: int | None = None,
                    extra: Sequence[str] = (), spread: int | None = None) -> DataFrame:
    """Run ``fn(key, left, right)`` on every (query block, corpus block) pair of each ``by`` group.

    Each group is hashed into ⌈rows / block_rows⌉ blocks per side (the counts come from a
    grouped count, one row per group; ``corpus_rows``: another size for the corpus), and where blocks keep 1024 rows into
    as many as give ``spread``² / 2 pairs of blocks (``spread``: 1 with groups, else ``SPREAD``), most of them of queries:
    what a query has found spares work in the rest of its corpus block.  A query row is replicated once per corpus block of its
    group and vice versa, so every pair of rows of a group meets in exactly one task and no
    task holds more than about ``block_rows`` rows per side.  A hot group is split into many
    blocks; small groups are not replicated because of it.
    ``left``/``right`` hold the ``by`` columns, ``_qid``/``_qv`` and ``_cid``/``_cv``; ``left`` also the queries'
    columns ``extra``.
    """
    by, extra, corpus_rows = list(by), list(extra), corpus_rows or block_rows
    spread = spread or (1 if by else SPREAD)

    def blocks(rows, most: int, least):
        return F.greatest(F.ceil(rows / most), F.least(F.ceil(rows / 1024), least), F.lit(1)).cast("int")

    def of_corpus(nq, nc):
        return blocks(nc, corpus_rows, F.greatest(F.lit(spread // 4), F.ceil(F.lit(spread ** 2 / 2) / F.greatest(F.ceil(nq / 1024), F.lit(1)))))

    def of_queries(nq, bc):
        return blocks(nq, block_rows, F.ceil(F.lit(spread ** 2 / 2) / bc))

    # re-aliased group columns: queries and corpus are often the same table
    q = queries.select(*[F.col(b).alias(b) for b in by], F.col(id_col).cast("long").alias("_qid"), F.col(vec_col).alias("_qv"), *extra)
    c = corpus.select(*[F.col(b).alias(b) for b in by], F.col(id_col).cast("long").alias("_cid"), F.col(vec_col).alias("_cv"))
    if by:
        # one pass over both sides (a union, not a join of two aggregates of the same input)
        both = q.select(*by, F.lit(1).alias("_iq"), F.lit(0).alias("_ic")).unionByName(
            c.select(*by, F.lit(0).alias("_iq"), F.lit(1).alias("_ic")))
        sizes = both.groupBy(*by).agg(F.sum("_iq").alias("_nq"), F.sum("_ic").alias("_nc")) \
            .where((F.col("_nq") > 0) & (F.col("_nc") > 0)) \
            .withColumn("_bc", of_corpus(F.col("_nq"), F.col("_nc"))).select(*by, of_queries(F.col("_nq"), F.col("_bc")).alias("_bq"), "_bc")
        # fresh names on the size table: it derives from the same input as q and c
        sizes = sizes.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], "_bq", "_bc")
        on = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
        gcols = [f"_g{i}" for i in range(len(by))]
        q = q.join(sizes, on).drop(*gcols)
        c = c.join(sizes, on).drop(*gcols)
        bq, bc = F.col("_bq"), F.col("_bc")
    else:
        nq, nc = (df.agg(F.count(F.lit(1))).scalar() for df in (q, c))
        bc = of_corpus(nq, nc)
        bq = of_queries(nq, bc)
    q = (q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), bq).cast("int"))
         .withColumn("_cb", F.explode(F.sequence(F.lit(0), bc - 1))).select(*by, "_qb", "_cb", "_qid", "_qv", *extra))
    c = (c.withColumn("_cb", F.pmod(F.xxhash64("_cid"), bc).cast("int"))
         .withColumn("_qb", F.explode(F.sequence(F.lit(0), bq - 1))).select(*by, "_qb", "_cb", "_cid", "_cv"))
    keys = by + ["_qb", "_cb"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(fn, schema)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, for readers that would each compute it again."""
    path = scratch_path(df.sparkSession, "knn")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _topk(local: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by, "query_id").orderBy(F.col("similarity").desc(), F.col("neighbor_id"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str | Sequence[str] = "cosine", *, id_col: str = "vec_id",
        vec_col: str = "embedding", by: Sequence[str] = (), exclude_self: bool = True,
        block_rows: int = BLOCK_ROWS, bits_width: int | None = None, pivots: int = 0, packed: bool = False) -> DataFrame:
    """Top-k corpus rows per query row (``knn_exact`` / ``knn_metric``).

    ``by`` columns must match between a query and a corpus row (for example the truncation
    ``dim`` of a ladder).  Result: ``*by, query_id, neighbor_id, similarity, rank``.

    ``metric`` may be a list: every block pair is then scored with each metric (vectors are
    stacked once) and a ``metric`` column is added.  ``bits_width``: the column holds lists of on-bits below it, or, with ``packed``
    (Tanimoto only), their 64-bit words.  ``pivots`` > 0 prunes with that many pivots
    (see ``knn_pivots``; one metric, no ``by``); the result is the same.
    """
    multi = not isinstance(metric, str) and metric is not None
    metric = [m.lower() for m in metric] if multi else (metric or "cosine").lower()
    for m in (metric if multi else [metric]):
        if m not in METRICS:
            raise ValueError(f"unknown metric {m!r}; expected one of {METRICS}")
    if k < 1:
        raise ValueError("k must be ≥ 1")
    if packed and (not bits_width or metric != "tanimoto"):
        raise ValueError("packed sets go with bits_width and tanimoto")
    by = list(by)
    queries, corpus = usable(queries, vec_col), usable(corpus, vec_col)
    if pivots:
        if by or multi or bits_width:
            raise ValueError("pivots go with one metric and no groups")
        return knn_pivots(queries, corpus, k, metric, pivots, id_col, vec_col, exclude_self, block_rows)
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in queries.schema.fields if f.name in by]
        + ([T.StructField("metric", T.StringType())] if multi else [])
        + [T.StructField("query_id", T.LongType()), T.StructField("neighbor_id", T.LongType()),
           T.StructField("similarity", T.DoubleType())]
    )
    local = blocked_cogroup(queries, corpus, _local_topk(by, k, metric, exclude_self, bits_width, packed), schema, id_col=id_col,
                            vec_col=vec_col, by=by, block_rows=CORPUS_FACTOR * block_rows if bits_width else block_rows, corpus_rows=CORPUS_FACTOR * block_rows,
                            spread=SPREAD // 2 if by else SPREAD)
    return _topk(local, [*by, "metric"] if multi else by, k)


PIVOT_METRICS = ("cosine", "euclidean", "manhattan")


def _pivot_distances(x: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality: of unit vectors for cosine."""
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots.T), 0.0))
    return -similarity_matrix(x, pivots, metric)


def pivot_cells(queries: DataFrame, corpus: DataFrame, metric: str, pivots: int, id_col: str,
                vec_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries with ``cell`` and all pivot distances ``_pd``, corpus with ``cell``, (cell, radius, rows)).

    Pivots are ``pivots`` corpus rows, those of the smallest id hashes: a parameter's worth of vectors.
    Zero vectors, which cosine gives no direction, lie in cell -1, near everything."""
    picked = [r[0] for r in corpus.orderBy(F.xxhash64(id_col), id_col).limit(pivots).select(vec_col).collect()]
    # pivots of one length; vectors of another lie in cell -1
    width = max({len(v) for v in picked}, key=[len(v) for v in picked].count, default=0)
    centres = np.array([v for v in picked if len(v) == width], dtype=np.float64)
    if metric == "cosine" and len(centres):
        n = np.sqrt((centres * centres).sum(1, keepdims=True))
        centres = (centres / np.where(n > 0, n, 1.0))[n.ravel() > 0]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def distances(vs: pd.Series) -> pd.Series:
        out = pd.Series([np.zeros(0)] * len(vs))
        fits = np.flatnonzero(vs.map(len).to_numpy() == width) if len(centres) else []
        if len(fits):
            x = _stack(vs.iloc[fits])
            d = _pivot_distances(x, centres, metric)
            if metric == "cosine":
                d[~(x * x).any(axis=1)] = 0.0
            for i, row in zip(fits, d, strict=True):
                out[i] = row
        return out

    zero = ~F.exists(F.col(vec_col), lambda v: v != 0) if metric == "cosine" else F.lit(False)
    cell = F.when(zero | (F.size("_pd") == 0), F.lit(-1)).otherwise((F.array_position("_pd", F.array_min("_pd")) - 1).cast("int"))
    q = queries.select(id_col, vec_col, distances(vec_col).alias("_pd")).withColumn("cell", cell)
    c = corpus.select(id_col, vec_col, distances(vec_col).alias("_pd")).withColumn("cell", cell)
    c = c.withColumn("_d", F.when(F.col("cell") >= 0, F.array_min("_pd")).otherwise(F.lit(0.0))).drop("_pd")
    cells = c.groupBy("cell").agg(F.max("_d").alias("radius"), F.count(F.lit(1)).alias("rows"))
    return q, c.drop("_d"), cells


def pivot_visits(q: DataFrame, first: DataFrame, cells: DataFrame, k: int, metric: str, id_col: str) -> DataFrame:
    """Queries (columns of ``q``, and ``_kth``) with each further cell that may hold one of their k nearest.

    ``first`` has the k best of the query's own cell; the k-th bounds the distance.  A cell is passed
    over when its pivot is farther than that bound plus its radius; 1e-5 covers the rounding of the
    similarities."""
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("_qid"), F.col("similarity").alias("_kth"))
    bound = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * (F.col("_kth") - 1e-5))) if metric == "cosine" else -F.col("_kth")
    table = cells.agg(F.collect_list(F.struct("cell", "radius")).alias("_cells")).scalar()  # a row for each pivot at most
    out = (q.join(kth, F.col(id_col).cast("long") == F.col("_qid"), "left").withColumn("_bound", F.when(F.col("_kth").isNull(), F.lit(float("inf"))).otherwise(bound))
           .withColumn("_cells", table).withColumn("_c", F.explode("_cells")))
    distance = F.when(F.col("_c.cell") >= 0, F.get(F.col("_pd"), F.col("_c.cell"))).otherwise(F.lit(0.0))
    near = distance - F.col("_c.radius") <= F.col("_bound") + 1e-5
    return (out.where((F.col("_c.cell") != F.col("cell")) & (near | (F.col("cell") < 0) | (F.col("_c.cell") < 0)))
            .select(*[c for c in q.columns if c not in ("cell", "_pd")], "_kth", F.col("_c.cell").alias("cell")))


def knn_pivots(queries: DataFrame, corpus: DataFrame, k: int, metric: str, pivots: int, id_col: str = "vec_id",
               vec_col: str = "embedding", exclude_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k that skips cells by the triangle inequality (see ``pivot_visits``)."""
    from ..session import reliable_checkpoint

    if metric not in PIVOT_METRICS:
        raise ValueError(f"pivots need one of {PIVOT_METRICS}")
    q, c, cells = pivot_cells(queries, corpus, metric, pivots, id_col, vec_col)
    q, c = reliable_checkpoint(q), reliable_checkpoint(c)
    cells = c.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).join(cells.select("cell", "radius"), "cell")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("neighbor_id", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])

    def scored(rows: DataFrame) -> DataFrame:
        return blocked_cogroup(rows, c, _local_topk((), k, metric, exclude_self), schema, id_col=id_col, vec_col=vec_col,
                               by=["cell"], block_rows=block_rows, corpus_rows=CORPUS_FACTOR * block_rows, extra=["_kth"] if "_kth" in rows.columns else [])

    first = reliable_checkpoint(_topk(scored(q.drop("_pd")), (), k))
    more = scored(pivot_visits(q, first, cells, k, metric, id_col))
    return _topk(first.drop("rank").unionByName(more), (), k)


def recall_at_k(truth: DataFrame, pred: DataFrame, by: Sequence[str] = (), query_col: str = "query_id",
                item_col: str = "neighbor_id") -> DataFrame:
    """|truth ∩ predicted| / |truth| per truth query; no predictions, or none that hit, give 0.
    With ``by``, per group of ``pred``, for every truth query in each group."""
    by = list(by)
    t = truth.select(query_col, item_col).distinct()
    hit = pred.select(*by, query_col, item_col).distinct().join(t, [query_col, item_col])
    hits = hit.groupBy(*by, query_col).agg(F.count(F.lit(1)).alias("_hits"))
    sizes = t.groupBy(query_col).agg(F.count(F.lit(1)).alias("_n_truth"))
    if by:  # the groups are the steps of a ladder: a short list
        groups = pred.select(*by).distinct().agg(F.collect_list(F.struct(*by))).scalar()
        sizes = sizes.withColumn("_g", groups).withColumn("_g", F.explode("_g"))
        sizes = sizes.select(*[F.col(f"_g.{c}").alias(c) for c in by], query_col, "_n_truth")
    return (sizes.join(hits, [*by, query_col], "left")
            .select(*by, query_col, (F.coalesce("_hits", F.lit(0)) / F.col("_n_truth")).alias("accuracy")))


def ladder_recall(nn: DataFrame, truth_dim: int, dim_col: str = "dim", model_col: str | None = None,
                  truth_model: str | None = None) -> DataFrame:
    """Recall of each (model,) ladder step against the truth step of the same neighbour table.

    One pass: group the neighbour rows by (query, neighbour), note whether the truth step
    holds the pair and which steps list it, then count hits per (step, query).  No join of
    the table with itself, so the k-NN stage runs once for truth and predictions alike.  Every
    query of the truth step has a row for every step, 0 where the step lists none of its neighbours.
    """
    keys = ([model_col] if model_col else []) + [dim_col]
    is_truth = F.col(dim_col) == truth_dim
    if model_col:
        is_truth = is_truth & (F.col(model_col) == truth_model)
    pairs = nn.groupBy("query_id", "neighbor_id").agg(
        F.max(F.when(is_truth, 1).otherwise(0)).alias("_in_truth"),
        F.collect_set(F.struct(*keys)).alias("_steps"))  # one entry per ladder step: bounded
    # per query: truth size, and the steps of its truth neighbours (at most k lists)
    per = pairs.where("_in_truth = 1").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.flatten(F.collect_list("_steps")).alias("_hits"))
    steps = nn.select(*keys).distinct().agg(F.collect_list(F.struct(*keys))).scalar()
    per = per.withColumn("_all", steps).withColumn("_s", F.explode("_all"))
    hits = F.size(F.filter("_hits", lambda h: h == F.col("_s")))
    return per.select(*[F.col(f"_s.{c}").alias(c) for c in keys], "query_id", (hits / F.col("_n")).alias("accuracy"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value_col: str, qs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group without holding a group in one task:
    rows are numbered inside each group by value (distributed running sums), the two rows
    around position (n − 1)·q are picked and interpolated.  Output: ``*by, q, value``."""
    from .ordering import global_row_number

    by = list(by)
    v = df.select(*by, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    numbered = global_row_number(v, ["_v"], by, out_col="_pos")
    n = v.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    targets = n.select(*by, F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "_n") \
               .withColumn("_h", (F.col("_n") - 1) * F.col("q")) \
               .withColumn("_lo", F.floor("_h").cast("long") + 1).withColumn("_hi", F.ceil("_h").cast("long") + 1)
    lo = targets.join(numbered.withColumnRenamed("_pos", "_lo").withColumnRenamed("_v", "_vlo"), [*by, "_lo"])
    both = lo.join(numbered.withColumnRenamed("_pos", "_hi").withColumnRenamed("_v", "_vhi"), [*by, "_hi"])
    frac = F.col("_h") - F.floor("_h")
    return both.select(*by, "q", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac).alias("value"))


def describe_groups(df: DataFrame, by: Sequence[str], value_col: str, digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per group.  The quartiles
    come from ``exact_quantiles``, which never gathers a group in one task."""
    by = list(by)
    v = F.col(value_col).cast("double")
    stats = df.groupBy(*by).agg(F.count(v).alias("count"), F.mean(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                F.min(v).alias("min"), F.max(v).alias("max"))
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    qt = exact_quantiles(df, by, value_col, list(names)).groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()])
    return stats.join(qt, by, "left").select(
        *by, "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def describe_groups_approx(df: DataFrame, by: Sequence[str], value_col: str, accuracy: int = 10000) -> DataFrame:
    """Same statistics with ``percentile_approx`` (bounded memory for continuous values)."""
    v = F.col(value_col).cast("double")
    q = F.percentile_approx(v, [0.25, 0.5, 0.75], accuracy)
    return (df.groupBy(*by).agg(
        F.count(v).alias("count"), F.mean(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), q.alias("_q"), F.max(v).alias("max"))
        .select(*by, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max"))


PRECISIONS = ("float32", "float16", "binary")


def precision_vectors(df: DataFrame, vec_col: str, precision: str) -> DataFrame:
    """The vector column at a reduced precision, as doubles: float16 rounding or sign bits."""
    if precision == "float32":
        return df.withColumn(vec_col, V.as_double(vec_col))
    if precision == "float16":
        return df.withColumn(vec_col, V.half_round(vec_col))
    if precision == "binary":
        bits = F.slice(V.unpack_bits(V.quantize_binary(vec_col)), F.lit(1), F.size(vec_col))
        return df.withColumn(vec_col, F.transform(bits, lambda b: b.cast("double")))
    raise ValueError(f"unknown precision {precision!r}; expected one of {PRECISIONS}")


def retrieval_benchmark(embeddings: DataFrame, dims: Sequence[int] = (64, 32, 16, 8), k: int = 10,
                        metric: str = "cosine", precisions: Sequence[str] = ("float32",), id_col: str = "vec_id",
                        vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flagship job: truth = top-k at full width in float; for each (precision, prefix width)
    the top-k, its recall against the truth, and the recall statistics per (model, dimension)
    with model = ``prefix-<precision>``.

    Every row is a query against the whole table (its own row excluded); all models and
    widths go through one k-NN stage grouped by (model, dim).
    """
    dims = sorted({int(d) for d in dims}, reverse=True)
    base = embeddings.select(id_col, vec_col)
    variants = None
    for p in dict.fromkeys(["float32", *precisions]):
        v = precision_vectors(base, vec_col, p).withColumn("model", F.lit(f"prefix-{p}"))
        variants = v if variants is None else variants.unionByName(v)
    ladder = truncate_ladder(variants, dims, vec_col)
    # the recall and the statistics read their input more than once: neighbours are found and compared only once
    nn = _written(knn(ladder, ladder, k, metric, id_col=id_col, vec_col=vec_col, by=["model", "dim"], block_rows=block_rows))
    rec = ladder_recall(nn, dims[0], "dim", "model", "prefix-float32")
    if "float32" not in precisions:
        rec = rec.where(F.col("model") != "prefix-float32")
    rec = _written(rec.select("model", F.col("dim").cast("int").alias("dimension"), "query_id", "accuracy"))
    return describe_groups(rec, ["model", "dimension"], "accuracy")
