"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, on a ladder of segment counts.
Over a segment of m components the inner product of x and y is m (mean_x mean_y) plus the product of
what deviates, and that lies between -m dev_x dev_y and +m dev_x dev_y (Cauchy-Schwarz).  Summed over
the segments this bounds a score from both sides, and finer segments bound it closer.  A pair is
followed down the ladder while its bounds meet a window of scores that is still wanted; only pairs
that get through are scored, exactly and in integers.

Anchors and rows meet in blocks of bounded size.  Positives are the best rows of the anchor's label; then
each positive's score opens a window [low % of it, itself], and the best rows of other labels in it are
its negatives.  A block gives out the best ``k`` of each window, and a window function takes the best of
those.  What a block has found raises the lower end of a window for the rest of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Segments of a vector, coarse to fine.
LADDER = (1, 4, 16)
ANCHOR_BLOCK, ROW_BLOCK = 16384, 8192
ANCHOR_TILE, ROW_TILE = 256, 2048
LONG = np.iinfo(np.int64)


def segments(dims: int, ladder: tuple[int, ...] = LADDER) -> list[np.ndarray]:
    """For each step of the ladder that ``dims`` allows, the ends of its segments (sizes differ by one at most)."""
    return [np.linspace(0, dims, n + 1).round().astype(int) for n in ladder if n <= dims]


def summaries(x: np.ndarray, ladder: tuple[int, ...] = LADDER) -> np.ndarray:
    """Means and deviations of all segments, each times the root of the segment's length, so that bounds
    are plain inner products: a row holds means and deviations step by step."""
    parts = []
    for ends in segments(x.shape[1], ladder):
        size = np.diff(ends)
        mean = np.add.reduceat(x, ends[:-1], axis=1) / size
        rest = x - np.repeat(mean, size, axis=1)
        parts += [mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, ends[:-1], axis=1))]
    return np.concatenate(parts, axis=1)


def steps_of(stats: np.ndarray, dims: int, ladder: tuple[int, ...] = LADDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of each step, from the rows that ``summaries`` makes."""
    out, at = [], 0
    for ends in segments(dims, ladder):
        n = len(ends) - 1
        out.append((stats[:, at:at + n], stats[:, at + n:at + 2 * n]))
        at += 2 * n
    return out


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of every inner product, with room for rounding."""
    centre, reach = a[0] @ b[0].T, a[1] @ b[1].T
    reach = reach + 1e-9 * (np.abs(centre) + reach) + 1e-6
    return centre - reach, centre + reach


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs; those beyond a long are held at its ends."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LONG.min, LONG.max).astype(np.int64)


def best_in_windows(a: np.ndarray, a_steps: list, b: np.ndarray, b_steps: list, b_ids: np.ndarray, allowed: np.ndarray, low: np.ndarray,
                    high: np.ndarray, k: int, counts: dict | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row of a, window, ids, scores): for each row of ``a`` and each of its windows [low, high] of scores, the best
    ``k`` allowed rows of ``b``, ties to smaller ids.  ``b`` is sorted by id; ``low`` and ``high`` are longs, a
    column for each window; an empty window has low above high.  ``counts`` gets the pairs bounded and scored."""
    n, windows = low.shape
    best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(windows)] for _ in range(n)]
    need = low.copy()
    for c in range(0, len(b), ROW_TILE):
        cols = np.arange(c, min(c + ROW_TILE, len(b)))
        rows = np.flatnonzero((need <= high).any(axis=1))
        alive = allowed[np.ix_(rows, cols)]
        for sa, sb in zip(a_steps, b_steps, strict=True):
            rows, cols, alive = _shrunk(rows, cols, alive)
            if not len(rows):
                break
            lo, hi = bounds((sa[0][rows], sa[1][rows]), (sb[0][cols], sb[1][cols]))
            wanted = np.zeros(alive.shape, bool)
            for w in range(windows):  # written so that a bound that is no number keeps the pair
                wanted |= ~(hi < need[rows, w, None]) & ~(lo > high[rows, w, None]) & (need[rows, w] <= high[rows, w])[:, None]
            alive &= wanted
            if counts is not None:
                counts["bounded"] = counts.get("bounded", 0) + wanted.size
        rows, cols, alive = _shrunk(rows, cols, alive)
        if not len(rows):
            continue
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + int(alive.sum())
        score = exact_scores(a[rows], b[cols])
        ids = b_ids[cols]
        for i, r in enumerate(rows.tolist()):
            for w in range(windows):
                fits = alive[i] & (score[i] >= need[r, w]) & (score[i] <= high[r, w])
                if not fits.any():
                    continue
                s, d = np.concatenate([best[r][w][1], score[i][fits]]), np.concatenate([best[r][w][0], ids[fits]])
                if len(s) > k:
                    near = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, d = s[near], d[near]
                    order = np.lexsort((d, -s))[:k]
                    s, d = s[order], d[order]
                    need[r, w] = max(need[r, w], s[-1])
                best[r][w] = (d, s)
    for r in range(n):
        for w in range(windows):
            d, s = best[r][w]
            order = np.lexsort((d, -s))
            if len(d):
                yield r, w, d[order], s[order]


def _shrunk(rows: np.ndarray, cols: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without rows and columns that have no pair left."""
    keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
    return rows[keep_rows], cols[keep_cols], alive[np.ix_(keep_rows, keep_cols)]


def index(vectors: DataFrame, scale: float, anchors: Column, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dims, anchor, vec, stats) of the rows that take part; vec is floor(scale * x).  ``anchors`` is an
    expression on ``id``."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0)).where(whole)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                    F.transform(x, lambda v: v * F.lit(float(scale))).alias("vec")))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    rows = rows.select("id", "label", F.size("vec").alias("dims"), F.coalesce(anchors, F.lit(False)).alias("anchor"), "vec")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            vecs: list = [None] * b.num_rows
            stats: list = [None] * b.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = np.floor(common.rows_of(b.column(4).take(pa.array(at)), np.float64))
                for i, row, s in zip(at.tolist(), v, summaries(v), strict=True):
                    vecs[i], stats[i] = row, s
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(vecs, pa.list_(pa.float64())),
                                              pa.array(stats, pa.list_(pa.float64()))], ["id", "label", "dims", "anchor", "vec", "stats"])

    return rows.mapInArrow(stored, "id long, label string, dims int, anchor boolean, vec array<double>, stats array<double>")


def _meet(anchors: DataFrame, rows: DataFrame, by: list[str], schema: str, compute) -> DataFrame:
    """``compute`` on every block of anchors (``side`` 0, first) with every block of rows (``side`` 1) of a group of
    ``by``, sorted by id.  A group is cut by its counts, so that no block is larger than its bound."""
    counts = anchors.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).cast("int").alias("_na")) \
        .join(rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("_nr")), by)
    a = (anchors.join(counts, by).withColumn("ab", F.pmod(F.xxhash64("id"), F.col("_na")).cast("int"))
         .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1))).withColumn("side", F.lit(0)))
    r = (rows.join(counts, by).withColumn("rb", F.pmod(F.xxhash64("id"), F.col("_nr")).cast("int"))
         .withColumn("ab", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).withColumn("side", F.lit(1)))
    both = a.drop("_na", "_nr").unionByName(r.drop("_na", "_nr"), allowMissingColumns=True)
    return common.by_group(both, [*by, "ab", "rb"], ["side", "id"], schema, compute)


def _sides(g: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of side 0, ids, labels, vectors, summaries)."""
    n = int((g.column("side").to_numpy() == 0).sum())
    labels = g.column("label").dictionary_encode().indices.to_numpy()
    return n, g.column("id").to_numpy(), labels, common.rows_of(g.column("vec"), np.float64), common.rows_of(g.column("stats"), np.float64)


def _tiles(n: int, ids: np.ndarray, labels: np.ndarray, vec: np.ndarray, stats: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int):
    """``best_in_windows`` for tiles of the ``n`` anchors, never an anchor with itself."""
    b_steps = steps_of(stats[n:], vec.shape[1])
    for at in range(0, n, ANCHOR_TILE):
        tile = slice(at, min(at + ANCHOR_TILE, n))
        allowed = (labels[tile, None] == labels[None, n:]) == same
        allowed &= ids[tile, None] != ids[None, n:]
        a_steps = steps_of(stats[tile], vec.shape[1])
        for r, w, d, s in best_in_windows(vec[tile], a_steps, vec[n:], b_steps, ids[n:], allowed, low[tile], high[tile], k):
            yield at + r, w, d, s


def positives(ix: DataFrame, k: int) -> DataFrame:
    """(id, positive_id, positive_score) of each anchor's best ``k`` other rows of its label."""
    def compute(g: pa.RecordBatch) -> list[pa.Array] | None:
        n, ids, labels, vec, stats = _sides(g)
        if not n or n == len(ids):
            return None
        ends = np.full((n, 1), LONG.min), np.full((n, 1), LONG.max)
        found = [(np.full(len(d), ids[r]), d, s) for r, _, d, s in _tiles(n, ids, labels, vec, stats, True, *ends, k)]
        return [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)] if found else None

    near = _meet(ix.where("anchor"), ix, ["label", "dims"], "id long, positive_id long, positive_score long", compute)
    w = Window.partitionBy("id").orderBy(F.col("positive_score").desc(), "positive_id")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def negatives(ix: DataFrame, pos: DataFrame, k: int, low_pct: int, high_pct: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive, the
    best ``k`` rows of other labels whose score lies between ``low_pct`` and ``high_pct`` per cent of the positive's."""
    def compute(g: pa.RecordBatch) -> list[pa.Array] | None:
        n, ids, labels, vec, stats = _sides(g)
        if not n or n == len(ids):
            return None
        wanted = [[(p["positive_id"], p["positive_score"]) for p in ps] for ps in g.column("pos")[:n].to_pylist()]
        widest = max(map(len, wanted))
        low, high = np.full((n, widest), LONG.max), np.full((n, widest), LONG.min)
        for i, ps in enumerate(wanted):
            for w, (_, score) in enumerate(ps):
                low[i, w] = max(LONG.min, min(LONG.max, -(-low_pct * score // 100)))
                high[i, w] = max(LONG.min, min(LONG.max, high_pct * score // 100))
        out: list[list] = [[], [], [], [], []]
        for r, w, d, s in _tiles(n, ids, labels, vec, stats, False, low, high, k):
            positive, score = wanted[r][w]
            for column, values in zip(out, ([int(ids[r])] * len(d), [positive] * len(d), d.tolist(), [score] * len(d), s.tolist()), strict=True):
                column.extend(values)
        return [pa.array(x, pa.int64()) for x in out] if out[0] else None

    lists = pos.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("pos"))  # a few each
    anchors = ix.where("anchor").join(lists, "id")
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    near = _meet(anchors, ix, ["dims"], schema, compute)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return near.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 5, scale: float = 256.0, low_pct: int = 80,
         high_pct: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of every anchor (an expression on ``id``) and each of its positives; see ``negatives``.

    Rows with a NULL id, label or vector, an empty vector, or a NULL or non-finite component take no part.  Vectors of
    different lengths don't meet.  An id with several rows counts once, with its smallest label and vector.  Scores
    beyond the range of a long are held at its ends.  Ties go to smaller ids.  An anchor without a positive,
    or with none in its window, has no row; other columns are ignored; an empty table gives an empty result."""
    common.small_batches(vectors.sparkSession)
    ix = common.written(index(vectors, scale, anchors, id_col, vec_col, label_col), "mine-index")
    pos = common.written(positives(ix, n_positives), "mine-positives")
    return negatives(ix, pos, n_negatives, low_pct, high_pct)
