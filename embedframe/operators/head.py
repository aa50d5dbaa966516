"""Classification head: dropout, linear, tanh, dropout, linear; fitted by L-BFGS on gradients summed over partitions.

The objective is the mean loss over all rows.  Each evaluation is one Spark job: a task adds up loss and
gradient of its rows with numpy, the sums of all tasks are added by an ordinary aggregate, and the driver
gets as many numbers as the head has coefficients, whatever the number of rows.

Dropout masks are a hash of seed, row id, layer and unit.  They stay fixed through a fit, so the objective
is a function that a quasi-Newton method can follow, and a task that runs again makes the same masks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import vectors as V
from ..session import reliable_checkpoint

LOSSES = ("softmax", "self_adj_dice")
DROPOUT = 0.15
# ``self_adj_dice`` weighs a label's probability p by (1 − p)^α; with α = 1 the loss is least at p = 1/2, so it
# calms a head down more than it tells classes apart.


@dataclass(frozen=True)
class Head:
    """Coefficients of a head: ``w1`` (hidden × width), ``b1``, ``w2`` (classes × hidden), ``b2``."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in (self.w1, self.b1, self.w2, self.b2)])

    @classmethod
    def unflat(cls, theta: np.ndarray, width: int, hidden: int, classes: int) -> "Head":
        sizes = np.cumsum([hidden * width, hidden, classes * hidden])
        w1, b1, w2, b2 = np.split(theta, sizes)
        return cls(w1.reshape(hidden, width), b1, w2.reshape(classes, hidden), b2)

    @classmethod
    def initial(cls, width: int, hidden: int, classes: int, seed: int = 0) -> "Head":
        rng = np.random.default_rng(seed)
        one, two = 1 / np.sqrt(width), 1 / np.sqrt(hidden)
        return cls(rng.uniform(-one, one, (hidden, width)), np.zeros(hidden),
                   rng.uniform(-two, two, (classes, hidden)), np.zeros(classes))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1.T + self.b1) @ self.w2.T + self.b2


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: xor-shifts and odd multipliers, twice."""
    for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(mult)
    return h ^ (h >> np.uint64(32))


def dropout_mask(ids: np.ndarray, units: int, layer: int, p: float, seed: int) -> np.ndarray | float:
    """Row × unit factors: 0 with probability ``p``, else 1 / (1 − p); the same for the same arguments."""
    if p == 0:
        return 1.0
    start = _mix(np.array([seed * 2 + layer + 1], dtype=np.uint64))
    rows = _mix(ids.astype(np.int64).view(np.uint64) ^ start)
    cells = _mix(rows[:, None] + np.arange(1, units + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return ((cells >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 >= p) / (1.0 - p)


def loss_and_gradient(head: Head, x: np.ndarray, y: np.ndarray, ids: np.ndarray, loss: str, dropout: float,
                      seed: int) -> tuple[float, np.ndarray]:
    """Sum of the loss over the rows and its gradient, flat."""
    m0 = dropout_mask(ids, x.shape[1], 0, dropout, seed)
    x = x * m0
    a = np.tanh(x @ head.w1.T + head.b1)
    m1 = dropout_mask(ids, a.shape[1], 1, dropout, seed)
    h = a * m1
    z = h @ head.w2.T + head.b2
    z = z - z.max(axis=1, keepdims=True)
    norm = np.log(np.exp(z).sum(axis=1))
    at = np.arange(len(y))
    log_p = z[at, y] - norm
    probs = np.exp(z - norm[:, None])
    if loss == "softmax":
        total, slope = -log_p.sum(), np.full(len(y), -1.0)  # d loss / d log p
    else:
        p, alpha, gamma = np.exp(log_p), C.DICE_ALPHA, C.DICE_GAMMA
        f = (1 - p) ** alpha * p
        total = (1 - (2 * f + gamma) / (f + 1 + gamma)).sum()
        df_dp = (1 - p) ** alpha - (alpha * (1 - p) ** (alpha - 1) * p if alpha else 0.0)
        slope = -(2 + gamma) / (f + 1 + gamma) ** 2 * df_dp * p
    dz = -probs * slope[:, None]
    dz[at, y] += slope
    da = (dz @ head.w2) * m1 * (1 - a * a)
    return float(total), np.concatenate([(da.T @ x).ravel(), da.sum(0), (dz.T @ h).ravel(), dz.sum(0)])


def objective(rows: DataFrame, width: int, hidden: int, classes: int, loss: str, dropout: float, seed: int,
              l2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss plus ``l2``/2 · ‖θ‖² and its gradient over ``rows`` (_x, _y, _id), as a function of θ."""
    size = hidden * width + hidden + classes * hidden + classes

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        head = Head.unflat(theta, width, hidden, classes)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size + 2)
            for pdf in batches:
                if len(pdf):
                    f, g = loss_and_gradient(head, np.stack(pdf["_x"].to_numpy()), pdf["_y"].to_numpy(), pdf["_id"].to_numpy(),
                                             loss, dropout, seed)
                    total += np.concatenate([g, [f, len(pdf)]])
            if total[-1]:
                yield pd.DataFrame({"pos": np.arange(size + 2), "value": total})

        sums = np.zeros(size + 2)
        for r in rows.mapInPandas(part, "pos long, value double").groupBy("pos").agg(F.sum("value").alias("value")).collect():
            sums[r["pos"]] = r["value"]  # one number for each coefficient
        n = sums[-1]
        return sums[-2] / n + l2 / 2 * float(theta @ theta), sums[:-2] / n + l2 * theta

    return evaluate


def lbfgs(fg: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, max_iter: int = 50, history: int = 10,
          tol: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """Minimise: limited-memory BFGS with backtracking to sufficient decrease.  Returns θ and the value
    after each step; ends when no component of the gradient exceeds ``tol`` or no step decreases."""
    f, g = fg(theta)
    values, pairs = [f], []
    for _ in range(max_iter):
        if np.abs(g).max() <= tol:
            break
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + s * (a - (y @ d) / (s @ y))
        step, slope = 1.0, float(g @ d)
        for _ in range(20):
            f_new, g_new = fg(theta + step * d)
            if f_new <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-history:]
        theta, f, g = theta + s, f_new, g_new
        values.append(f)
    return theta, values


def _usable(vec: str, dim: int):
    v = V.truncate(vec, dim)
    return F.when((F.size(vec) >= dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))),
                  F.transform(v, lambda x: x.cast("double")))


def fit_head(train: DataFrame, vec_col: str, label_col: str, id_col: str, dim: int, num_labels: int, hidden: int | None = None,
             loss: str = "softmax", dropout: float = DROPOUT, l2: float = 0.0, seed: int = 0, max_iter: int = 50) -> tuple[Head, list[float]]:
    """Fit a head on the ``dim``-prefixes of ``vec_col`` (``hidden`` units, ``dim`` when None); also
    returns the objective after each step.

    Rows whose label is NULL, or whose vector is NULL, shorter than ``dim`` or holds NULL or
    non-finite components in its prefix, take no part; a label outside 0 … ``num_labels`` − 1 and a
    table without usable rows raise."""
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; expected one of {LOSSES}")
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    rows = train.select(_usable(vec_col, dim).alias("_x"), F.col(label_col).cast("long").alias("_y"), F.xxhash64(id_col).alias("_id"))
    rows = reliable_checkpoint(rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()))
    low, high = rows.agg(F.min("_y"), F.max("_y")).first()
    if low is None:
        raise ValueError("no row with a label and a usable vector")
    if low < 0 or high >= num_labels:
        raise ValueError(f"labels from {low} to {high}; expected 0 to {num_labels - 1}")
    hidden = hidden or dim
    fg = objective(rows, dim, hidden, num_labels, loss, dropout, seed, l2)
    theta, values = lbfgs(fg, Head.initial(dim, hidden, num_labels, seed).flat(), max_iter)
    return Head.unflat(theta, dim, hidden, num_labels), values


def head_logits(df: DataFrame, head: Head, vec_col: str, out_col: str = "logits") -> DataFrame:
    """Adds the head's logits (no dropout); NULL where the vector isn't usable (see ``fit_head``)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        ok = x.notna()
        found = iter(head.logits(np.stack(x[ok].to_numpy())) if ok.any() else ())
        return pd.Series([next(found) if known else None for known in ok], index=x.index, dtype=object)

    return df.withColumn(out_col, run(_usable(vec_col, head.w1.shape[1])))


def head_predict(df: DataFrame, head: Head, vec_col: str, names: Sequence[str] = ("logits", "prediction")) -> DataFrame:
    """Adds logits and the class with the greatest one (the first of equals)."""
    return head_logits(df, head, vec_col, names[0]).withColumn(names[1], V.argmax(names[0]))
