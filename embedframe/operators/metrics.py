"""Evaluation aggregates: correlations, error metrics, deltas, losses, pooling.

All of them are ordinary grouped aggregations (partial aggregation before the shuffle).
Ranks use ``ordering.average_ranks`` (no single-partition window).  The pairwise ranking
losses (CoSENT family) are computed without listing the pairs of a batch: the sum over
ordered pairs factorises into per-row terms times suffix sums over the label order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import reliable_checkpoint
from .ordering import running_logsumexp_before, average_ranks, running_sum_before
from .. import constants as C


def _r(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


# --- correlations ---------------------------------------------------------------------------

def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    return df.groupBy(*by).agg(_r(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), digits).alias("pearson"))


def ranked_pairs(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _x, _y, _rx, _ry): both values of every complete row with their average ranks in
    the group.  Rows with a NULL on either side are dropped (pairwise-complete statistics).

    The compact (group, row id, x, y) table is written once (reliable checkpoint): the
    often join-heavy input is evaluated a single time and row ids stay fixed on retries.  Both
    columns are ranked in one pass — the values are stacked with a side tag that becomes part
    of the rank group — so one range partitioning serves x and y."""
    by = list(by)
    base = reliable_checkpoint(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.monotonically_increasing_id().alias("_row"), F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y")))
    stacked = base.select(*by, "_row", F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_x").alias("_v")),
        F.struct(F.lit(1).alias("_side"), F.col("_y").alias("_v")))).alias("_s")).select(*by, "_row", "_s._side", "_s._v")
    ranked = average_ranks(stacked, "_v", [*by, "_side"], "_r")
    side = lambda k, c: F.max(F.when(F.col("_side") == k, F.col(c)))
    return ranked.groupBy(*by, "_row").agg(side(0, "_v").alias("_x"), side(1, "_v").alias("_y"),
                                           side(0, "_r").alias("_rx"), side(1, "_r").alias("_ry")).drop("_row")


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), digits: int | None = 6,
             with_n: bool = False) -> DataFrame:
    """Pearson correlation of average ranks, per group (see ``ranked_pairs``)."""
    aggs = [_r(F.corr("_rx", "_ry"), digits).alias("spearman")]
    if with_n:
        aggs.append(F.count(F.lit(1)).alias("n"))
    return ranked_pairs(df, x, y, by).groupBy(*by).agg(*aggs)


def pair_statistics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Spearman, Pearson and the error metrics of ``pred`` against ``gold`` in one grouped
    aggregation over the ranked pairs (the input is evaluated once)."""
    rp = ranked_pairs(df, gold, pred, by)
    err = F.col("_y") - F.col("_x")
    return rp.groupBy(*by).agg(
        _r(F.avg(F.abs(err)), digits).alias("mae"),
        _r(F.avg(err * err), digits).alias("mse"),
        _r(F.sqrt(F.avg(err * err)), digits).alias("rmse"),
        _r(F.max(F.abs(err)), digits).alias("max_error"),
        _r(F.avg(F.when(F.col("_x") != 0, F.abs(err / F.col("_x")))) * 100.0, digits).alias("mape"),
        _r(F.corr("_rx", "_ry"), digits).alias("spearman"),
        _r(F.corr("_x", "_y"), digits).alias("pearson"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation r over n pairs (t test with n − 2 degrees of freedom)."""
    if r is None or n is None or n < 3 or (isinstance(r, float) and math.isnan(r)):
        return float("nan")
    df = n - 2.0
    if abs(r) >= 1.0 - PERFECT:
        return 0.0
    t2 = r * r * df / (1.0 - r * r)
    return betainc(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def _p_value_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
                      for a, b in zip(r, n)], dtype="float64")


#: A correlation this close to ±1 counts as ±1: it is one but for the rounding of sums, which depends on their order.
PERFECT = 1e-12


def t_statistic(r: Column, n: Column) -> Column:
    """t of a correlation; NULL for a perfect one."""
    return F.when(F.abs(r) < 1 - PERFECT, r * F.sqrt(F.try_divide(n - 2, F.lit(1.0) - r * r)))


def corr_p_values(df: DataFrame, x: str, y: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Spearman and Pearson with their t statistics and two-sided p-values.  The p-value is a
    scalar pandas UDF applied to the already aggregated rows (one per group); ``digits`` rounds it
    like the others."""
    by = list(by)
    sp = spearman(df, x, y, by, digits=None, with_n=True)
    pe = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"))
    if by:
        j = sp.join(pe, by)
    else:  # one aggregated row each side: attach Pearson as a scalar
        j = sp.withColumn("pearson", pe.select("pearson").scalar())
    return j.select(*by, "n",
                    _r(F.col("spearman"), digits).alias("spearman"),
                    _r(t_statistic(F.col("spearman"), F.col("n")), digits).alias("spearman_t"),
                    _r(_p_value_udf("spearman", "n"), digits).alias("spearman_p"),
                    _r(F.col("pearson"), digits).alias("pearson"),
                    _r(t_statistic(F.col("pearson"), F.col("n")), digits).alias("pearson_t"),
                    _r(_p_value_udf("pearson", "n"), digits).alias("pearson_p"))


# --- errors and summaries -------------------------------------------------------------------

def error_metrics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """MAE, MSE, RMSE, max error, MAPE (% over rows with gold ≠ 0; NULL when there are none)."""
    g, p = F.col(gold).cast("double"), F.col(pred).cast("double")
    err = p - g
    return df.groupBy(*by).agg(
        _r(F.avg(F.abs(err)), digits).alias("mae"),
        _r(F.avg(err * err), digits).alias("mse"),
        _r(F.sqrt(F.avg(err * err)), digits).alias("rmse"),
        _r(F.max(F.abs(err)), digits).alias("max_error"),
        _r(F.avg(F.when(g != 0, F.abs(err / g))) * 100.0, digits).alias("mape"))


def similarity_stats(df: DataFrame, value: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """mean, population std, min, max."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(_r(F.avg(v), digits).alias("mean"), _r(F.stddev_pop(v), digits).alias("std"),
                               _r(F.min(v), digits).alias("min"), _r(F.max(v), digits).alias("max"))


def join_baseline(df: DataFrame, config_col: str, baseline, keys: Sequence[str] = (),
                  value_cols: Sequence[str] = ()) -> DataFrame:
    """Every row next to the baseline configuration's row with the same ``keys``.  The baseline
    side holds one row per key combination, i.e. as many rows as one configuration."""
    base = df.where(F.col(config_col) == F.lit(baseline)).select(
        *keys, *[F.col(c).alias(f"base_{c}") for c in value_cols])
    if keys:
        return df.join(base, list(keys), "left")
    # no keys: the baseline is one row; its values are attached as scalar subqueries
    return df.select("*", *[base.select(F.first(f"base_{c}")).scalar().alias(f"base_{c}") for c in value_cols])


CORRELATION_METRICS = ("spearman", "pearson")


def metric_delta(df: DataFrame, config_col: str, baseline, metric_col: str = "metric", value_col: str = "value",
                 digits: int | None = 6) -> DataFrame:
    """% change of each metric against the baseline configuration.  Correlation metrics are
    divided by |baseline|, error metrics by the baseline; 0 when the baseline is 0."""
    base = df.where(F.col(config_col) == F.lit(baseline)).select(metric_col, F.col(value_col).alias("_base"))
    j = df.join(base, metric_col, "left")
    v, b = F.col(value_col).cast("double"), F.col("_base").cast("double")
    denom = F.when(F.col(metric_col).isin(*CORRELATION_METRICS), F.abs(b)).otherwise(b)
    delta = F.when(b == 0, F.lit(0.0)).otherwise((v - b) / denom * 100.0)
    return j.select(*[c for c in df.columns], _r(delta, digits).alias("delta_pct"))


def perf_summary(df: DataFrame, config_col: str, seconds_col: str, memory_col: str | None, baseline,
                 samples: int = 131072, digits: int | None = 6) -> DataFrame:
    """Per configuration: mean and population std of the time, throughput samples/mean,
    speed-up against the baseline, memory saving in % against the baseline."""
    s = F.col(seconds_col).cast("double")
    aggs = [F.count(s).alias("runs"), F.avg(s).alias("mean_s"), F.stddev_pop(s).alias("std_s")]
    if memory_col:
        aggs.append(F.avg(F.col(memory_col).cast("double")).alias("memory"))
    per = df.groupBy(config_col).agg(*aggs)
    # the baseline configuration's figures are single values: scalar subqueries
    base = per.where(F.col(config_col) == F.lit(baseline))
    j = per.withColumn("_bm", base.select(F.first("mean_s")).scalar())
    if memory_col:
        j = j.withColumn("_bmem", base.select(F.first("memory")).scalar())
    out = [config_col, "runs", _r(F.col("mean_s"), digits).alias("mean_s"), _r(F.col("std_s"), digits).alias("std_s"),
           _r(F.lit(float(samples)) / F.col("mean_s"), digits).alias("throughput"),
           _r(F.col("_bm") / F.col("mean_s"), digits).alias("speedup")]
    if memory_col:
        out += [_r(F.col("memory"), digits).alias("memory"),
                _r((F.lit(1.0) - F.col("memory") / F.col("_bmem")) * 100.0, digits).alias("memory_saving_pct")]
    return j.select(*out)


def accuracy(df: DataFrame, pred: str, label: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    return df.groupBy(*by).agg(
        _r(F.avg((F.col(pred) == F.col(label)).cast("double")), digits).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), col)


# --- ranking losses without pair lists --------------------------------------------------------

def theta_pair_counts(df: DataFrame, batch_col: str, label_col: str) -> DataFrame:
    """Number of ordered pairs (i, j) in a batch with label_i > label_j, from label counts and
    running sums (``join_theta_order`` without emitting the pairs)."""
    counts = df.groupBy(batch_col, label_col).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    below = running_sum_before(counts, [label_col], [batch_col], "_c", "_below")
    return below.groupBy(batch_col).agg(F.sum(F.col("_c") * F.col("_below")).cast("long").alias("n_pairs"))


#: Exponents are summed in steps of this width, each relative to its own step: e^256 is far from both ends of a double.
EXPONENT_STEP = 256.0


def cosent_loss(df: DataFrame, batch_cols: str | Sequence[str], label_col: str, score_col: str,
                scale: float = C.COSENT_SCALE, digits: int | None = 6) -> DataFrame:
    """CoSENT per batch: ln(1 + Σ_{label_i > label_j} exp(scale·(s_j − s_i))).

    With I(l) = log Σ_{label = l} exp(−λ s) and J(l) = log Σ_{label = l} exp(λ s), the sum's logarithm is the
    log-sum-exp over labels of J(l) plus the log-sum-exp of I over greater labels, a running one on
    the (batch, label) table.  Sums are ordinary partial aggregates over steps of the exponent, so
    scores of any range do and the rows are read once.  A row without label or score takes part in no
    pair; a batch of only such rows has loss 0.
    """
    by = [batch_cols] if isinstance(batch_cols, str) else list(batch_cols)
    step = F.lit(EXPONENT_STEP)
    known = F.col(label_col).isNotNull() & F.col(score_col).isNotNull()
    rows = df.select(*by, F.when(known, F.col(label_col)).alias("_l"),
                     F.when(known, F.col(score_col).cast("double") * float(scale)).alias("_x"))
    rows = rows.withColumn("_b", F.floor(F.col("_x") / step))
    rest = F.col("_x") - F.col("_b") * step
    steps = rows.groupBy(*by, "_l", "_b").agg(F.sum(F.exp(-rest)).alias("_si"), F.sum(F.exp(rest)).alias("_sj"))
    w = Window.partitionBy(*by, "_l")
    steps = steps.withColumn("_lo", F.min("_b").over(w)).withColumn("_hi", F.max("_b").over(w))
    per_label = steps.groupBy(*by, "_l", "_lo", "_hi").agg(
        F.sum(F.col("_si") * F.exp((F.col("_lo") - F.col("_b")) * step)).alias("_si"),
        F.sum(F.col("_sj") * F.exp((F.col("_b") - F.col("_hi")) * step)).alias("_sj"))
    per_label = per_label.select(*by, "_l", F.coalesce(F.log("_si") - F.col("_lo") * step, F.lit(float("-inf"))).alias("_i"),
                                 F.coalesce(F.log("_sj") + F.col("_hi") * step, F.lit(float("-inf"))).alias("_j"))
    above = running_logsumexp_before(per_label, [F.col("_l").desc_nulls_last()], by, "_i", "_above")
    term = F.col("_j") + F.col("_above")
    terms = above.select(*by, F.when(term > float("-inf"), term).alias("_t")).withColumn("_b", F.floor(F.col("_t") / step))
    sums = terms.groupBy(*by, "_b").agg(F.sum(F.exp(F.col("_t") - F.col("_b") * step)).alias("_s"))
    sums = sums.withColumn("_hi", F.max("_b").over(Window.partitionBy(*by)))
    total = sums.groupBy(*by, "_hi").agg(F.sum(F.col("_s") * F.exp((F.col("_b") - F.col("_hi")) * step)).alias("_s"))
    log_t = F.log("_s") + F.col("_hi") * step
    softplus = F.when(log_t.isNull(), F.lit(0.0)).otherwise(F.greatest(log_t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(log_t))))
    return total.select(*by, _r(softplus, digits).alias("loss"))


# --- pointwise and classification losses ------------------------------------------------------

def pointwise_losses(df: DataFrame, label: str, score: str, by: Sequence[str] = (), sign_label: str | None = None,
                     cosine_col: str | None = None, digits: int | None = 6) -> DataFrame:
    """mse, l1, smooth_l1 (β = 1), huber (δ = 1), binary cross entropy with logits,
    KL divergence (batchmean, the score used as log-probability; NULL when a label is
    negative) and, when ``sign_label``/``cosine_col`` are given, cosine embedding loss (margin 0)."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    d = s - y
    ad = F.abs(d)
    smooth = F.when(ad < 1.0, 0.5 * d * d).otherwise(ad - 0.5)
    huber = F.when(ad <= 1.0, 0.5 * d * d).otherwise(ad - 0.5)
    bce = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
    kl_term = F.when(y > 0, y * (F.log(y) - s)).otherwise(F.lit(0.0))
    aggs = [_r(F.avg(d * d), digits).alias("mse"), _r(F.avg(ad), digits).alias("l1"),
            _r(F.avg(smooth), digits).alias("smooth_l1"), _r(F.avg(huber), digits).alias("huber"),
            _r(F.avg(bce), digits).alias("bce_logits"),
            _r(F.when(F.min(y) < 0, F.lit(None).cast("double")).otherwise(F.sum(kl_term) / F.count(F.lit(1))),
               digits).alias("kldiv")]
    if sign_label and cosine_col:
        c = F.col(cosine_col).cast("double")
        ce = F.when(F.col(sign_label) > 0, 1.0 - c).otherwise(F.greatest(c, F.lit(0.0)))
        aggs.append(_r(F.avg(ce), digits).alias("cosine_embedding"))
    return df.groupBy(*by).agg(*aggs)


def softmax_loss(df: DataFrame, logits: str, label: str, by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """Mean cross entropy of a logit array against an integer class (0-based)."""
    ce = V.logsumexp(logits) - F.get(F.col(logits), F.col(label)).cast("double")
    return df.groupBy(*by).agg(_r(F.avg(ce), digits).alias("loss"))


def self_adjusting_dice_loss(df: DataFrame, logits: str, label: str, by: Sequence[str] = (), alpha: float = C.DICE_ALPHA,
                             gamma: float = C.DICE_GAMMA, reduction: str = C.DICE_REDUCTION,
                             digits: int | None = 6) -> DataFrame:
    """p = softmax(logits)[label]; f = (1 − p)^α·p; loss = 1 − (2f + γ)/(f + 1 + γ); mean or sum."""
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction!r}; expected 'mean' or 'sum'")
    p = F.exp(F.get(F.col(logits), F.col(label)).cast("double") - V.logsumexp(logits))
    f = F.pow(F.lit(1.0) - p, F.lit(alpha)) * p
    loss = F.lit(1.0) - (2.0 * f + gamma) / (f + 1.0 + gamma)
    agg = F.avg(loss) if reduction == "mean" else F.sum(loss)
    return df.groupBy(*by).agg(_r(agg, digits).alias("loss"))


def check_matryoshka_weights(dims: Sequence[int], weights: Sequence[float]) -> None:
    if len(dims) != len(weights):
        raise ValueError("one weight per dimension is required")
    if any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    if any(b < a for a, b in zip(weights, weights[1:])):
        raise ValueError("weights must not decrease along the dimension list")


#: Base losses that rank the pairs of a batch, by the similarity whose prefixes they score.
RANKING_LOSSES = {"cosent": "cosine", "tanimoto_sent": "tanimoto", "angle": "angle"}
#: Base losses between the Tanimoto similarity of the prefixes and the target, by ``pointwise_losses`` column.
POINTWISE_LOSSES = {"mse": "mse", "l1": "l1", "smooth_l1": "smooth_l1", "huber": "huber",
                    "bin_cross_entropy": "bce_logits", "kldiv": "kldiv", "cosine_embedding": "cosine_embedding"}
BASE_LOSSES = (*RANKING_LOSSES, *POINTWISE_LOSSES)


def matryoshka_losses(pairs: DataFrame, batch_col: str, vec_a: str, vec_b: str, label_col: str, dims: Sequence[int],
                      weights: Sequence[float], bases: Sequence[str] = BASE_LOSSES, target_col: str | None = None,
                      sign_col: str | None = None, score_digits: int | None = None, digits: int | None = 6) -> DataFrame:
    """(base, batch, loss): Σ_d w_d · base loss of the d-prefixes, for each base loss by name.

    Ranking losses order the pairs by ``label_col``; pointwise ones compare the prefixes' Tanimoto
    similarity with ``target_col`` (the label when None), ``cosine_embedding`` their cosine with
    the sign in ``sign_col``.  All prefixes and ranking losses share one pass over the pairs, all
    pointwise losses another.  Unknown names and bad weights raise.  The loss is NULL where a
    base loss is (``kldiv`` with a negative target)."""
    check_matryoshka_weights(dims, weights)
    unknown = [b for b in bases if b not in BASE_LOSSES]
    if unknown:
        raise ValueError(f"unknown base losses: {unknown}; expected some of {BASE_LOSSES}")
    if "cosine_embedding" in bases and sign_col is None:
        raise ValueError("cosine_embedding needs sign_col")
    weight = F.create_map(*[x for d, w in zip(dims, weights) for x in (F.lit(d), F.lit(float(w)))])
    each = pairs.withColumn("_dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    a, b = V.truncate(vec_a, F.col("_dim")), V.truncate(vec_b, F.col("_dim"))
    own = [n for n in RANKING_LOSSES if n in bases]
    parts = []
    if own:
        sims = F.array(*[F.struct(F.lit(n).alias("base"), _r(V.angle(a, b) if n == "angle" else V.by_name(RANKING_LOSSES[n])(a, b),
                                                             score_digits).alias("_score")) for n in own])
        scored = each.select(batch_col, "_dim", F.col(label_col).alias("_label"), F.explode(sims).alias("_s")).select(
            batch_col, "_dim", "_label", "_s.*")
        parts.append(cosent_loss(scored, ["base", "_dim", batch_col], "_label", "_score", digits=None))
    points = [n for n in POINTWISE_LOSSES if n in bases]
    if points:
        sign = [F.col(sign_col).alias("_sign")] if sign_col else []
        scored = each.select(batch_col, "_dim", F.col(target_col or label_col).alias("_target"), *sign,
                             _r(V.tanimoto(a, b), score_digits).alias("_score"), _r(V.cosine(a, b), score_digits).alias("_cos"))
        losses = pointwise_losses(scored, "_target", "_score", ["_dim", batch_col], "_sign" if sign_col else None,
                                  "_cos" if sign_col else None, digits=None)
        named = F.array(*[F.struct(F.lit(n).alias("base"), F.col(POINTWISE_LOSSES[n]).alias("loss")) for n in points])
        parts.append(losses.select("_dim", batch_col, F.explode(named).alias("_s")).select("_s.base", "_dim", batch_col, "_s.loss"))
    per = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    total = F.when(F.count("loss") == F.count(F.lit(1)), F.sum(F.col("loss") * weight[F.col("_dim")]))
    return per.groupBy("base", batch_col).agg(_r(total, digits).alias("loss"))


# --- pooling ------------------------------------------------------------------------------------

POOLING = ("mean", "sum", "max", "first", "mean_sqrt_len", "weighted_mean")


def vec_pool(df: DataFrame, group_cols: Sequence[str], vec_col: str, position_col: str, strategy: str = "mean",
             mask_col: str | None = None, digits: int | None = 6) -> DataFrame:
    """Pool the vectors of each group into one (mask-aware): element-wise mean / sum / max, the
    vector at the smallest position (first token), mean·… /√len, or the position-weighted
    mean (weights 1..n by position order).  Work is split by (group, component), so a hot
    group is spread over many tasks; the pooled vector is rebuilt from d components.
    Output: ``*group_cols, pos, value`` (one row per component)."""
    if strategy not in POOLING:
        raise ValueError(f"unknown pooling {strategy!r}; expected one of {POOLING}")
    group_cols = list(group_cols)
    base = df.where(F.col(mask_col) != 0) if mask_col else df
    if strategy == "first":
        firsts = base.groupBy(*group_cols).agg(F.min(position_col).alias(position_col))
        base = base.join(firsts, [*group_cols, position_col])
    if strategy == "weighted_mean":
        base = average_ranks(base, position_col, group_cols, "_w")
    cols = [*group_cols, F.col(position_col)] + ([F.col("_w")] if strategy == "weighted_mean" else [])
    ex = base.select(*cols, F.posexplode(vec_col).alias("_comp", "_x")).withColumn("_x", F.col("_x").cast("double"))
    g = ex.groupBy(*group_cols, "_comp")
    if strategy in ("mean", "first"):
        out = g.agg(F.avg("_x").alias("value"))
    elif strategy == "sum":
        out = g.agg(F.sum("_x").alias("value"))
    elif strategy == "max":
        out = g.agg(F.max("_x").alias("value"))
    elif strategy == "mean_sqrt_len":
        out = g.agg((F.sum("_x") / F.sqrt(F.count("_x"))).alias("value"))
    else:
        out = g.agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("value"))
    return out.select(*group_cols, F.col("_comp").cast("int").alias("pos"), _r(F.col("value"), digits).alias("value"))


def vec_pool_all(df: DataFrame, group_cols: Sequence[str], vec_col: str, position_col: str,
                 digits: int | None = 6) -> DataFrame:
    """Every pooling of ``POOLING`` in one pass: ``*group_cols, pos, value, strategy``.  Positions get
    their weights and the first one its mark; one grouped aggregation by (group, component) follows."""
    group_cols = list(group_cols)
    ranked = average_ranks(df, position_col, group_cols, "_w")
    firsts = df.groupBy(*group_cols).agg(F.min(position_col).alias("_first"))
    ex = (ranked.join(firsts, group_cols).select(*group_cols, "_w", (F.col(position_col) == F.col("_first")).alias("_is_first"),
                                                 F.posexplode(vec_col).alias("pos", "_x")).withColumn("_x", F.col("_x").cast("double")))
    values = {"mean": F.avg("_x"), "sum": F.sum("_x"), "max": F.max("_x"), "first": F.avg(F.when(F.col("_is_first"), F.col("_x"))),
              "mean_sqrt_len": F.sum("_x") / F.sqrt(F.count("_x")), "weighted_mean": F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")}
    g = ex.groupBy(*group_cols, "pos").agg(*[v.alias(f"_v_{n}") for n, v in values.items()])
    each = F.array(*[F.struct(_r(F.col(f"_v_{n}"), digits).alias("value"), F.lit(n).alias("strategy")) for n in values])
    return g.select(*group_cols, "pos", F.explode(each).alias("_s")).select(
        *group_cols, F.col("pos").cast("int").alias("pos"), "_s.value", "_s.strategy")


def last_k_layers(df: DataFrame, layer_col: str, k: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of the last k layers (largest layer numbers) per group; fewer than k layers raises."""
    if k < 1:
        raise ValueError("k must be ≥ 1")
    layers = df.groupBy(*group_cols).agg(F.countDistinct(layer_col).alias("_nl"))
    too_few = layers.where(F.col("_nl") < k).limit(1).collect()
    if too_few:
        raise ValueError(f"only {too_few[0]['_nl']} layers, {k} requested")
    distinct = df.select(*group_cols, layer_col).distinct()
    w = Window.partitionBy(*group_cols).orderBy(F.col(layer_col).desc())
    keep = distinct.withColumn("_lr", F.dense_rank().over(w)).where(F.col("_lr") <= k).drop("_lr")
    return df.join(keep, [*group_cols, layer_col], "left_semi")
