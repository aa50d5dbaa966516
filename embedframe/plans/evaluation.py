"""Pair similarity evaluation (J2), losses and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import prep as P
from ..operators.ordering import average_ranks
from ..sources.tables import table
from . import derived as D

SIMS = ("tanimoto", "cosine", "dot", "euclidean", "manhattan")


def _pairs_sim(fn):
    def q(spark, sf):
        p = D.gold_pairs(spark, sf)
        return p.select("id_a", "id_b", F.round(fn("vec_a", "vec_b"), 6).alias("similarity"))
    return q


def _pairs_sim_sql(expr: str) -> str:
    return "WITH " + D.GOLD_PAIRS_SQL + f"SELECT id_a, id_b, round({expr}, 6) AS similarity FROM gp"


def join_paired(spark, sf):
    p = D.gold_pairs(spark, sf)
    return p.select("id_a", "id_b", "label_a", "label_b", F.size("vec_a").alias("dim_a"), F.size("vec_b").alias("dim_b"))


def sim_by_name(spark, sf):
    """Every name of the dispatcher on the gold pairs, from one pair join (the scores are computed
    side by side and unpivoted)."""
    p = D.gold_pairs(spark, sf)
    scores = F.array(*[F.struct(F.lit(n).alias("name"), F.round(V.similarity(n, "vec_a", "vec_b"), 6).alias("similarity"))
                       for n in SIMS])
    return p.select("id_a", "id_b", F.explode(scores).alias("_s")).select("id_a", "id_b", "_s.name", "_s.similarity")


def _sp(metric="cosine"):
    return "WITH " + D.scored_pairs_sql(metric)


def agg_pearson(spark, sf):
    return M.pearson(D.scored_pairs(spark, sf), "label", "score", ["dim"])


def agg_spearman(spark, sf):
    return M.spearman(D.scored_pairs(spark, sf), "label", "score", ["dim"])


def rank_average(spark, sf):
    sp = D.scored_pairs(spark, sf).select("dim", "id_a", "id_b", "score")
    return average_ranks(sp, "score", ["dim"], "rank").select("dim", "id_a", "id_b", "score", "rank")


def corr_p_values(spark, sf):
    return M.corr_p_values(D.scored_pairs(spark, sf), "label", "score", ["dim"])


def error_metrics(spark, sf):
    return M.error_metrics(D.scored_pairs(spark, sf), "label", "score", ["dim"])


def similarity_stats(spark, sf):
    return M.similarity_stats(D.scored_pairs(spark, sf), "score", ["dim"])


def nonzero_mask(spark, sf):
    return D.scored_pairs(spark, sf).where(F.col("label") != 0).select("dim", "id_a", "id_b", "label", "score")


def evaluate_pairs(spark, sf):
    """Spearman and Pearson per (similarity function, dimension): one pair join scores every
    function side by side; the statistics are one grouped pass over the stacked scores."""
    sp = D.scored_pairs_multi(spark, sf, ("cosine", "tanimoto", "euclidean", "manhattan", "dot"))
    return M.pair_statistics(sp, "label", "score", ["similarity_fn", "dim"]).select(
        "similarity_fn", "dim", "spearman", "pearson")


AXES_SIMS = ("cosine", "tanimoto")
AXES_PRECISIONS = ("float32", "binary", "ubinary")


def evaluate_pairs_axes(spark, sf):
    """Spearman and Pearson per (dataset, precision, similarity function, dimension).  Datasets are the
    splits of the first id; binary and ubinary vectors are packed, unpacked and cut to the dimension."""
    p = D.gold_pairs(spark, sf).withColumn("label", F.round(V.cosine("vec_a", "vec_b"), 6)).withColumn("dataset", P.hash_split("id_a"))
    whole = {"float32": V.as_double, "binary": lambda c: V.unpack_bits(V.quantize_binary(c), signed=True),
             "ubinary": lambda c: V.unpack_bits(V.quantize_ubinary(c), signed=False)}
    for prec in AXES_PRECISIONS:
        for side in ("a", "b"):
            p = p.withColumn(f"{prec}_{side}", F.transform(whole[prec](f"vec_{side}"), lambda x: x.cast("double")))
    scores = [F.struct(F.lit(prec).alias("precision"), F.lit(fn).alias("similarity_fn"), F.lit(d).alias("dim"),
                       F.round(V.by_name(fn)(V.truncate(f"{prec}_a", d), V.truncate(f"{prec}_b", d)), 6).alias("score"))
              for prec in AXES_PRECISIONS for fn in AXES_SIMS for d in D.LADDER]
    by = ["dataset", "precision", "similarity_fn", "dim"]
    sp = p.select("dataset", "label", F.explode(F.array(*scores)).alias("_s")).select("dataset", "label", "_s.*")
    return M.pair_statistics(sp, "label", "score", by).select(*by, "spearman", "pearson")


def value_counts(spark, sf):
    return M.value_counts(table(spark, sf, "embeddings"), "label")


def accuracy(spark, sf):
    t = D.logits_table(spark, sf)
    return M.accuracy(t.withColumn("pred", V.argmax("logits")), "pred", "label", ["split"])


def loss_softmax(spark, sf):
    return M.softmax_loss(D.logits_table(spark, sf), "logits", "label", ["split"])


def loss_self_adj_dice(spark, sf):
    return M.self_adjusting_dice_loss(D.logits_table(spark, sf), "logits", "label", ["split"])


def join_theta_order(spark, sf):
    sp = D.scored_pairs(spark, sf).where(F.col("dim") == 64)
    return M.theta_pair_counts(sp, "batch_id", "label")


def _cosent(sp):
    """CoSENT for every (dim, batch) of scored pairs in one pass."""
    return M.cosent_loss(sp, ["dim", "batch_id"], "label", "score")


def loss_cosent(spark, sf):
    return _cosent(D.scored_pairs(spark, sf, "cosine"))


def loss_tanimoto_sent(spark, sf):
    return _cosent(D.scored_pairs(spark, sf, "tanimoto"))


def loss_angle(spark, sf):
    p = D.gold_pairs(spark, sf)
    sp = p.select((F.col("id_a") % D.N_BATCHES).cast("int").alias("batch_id"),
                  F.round(V.cosine("vec_a", "vec_b"), 6).alias("label"), F.round(V.angle("vec_a", "vec_b"), 6).alias("score"))
    return M.cosent_loss(sp, "batch_id", "label", "score")


MATRYOSHKA_WEIGHTS = (1.0, 1.0, 1.0, 1.0)


def loss_matryoshka(spark, sf):
    """Σ_d w_d · base loss of the d-prefixes per batch, for each of the ten base losses by name.  Ranking
    losses order by the full-width cosine; the target of the others is that cosine brought to 0 to 1."""
    p = D.gold_pairs(spark, sf).withColumn("label", F.round(V.cosine("vec_a", "vec_b"), 6))
    p = p.select((F.col("id_a") % D.N_BATCHES).cast("int").alias("batch_id"), "vec_a", "vec_b", "label",
                 ((F.col("label") + 1) / 2).alias("target"), F.when(F.col("label_a") == F.col("label_b"), 1).otherwise(-1).alias("sign"))
    return M.matryoshka_losses(p, "batch_id", "vec_a", "vec_b", "label", D.LADDER, MATRYOSHKA_WEIGHTS, target_col="target",
                               sign_col="sign", score_digits=6)


def loss_pointwise(spark, sf):
    p = D.gold_pairs(spark, sf)
    sp = p.select((F.col("id_a") % D.N_BATCHES).cast("int").alias("batch_id"),
                  F.round(V.tanimoto("vec_a", "vec_b"), 6).alias("label"),
                  F.round(V.cosine("vec_a", "vec_b"), 6).alias("score"),
                  F.when(F.col("label_a") == F.col("label_b"), 1).otherwise(-1).alias("sign"))
    return M.pointwise_losses(sp, "label", "score", ["batch_id"], sign_label="sign", cosine_col="score")


def vec_pool(spark, sf):
    return M.vec_pool_all(table(spark, sf, "embeddings"), ["label"], "embedding", "vec_id")


def vec_pool_last_k(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("layer", (F.col("vec_id") % 5).cast("int"))
    last = M.last_k_layers(e, "layer", 2)
    return M.vec_pool(last, ["label"], "embedding", "vec_id", "mean")


QUERIES = {
    "join_paired": join_paired,
    "sim_dot": _pairs_sim(V.dot),
    "sim_cosine": _pairs_sim(V.cosine),
    "sim_cosine_paired": _pairs_sim(V.cosine_paired),
    "sim_euclidean": _pairs_sim(V.euclidean),
    "sim_manhattan": _pairs_sim(V.manhattan),
    "sim_tanimoto": _pairs_sim(V.tanimoto),
    "sim_angle": _pairs_sim(V.angle),
    "sim_by_name": sim_by_name,
    "agg_pearson": agg_pearson,
    "agg_spearman": agg_spearman,
    "rank_average": rank_average,
    "corr_p_values": corr_p_values,
    "error_metrics": error_metrics,
    "similarity_stats": similarity_stats,
    "nonzero_mask": nonzero_mask,
    "evaluate_pairs": evaluate_pairs,
    "evaluate_pairs_axes": evaluate_pairs_axes,
    "value_counts": value_counts,
    "accuracy": accuracy,
    "loss_softmax": loss_softmax,
    "loss_self_adj_dice": loss_self_adj_dice,
    "join_theta_order": join_theta_order,
    "loss_cosent": loss_cosent,
    "loss_tanimoto_sent": loss_tanimoto_sent,
    "loss_angle": loss_angle,
    "loss_matryoshka": loss_matryoshka,
    "loss_pointwise": loss_pointwise,
    "vec_pool": vec_pool,
    "vec_pool_last_k": vec_pool_last_k,
}

_COS = D._sql_cos
_EVAL_SIMS = ("cosine", "tanimoto", "euclidean", "manhattan", "dot")
def _angle_sql(a: str, b: str, half: str) -> str:
    re_a, im_a = f"list_slice({a}, 1, {half})", f"list_slice({a}, {half} + 1, 2 * {half})"
    re_b, im_b = f"list_slice({b}, 1, {half})", f"list_slice({b}, {half} + 1, 2 * {half})"
    dot = "list_dot_product({}, {})".format
    return f"""(CASE WHEN {dot(a, a)} > 0 AND {dot(b, b)} > 0 THEN abs({dot(re_a, re_b)} + {dot(im_a, im_b)} + {dot(im_a, re_b)} - {dot(re_a, im_b)})
        / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})) ELSE 0 END)"""


_ANGLE_SQL = _angle_sql("vec_a", "vec_b", "32")

_RANKS_SQL = """
r AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY label) + (count(*) OVER (PARTITION BY dim, label) - 1) / 2.0 AS rl,
             rank() OVER (PARTITION BY dim ORDER BY score) + (count(*) OVER (PARTITION BY dim, score) - 1) / 2.0 AS rs
      FROM sp)"""

_COSENT_SQL = """
SELECT a.dim, a.batch_id, round(ln(1 + sum(CASE WHEN a.label > b.label THEN exp(20 * (b.score - a.score)) ELSE 0 END)), 6) AS loss
FROM sp a JOIN sp b ON a.batch_id = b.batch_id AND a.dim = b.dim
GROUP BY a.dim, a.batch_id"""

_LOGITS_SQL = f"""
lt AS (SELECT vec_id, {D.LOGITS_SQL} AS logits, label, {D.SPLIT_SQL} AS split FROM embeddings),
lse AS (SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse FROM lt)"""

_POOL_SQL = """
ex AS (SELECT label, vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
wr AS (SELECT *, rank() OVER (PARTITION BY label, pos ORDER BY vec_id) AS w FROM ex),
fst AS (SELECT label, min(vec_id) AS v0 FROM embeddings GROUP BY label)
SELECT label, pos, round(avg(x), 6) AS value, 'mean' AS strategy FROM ex GROUP BY label, pos
UNION ALL SELECT label, pos, round(sum(x), 6), 'sum' FROM ex GROUP BY label, pos
UNION ALL SELECT label, pos, round(max(x), 6), 'max' FROM ex GROUP BY label, pos
UNION ALL SELECT ex.label, pos, round(avg(x), 6), 'first' FROM ex JOIN fst ON ex.label = fst.label AND ex.vec_id = fst.v0 GROUP BY ex.label, pos
UNION ALL SELECT label, pos, round(sum(x) / sqrt(count(x)), 6), 'mean_sqrt_len' FROM ex GROUP BY label, pos
UNION ALL SELECT label, pos, round(sum(x * w) / sum(w), 6), 'weighted_mean' FROM wr GROUP BY label, pos
"""

ORACLE = {
    "join_paired": "WITH " + D.GOLD_PAIRS_SQL + """SELECT id_a, id_b, label_a, label_b, CAST(len(vec_a) AS INTEGER) AS dim_a,
        CAST(len(vec_b) AS INTEGER) AS dim_b FROM gp""",
    "sim_dot": _pairs_sim_sql("list_dot_product(vec_a, vec_b)"),
    "sim_cosine": _pairs_sim_sql(_COS("vec_a", "vec_b")),
    "sim_cosine_paired": _pairs_sim_sql(
        "1 - 0.5 * ((CASE WHEN list_dot_product(vec_a,vec_a) > 0 THEN 1 ELSE 0 END) + "
        "(CASE WHEN list_dot_product(vec_b,vec_b) > 0 THEN 1 ELSE 0 END) - 2 * " + _COS("vec_a", "vec_b") + ")"),
    "sim_euclidean": _pairs_sim_sql(D.sql_similarity("euclidean", "vec_a", "vec_b")),
    "sim_manhattan": _pairs_sim_sql(D.sql_similarity("manhattan", "vec_a", "vec_b")),
    "sim_tanimoto": _pairs_sim_sql(D.sql_similarity("tanimoto", "vec_a", "vec_b")),
    "sim_angle": _pairs_sim_sql(_ANGLE_SQL),
    "sim_by_name": "WITH " + D.GOLD_PAIRS_SQL + " UNION ALL ".join(
        f" SELECT id_a, id_b, '{n}' AS name, round({D.sql_similarity(n, 'vec_a', 'vec_b')}, 6)"
        f" AS similarity FROM gp" for n in SIMS),
    "agg_pearson": _sp() + "SELECT dim, round(corr(label, score), 6) AS pearson FROM sp GROUP BY dim",
    "agg_spearman": _sp() + "," + _RANKS_SQL + " SELECT dim, round(corr(rl, rs), 6) AS spearman FROM r GROUP BY dim",
    "rank_average": _sp() + """SELECT dim, id_a, id_b, score,
        CAST(rank() OVER (PARTITION BY dim ORDER BY score) + (count(*) OVER (PARTITION BY dim, score) - 1) / 2.0 AS DOUBLE) AS rank FROM sp""",
    # two-sided p of t with v degrees of freedom: the finite trigonometric series for whole v
    "corr_p_values": _sp() + "," + _RANKS_SQL + """,
        c AS (SELECT dim, count(*) AS n, corr(rl, rs) AS spearman, corr(label, score) AS pearson FROM r GROUP BY dim),
        k AS (SELECT dim, n, 'spearman' AS name, spearman AS r FROM c UNION ALL SELECT dim, n, 'pearson', pearson FROM c),
        t AS (SELECT *, n - 2 AS v, CASE WHEN abs(r) < 1 - 1e-12 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM k),
        a AS (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM t),
        st AS (SELECT a.*, i.i, CASE WHEN i.i = 0 THEN 0.0 WHEN v % 2 = 0 THEN ln((2 * i.i - 1) / (2.0 * i.i)) ELSE ln(2 * i.i / (2.0 * i.i + 1)) END AS f
               FROM a, (SELECT unnest(range(0, (SELECT max(n) FROM c))) AS i) i WHERE i.i <= (CASE WHEN v % 2 = 0 THEN v - 2 ELSE v - 3 END) // 2),
        se AS (SELECT dim, name, sum(exp(lf + 2 * i * ln(cos(th)))) AS series FROM
                 (SELECT *, sum(f) OVER (PARTITION BY dim, name ORDER BY i) AS lf FROM st) GROUP BY dim, name),
        p AS (SELECT a.dim, a.name, a.n, a.r, a.t, CASE WHEN t IS NULL THEN 0 ELSE 1 END - (CASE WHEN t IS NULL THEN 0 WHEN v % 2 = 0 THEN sin(th) * series
                 ELSE 2 / pi() * (th + sin(th) * cos(th) * coalesce(series, 0)) END) AS p
              FROM a LEFT JOIN se ON se.dim = a.dim AND se.name = a.name)
        SELECT dim, max(n) AS n, round(max(CASE WHEN name = 'spearman' THEN r END), 6) AS spearman,
          round(max(CASE WHEN name = 'spearman' THEN t END), 6) AS spearman_t, abs(round(max(CASE WHEN name = 'spearman' THEN p END), 6)) AS spearman_p,
          round(max(CASE WHEN name = 'pearson' THEN r END), 6) AS pearson, round(max(CASE WHEN name = 'pearson' THEN t END), 6) AS pearson_t,
          abs(round(max(CASE WHEN name = 'pearson' THEN p END), 6)) AS pearson_p FROM p GROUP BY dim""",
    "error_metrics": _sp() + """SELECT dim, round(avg(abs(score - label)), 6) AS mae, round(avg((score - label) * (score - label)), 6) AS mse,
        round(sqrt(avg((score - label) * (score - label))), 6) AS rmse, round(max(abs(score - label)), 6) AS max_error,
        round(avg(CASE WHEN label <> 0 THEN abs((score - label) / label) END) * 100, 6) AS mape FROM sp GROUP BY dim""",
    "similarity_stats": _sp() + """SELECT dim, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
        round(min(score), 6) AS min, round(max(score), 6) AS max FROM sp GROUP BY dim""",
    "nonzero_mask": _sp() + "SELECT CAST(dim AS INTEGER) AS dim, id_a, id_b, label, score FROM sp WHERE label <> 0",
    "evaluate_pairs": "WITH " + ",".join(D.scored_pairs_sql(n, f"_{n}") for n in _EVAL_SIMS) + "," + ",".join(
        f"""r_{n} AS (SELECT '{n}' AS similarity_fn, dim, label, score,
             rank() OVER (PARTITION BY dim ORDER BY label) + (count(*) OVER (PARTITION BY dim, label) - 1) / 2.0 AS rl,
             rank() OVER (PARTITION BY dim ORDER BY score) + (count(*) OVER (PARTITION BY dim, score) - 1) / 2.0 AS rs FROM sp_{n})"""
        for n in _EVAL_SIMS) + " UNION ALL ".join(
        f" SELECT similarity_fn, dim, round(corr(rl, rs), 6) AS spearman, round(corr(label, score), 6) AS pearson"
        f" FROM r_{n} GROUP BY similarity_fn, dim" for n in _EVAL_SIMS),
    "evaluate_pairs_axes": "WITH " + D.GOLD_PAIRS_SQL + f""",
        px AS (SELECT {D.SPLIT_SQL.replace("vec_id", "id_a")} AS dataset, round({_COS('vec_a', 'vec_b')}, 6) AS label, precision,
                 CASE WHEN precision = 'float32' THEN vec_a ELSE list_transform(vec_a, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) END AS va,
                 CASE WHEN precision = 'float32' THEN vec_b ELSE list_transform(vec_b, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) END AS vb
               FROM gp CROSS JOIN (VALUES {", ".join(f"('{p}')" for p in AXES_PRECISIONS)}) t(precision)),
        sp AS (""" + " UNION ALL ".join(
            f"SELECT dataset, precision, '{fn}' AS similarity_fn, {d} AS dim, label, "
            f"round({D.sql_similarity(fn, f'list_slice(va, 1, {d})', f'list_slice(vb, 1, {d})')}, 6) AS score FROM px"
            for fn in AXES_SIMS for d in D.LADDER) + """),
        r AS (SELECT *, rank() OVER (PARTITION BY dataset, precision, similarity_fn, dim ORDER BY label) + (count(*) OVER (PARTITION BY dataset, precision, similarity_fn, dim, label) - 1) / 2.0 AS rl,
                rank() OVER (PARTITION BY dataset, precision, similarity_fn, dim ORDER BY score) + (count(*) OVER (PARTITION BY dataset, precision, similarity_fn, dim, score) - 1) / 2.0 AS rs
              FROM sp)
        SELECT dataset, precision, similarity_fn, dim, round(corr(rl, rs), 6) AS spearman, round(corr(label, score), 6) AS pearson
        FROM r GROUP BY dataset, precision, similarity_fn, dim""",
    "value_counts": "SELECT label, count(*) AS count FROM embeddings GROUP BY label",
    "accuracy": "WITH " + _LOGITS_SQL + """ SELECT split, round(avg(CASE WHEN list_position(logits, list_max(logits)) - 1 = label
        THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM lse GROUP BY split""",
    "loss_softmax": "WITH " + _LOGITS_SQL + " SELECT split, round(avg(lse - logits[label + 1]), 6) AS loss FROM lse GROUP BY split",
    "loss_self_adj_dice": "WITH " + _LOGITS_SQL + """, pr AS (SELECT split, exp(logits[label + 1] - lse) AS p FROM lse)
        SELECT split, round(avg(1 - (2 * ((1 - p) * p) + 1) / (((1 - p) * p) + 1 + 1)), 6) AS loss FROM pr GROUP BY split""",
    "join_theta_order": _sp() + """SELECT a.batch_id, count(*) AS n_pairs FROM sp a JOIN sp b
        ON a.batch_id = b.batch_id AND a.label > b.label WHERE a.dim = 64 AND b.dim = 64 GROUP BY a.batch_id""",
    "loss_cosent": _sp("cosine") + _COSENT_SQL,
    "loss_tanimoto_sent": _sp("tanimoto") + _COSENT_SQL,
    "loss_angle": "WITH " + D.GOLD_PAIRS_SQL + f""", sp AS (SELECT CAST(id_a % 20 AS INTEGER) AS batch_id, 16 AS dim,
        round({_COS('vec_a', 'vec_b')}, 6) AS label, round({_ANGLE_SQL}, 6) AS score FROM gp)""" + _COSENT_SQL.replace("a.dim, a.batch_id, round", "a.batch_id, round"),
    "loss_matryoshka": "WITH " + D.GOLD_PAIRS_SQL + f""",
        pd AS (SELECT CAST(id_a % 20 AS INTEGER) AS batch_id, d AS dim, label_a, label_b, list_slice(vec_a, 1, d) AS a, list_slice(vec_b, 1, d) AS b,
                 round({_COS('vec_a', 'vec_b')}, 6) AS label FROM gp CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)),
        sc AS (SELECT batch_id, dim, label, (label + 1) / 2 AS y, CASE WHEN label_a = label_b THEN 1 ELSE -1 END AS sign,
                 round({_COS('a', 'b')}, 6) AS c, round({D.sql_similarity('tanimoto', 'a', 'b')}, 6) AS s, round({_angle_sql('a', 'b', '(dim // 2)')}, 6) AS g FROM pd),
        sp AS (SELECT 'cosent' AS base, batch_id, dim, label, c AS score FROM sc UNION ALL SELECT 'tanimoto_sent', batch_id, dim, label, s FROM sc
               UNION ALL SELECT 'angle', batch_id, dim, label, g FROM sc),
        pw AS (SELECT batch_id, dim, avg((s - y) * (s - y)) AS mse, avg(abs(s - y)) AS l1,
                 avg(CASE WHEN abs(s - y) < 1 THEN 0.5 * (s - y) * (s - y) ELSE abs(s - y) - 0.5 END) AS smooth_l1,
                 avg(CASE WHEN abs(s - y) <= 1 THEN 0.5 * (s - y) * (s - y) ELSE abs(s - y) - 0.5 END) AS huber,
                 avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))) AS bin_cross_entropy,
                 sum(CASE WHEN y > 0 THEN y * (ln(y) - s) ELSE 0 END) / count(*) AS kldiv,
                 avg(CASE WHEN sign > 0 THEN 1 - c ELSE greatest(c, 0) END) AS cosine_embedding FROM sc GROUP BY batch_id, dim),
        per AS (SELECT a.base, a.batch_id, ln(1 + sum(CASE WHEN a.label > b.label THEN exp(20 * (b.score - a.score)) ELSE 0 END)) AS loss
                FROM sp a JOIN sp b ON a.base = b.base AND a.batch_id = b.batch_id AND a.dim = b.dim GROUP BY a.base, a.dim, a.batch_id
                UNION ALL SELECT base, batch_id, loss FROM pw UNPIVOT (loss FOR base IN ({", ".join(M.POINTWISE_LOSSES)})))
        SELECT base, batch_id, round(sum(loss), 6) AS loss FROM per GROUP BY base, batch_id""",
    "loss_pointwise": "WITH " + D.GOLD_PAIRS_SQL + f""", sp AS (SELECT CAST(id_a % 20 AS INTEGER) AS batch_id,
          round({D.sql_similarity('tanimoto', 'vec_a', 'vec_b')}, 6) AS y,
          round({_COS('vec_a', 'vec_b')}, 6) AS s, CASE WHEN label_a = label_b THEN 1 ELSE -1 END AS sign,
          round({_COS('vec_a', 'vec_b')}, 6) AS c FROM gp)
        SELECT batch_id, round(avg((s - y) * (s - y)), 6) AS mse, round(avg(abs(s - y)), 6) AS l1,
          round(avg(CASE WHEN abs(s - y) < 1 THEN 0.5 * (s - y) * (s - y) ELSE abs(s - y) - 0.5 END), 6) AS smooth_l1,
          round(avg(CASE WHEN abs(s - y) <= 1 THEN 0.5 * (s - y) * (s - y) ELSE abs(s - y) - 0.5 END), 6) AS huber,
          round(avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))), 6) AS bce_logits,
          round(CASE WHEN min(y) < 0 THEN NULL ELSE sum(CASE WHEN y > 0 THEN y * (ln(y) - s) ELSE 0 END) / count(*) END, 6) AS kldiv,
          round(avg(CASE WHEN sign > 0 THEN 1 - c ELSE greatest(c, 0) END), 6) AS cosine_embedding
        FROM sp GROUP BY batch_id""",
    "vec_pool": "WITH " + _POOL_SQL,
    "vec_pool_last_k": """WITH ex AS (SELECT label, vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 5 >= 3)
        SELECT label, pos, round(avg(x), 6) AS value FROM ex GROUP BY label, pos""",
}
