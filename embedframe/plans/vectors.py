"""Vector transforms (2.D), k-NN queries (2.F) and the precision sweep (2.J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import knn as K
from ..operators import metrics as M
from ..operators import quantize as Q
from ..sources.tables import table
from . import derived as D
from .retrieval import _COSINE_TOPK_SQL, _LADDER_SQL, _half_sql


def _long(df: DataFrame, vec: str, value_name: str = "value", digits: int = 6) -> DataFrame:
    """(vec_id, pos, value) rows of a vector column: arrays are compared as scalars."""
    return df.select("vec_id", F.posexplode(vec).alias("pos", "_v")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.round(F.col("_v").cast("double"), digits).alias(value_name))


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def vec_l2_norm(spark, sf):
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(V.l2_norm(V.truncate("embedding", 16)), 6).alias("norm16"),
                    F.round(V.l2_norm("embedding"), 6).alias("norm"))


def vec_normalize(spark, sf):
    return _long(_emb(spark, sf).select("vec_id", V.normalize("embedding").alias("v")), "v")


def vec_truncate(spark, sf):
    return _long(_emb(spark, sf).select("vec_id", V.truncate("embedding", 8).alias("v")), "v")


def vec_truncate_renorm(spark, sf):
    return _long(_emb(spark, sf).select("vec_id", V.truncate_renorm("embedding", 16).alias("v")), "v")


def vec_truncate_ladder(spark, sf):
    lad = K.truncate_ladder(_emb(spark, sf), D.LADDER)
    return lad.select("vec_id", F.col("dim").cast("int").alias("dim"), F.size("embedding").alias("n"),
                      F.round(V.l2_norm("embedding"), 6).alias("norm"))


def half_round(spark, sf):
    e = _emb(spark, sf).select("vec_id", V.half_round("embedding").alias("v"))
    return _long(e, "v", digits=9)


def quantize_ubinary(spark, sf):
    e = _emb(spark, sf).select("vec_id", V.quantize_ubinary("embedding").alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.col("value").cast("int").alias("value"))


def quantize_binary(spark, sf):
    e = _emb(spark, sf).select("vec_id", V.quantize_binary("embedding").alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.col("value").cast("int").alias("value"))


def unpack_bits(spark, sf):
    e = _emb(spark, sf).select("vec_id", V.unpack_bits(V.quantize_binary("embedding"), signed=True).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("pos", "bit")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.col("bit").cast("int").alias("bit"))


def quantize_int8(spark, sf):
    e = _emb(spark, sf)
    q = Q.quantize_int8(e, "embedding", signed=True)
    return q.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.col("value").cast("int").alias("value"))


def quantize_uint8(spark, sf):
    e = _emb(spark, sf)
    q = Q.quantize_int8(e, "embedding", signed=False)
    return q.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), F.col("value").cast("int").alias("value"))


PIVOTS = 32


def knn_exact(spark, sf):
    e = _emb(spark, sf)
    nn = K.knn(e, e, 10, "cosine", pivots=PIVOTS)
    return nn.select("query_id", "neighbor_id", "similarity", F.col("rank").cast("int").alias("rank"))


def knn_metric(spark, sf):
    """Top-10 of whole vectors under each of the five similarities, all scored in the same tasks."""
    e = _emb(spark, sf).select("vec_id", "embedding")
    nn = K.knn(e, e, 10, ["tanimoto", "cosine", "dot", "euclidean", "manhattan"])
    return nn.select("metric", "query_id", "neighbor_id", "similarity", F.col("rank").cast("int").alias("rank"))


def recall_at_k(spark, sf):
    """Recall@10 of the 16-wide prefix against full width, one row per query (generic
    truth/prediction join; ``retrieval_benchmark`` uses the one-pass ladder form)."""
    e = _emb(spark, sf).select("vec_id", "embedding")
    truth = K.knn(e, e, 10, "cosine").select("query_id", "neighbor_id")
    lad = K.truncate_ladder(e, [16])
    pred = K.knn(lad, lad, 10, "cosine").select("query_id", "neighbor_id")
    return K.recall_at_k(truth, pred).select("query_id", F.round("accuracy", 6).alias("accuracy"))


def join_overlap(spark, sf):
    """|top-10 at full width ∩ top-10 of the 8-wide prefix| per query (inner join on (query, id))."""
    e = _emb(spark, sf).select("vec_id", "embedding")
    lad = K.truncate_ladder(e, [64, 8])
    nn = K.knn(lad, lad, 10, "cosine", by=["dim"])
    full = nn.where(F.col("dim") == 64).select("query_id", "neighbor_id")
    small = nn.where(F.col("dim") == 8).select("query_id", "neighbor_id")
    common = full.join(small, ["query_id", "neighbor_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("common"))
    return full.select("query_id").distinct().join(common, "query_id", "left").select(
        "query_id", F.coalesce("common", F.lit(0)).cast("long").alias("common"))


def describe_groups(spark, sf):
    ev = table(spark, sf, "events")
    return K.describe_groups(ev, ["event_type"], "value")


def _timings(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_type").alias("config"), F.col("value").alias("seconds"),
                     F.get_json_object("props", "$.k").cast("double").alias("memory"))


BASELINE_CONFIG = "click"


def perf_summary(spark, sf):
    return M.perf_summary(_timings(spark, sf), "config", "seconds", "memory", BASELINE_CONFIG)


def join_baseline(spark, sf):
    """Mean time of each configuration per user next to the baseline configuration's mean for
    the same user (missing baseline → NULL)."""
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("config"), "user_id").agg(
        F.round(F.avg("value"), 6).alias("mean_s"))
    return M.join_baseline(t, "config", BASELINE_CONFIG, ["user_id"], ["mean_s"]).select(
        "config", "user_id", "mean_s", "base_mean_s")


PRECISIONS = ("float32", "float16", "int8", "binary")


def _precision_scores(spark, sf):
    """Gold = full-width float cosine of the pairs; prediction = cosine of both vectors after
    truncation to d and the precision reduction of the configuration.  The pairs carry both whole
    vectors once; every configuration is derived from them in the same rows."""
    e = _emb(spark, sf).select("vec_id", "embedding")
    ranges = Q.int8_ranges(e, "embedding").select("ranges").scalar()
    p = D.gold_pairs(spark, sf).select("id_a", "id_b", "vec_a", "vec_b", F.round(V.cosine("vec_a", "vec_b"), 6).alias("gold"))

    def bits(v):
        return F.transform(F.col(v), lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    for side in ("a", "b"):
        p = p.withColumn(f"int8_{side}", F.col(f"vec_{side}")).withColumn(f"half_{side}", V.half_round(f"vec_{side}"))
        p = p.withColumn(f"bit_{side}", bits(f"vec_{side}"))
    p = Q.quantize_arrays(p, ["int8_a", "int8_b"], ranges)
    sides = {"float32": "vec", "float16": "half", "int8": "int8", "binary": "bit"}
    scores = [F.struct(F.lit(prec).alias("precision"), F.lit(d).alias("dim"),
                       F.round(V.cosine(V.truncate(V.as_double(f"{c}_a"), d), V.truncate(V.as_double(f"{c}_b"), d)), 6).alias("pred"))
              for prec, c in sides.items() for d in D.LADDER]
    return p.select("id_a", "id_b", "gold", F.explode(F.array(*scores)).alias("_s")).select(
        "_s.precision", "_s.dim", "id_a", "id_b", "gold", "_s.pred")


def precision_sweep(spark, sf):
    return M.pair_statistics(_precision_scores(spark, sf), "gold", "pred", ["precision", "dim"])


def metric_delta(spark, sf):
    sw = precision_sweep(spark, sf).withColumn("config", F.concat_ws("@", "precision", F.col("dim").cast("string")))
    metrics = ["mae", "mse", "rmse", "max_error", "spearman", "pearson"]
    long = sw.select("config", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    ).select("config", "_m.metric", "_m.value")
    return M.metric_delta(long, "config", "float32@64")


QUERIES = {
    "vec_l2_norm": vec_l2_norm,
    "vec_normalize": vec_normalize,
    "vec_truncate": vec_truncate,
    "vec_truncate_renorm": vec_truncate_renorm,
    "vec_truncate_ladder": vec_truncate_ladder,
    "half_round": half_round,
    "quantize_binary": quantize_binary,
    "quantize_ubinary": quantize_ubinary,
    "unpack_bits": unpack_bits,
    "quantize_int8": quantize_int8,
    "quantize_uint8": quantize_uint8,
    "knn_exact": knn_exact,
    "knn_metric": knn_metric,
    "recall_at_k": recall_at_k,
    "join_overlap": join_overlap,
    "describe_groups": describe_groups,
    "perf_summary": perf_summary,
    "join_baseline": join_baseline,
    "precision_sweep": precision_sweep,
    "metric_delta": metric_delta,
}

_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_EX = "ex AS (SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def _norm_sql(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


_INT8_SQL = """
ex AS (SELECT vec_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
rg AS (SELECT pos, min(x) AS lo, (max(x) - min(x)) / 255 AS step FROM ex GROUP BY pos)
SELECT vec_id, pos, CAST(trunc((x - lo) / step{shift}) AS INTEGER) AS value FROM ex JOIN rg USING (pos)"""

_PREC_SQL = """
""" + _E + """,
rg AS (SELECT pos, min(x) AS lo, (max(x) - min(x)) / 255 AS step FROM (
          SELECT CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY pos),
lohi AS (SELECT list(lo ORDER BY pos) AS lo, list(step ORDER BY pos) AS st FROM rg),
cfg AS (
  SELECT vec_id, 'float32' AS precision, v FROM e
  UNION ALL SELECT vec_id, 'float16', list_transform(v, lambda x: """ + _half_sql("x") + """) FROM e
  UNION ALL SELECT vec_id, 'int8', list_transform(range(1, len(v) + 1), lambda i: CAST(trunc((v[i] - lo[i]) / st[i] - 128) AS DOUBLE)) FROM e, lohi
  UNION ALL SELECT vec_id, 'binary', list_transform(v, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) FROM e),
lad AS (SELECT vec_id, precision, d AS dim, list_slice(v, 1, d) AS v FROM cfg CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)),
gp AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(""" + D._sql_cos("a.v", "b.v") + """, 6) AS gold
       FROM e a JOIN e b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2, a.vec_id + 3, a.vec_id + 4, a.vec_id + 5)),
s AS (SELECT la.precision, la.dim, gp.id_a, gp.id_b, gold, round(""" + D._sql_cos("la.v", "lb.v") + """, 6) AS pred
      FROM gp JOIN lad la ON la.vec_id = gp.id_a JOIN lad lb ON lb.vec_id = gp.id_b AND lb.precision = la.precision AND lb.dim = la.dim),
r AS (SELECT *, rank() OVER (PARTITION BY precision, dim ORDER BY gold) + (count(*) OVER (PARTITION BY precision, dim, gold) - 1) / 2.0 AS rg_,
             rank() OVER (PARTITION BY precision, dim ORDER BY pred) + (count(*) OVER (PARTITION BY precision, dim, pred) - 1) / 2.0 AS rp_ FROM s),
sw AS (SELECT precision, dim, round(avg(abs(pred - gold)), 6) AS mae, round(avg((pred - gold) * (pred - gold)), 6) AS mse,
        round(sqrt(avg((pred - gold) * (pred - gold))), 6) AS rmse, round(max(abs(pred - gold)), 6) AS max_error,
        round(avg(CASE WHEN gold <> 0 THEN abs((pred - gold) / gold) END) * 100, 6) AS mape,
        round(corr(rg_, rp_), 6) AS spearman, round(corr(gold, pred), 6) AS pearson FROM r GROUP BY precision, dim)
"""

ORACLE = {
    "vec_l2_norm": f"SELECT vec_id, round({_norm_sql('list_slice(CAST(embedding AS DOUBLE[]), 1, 16)')}, 6) AS norm16, "
                   f"round({_norm_sql('CAST(embedding AS DOUBLE[])')}, 6) AS norm FROM embeddings",
    "vec_normalize": f"""WITH {_EX}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id)
        SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value FROM ex JOIN n USING (vec_id)""",
    "vec_truncate": f"WITH {_EX} SELECT vec_id, pos, round(x, 6) AS value FROM ex WHERE pos < 8",
    "vec_truncate_renorm": f"""WITH {_EX}, n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex WHERE pos < 16 GROUP BY vec_id)
        SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) AS value FROM ex JOIN n USING (vec_id) WHERE pos < 16""",
    "vec_truncate_ladder": f"""WITH {_E} SELECT vec_id, CAST(d AS INTEGER) AS dim, CAST(len(list_slice(v, 1, d)) AS INTEGER) AS n,
        round({_norm_sql('list_slice(v, 1, d)')}, 6) AS norm FROM e CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)""",
    "half_round": f"WITH {_EX} SELECT vec_id, pos, round({_half_sql('x')}, 9) AS value FROM ex",
    "quantize_ubinary": f"""WITH {_EX} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS pos,
        CAST(sum(CASE WHEN x > 0 THEN 1 << (7 - pos % 8) ELSE 0 END) AS INTEGER) AS value FROM ex GROUP BY vec_id, pos // 8""",
    "quantize_binary": f"""WITH {_EX} SELECT vec_id, CAST(pos // 8 AS INTEGER) AS pos,
        CAST(sum(CASE WHEN x > 0 THEN 1 << (7 - pos % 8) ELSE 0 END) - 128 AS INTEGER) AS value FROM ex GROUP BY vec_id, pos // 8""",
    "unpack_bits": f"WITH {_EX} SELECT vec_id, pos, CASE WHEN x > 0 THEN 1 ELSE 0 END AS bit FROM ex",
    "quantize_int8": "WITH " + _INT8_SQL.format(shift=" - 128"),
    "quantize_uint8": "WITH " + _INT8_SQL.format(shift=""),
    "knn_exact": "WITH " + _COSINE_TOPK_SQL + " SELECT query_id, neighbor_id, similarity, CAST(rank AS INTEGER) AS rank FROM top WHERE dim = 64",
    "knn_metric": "WITH " + _LADDER_SQL + ", q AS (SELECT vec_id, v FROM n WHERE dim = 64)" + " UNION ALL ".join(
        f""" SELECT '{m}' AS metric, query_id, neighbor_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
             SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round({D.sql_similarity(m, 'a.v', 'b.v')}, 6) AS similarity,
                    row_number() OVER (PARTITION BY a.vec_id ORDER BY round({D.sql_similarity(m, 'a.v', 'b.v')}, 6) DESC, b.vec_id) AS rank
             FROM q a JOIN q b ON a.vec_id <> b.vec_id QUALIFY rank <= 10)"""
        for m in ("tanimoto", "cosine", "dot", "euclidean", "manhattan")),
    "recall_at_k": "WITH " + _COSINE_TOPK_SQL + """, truth AS (SELECT query_id, neighbor_id FROM top WHERE dim = 64),
        pred AS (SELECT query_id, neighbor_id FROM top WHERE dim = 16)
        SELECT t.query_id, round(CAST(count(p.neighbor_id) AS DOUBLE) / count(*), 6) AS accuracy
        FROM truth t LEFT JOIN pred p USING (query_id, neighbor_id) GROUP BY t.query_id""",
    "join_overlap": "WITH " + _COSINE_TOPK_SQL + """, tt AS (SELECT query_id, neighbor_id FROM top WHERE dim = 64),
        pp AS (SELECT query_id, neighbor_id FROM top WHERE dim = 8)
        SELECT tt.query_id, count(pp.neighbor_id) AS common FROM tt LEFT JOIN pp USING (query_id, neighbor_id) GROUP BY tt.query_id""",
    "describe_groups": """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
        round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS max FROM events GROUP BY event_type""",
    "perf_summary": """WITH t AS (SELECT event_type AS config, value AS seconds, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS memory FROM events),
        per AS (SELECT config, count(seconds) AS runs, avg(seconds) AS m, stddev_pop(seconds) AS sd, avg(memory) AS mem FROM t GROUP BY config),
        b AS (SELECT m AS bm, mem AS bmem FROM per WHERE config = 'click')
        SELECT config, runs, round(m, 6) AS mean_s, round(sd, 6) AS std_s, round(131072.0 / m, 6) AS throughput,
          round(bm / m, 6) AS speedup, round(mem, 6) AS memory, round((1 - mem / bmem) * 100, 6) AS memory_saving_pct FROM per, b""",
    "join_baseline": """WITH t AS (SELECT event_type AS config, user_id, round(avg(value), 6) AS mean_s FROM events GROUP BY event_type, user_id)
        SELECT t.config, t.user_id, t.mean_s, b.mean_s AS base_mean_s FROM t LEFT JOIN t b ON b.user_id = t.user_id AND b.config = 'click'""",
    "precision_sweep": "WITH " + _PREC_SQL + " SELECT * FROM sw",
    "metric_delta": "WITH " + _PREC_SQL.replace("sw AS (", "sw AS MATERIALIZED (") + ", lng AS (" + " UNION ALL ".join(
        f"SELECT precision || '@' || CAST(dim AS VARCHAR) AS config, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sw"
        for m in ("mae", "mse", "rmse", "max_error", "spearman", "pearson")) + """),
        b AS (SELECT metric, value AS base FROM lng WHERE config = 'float32@64')
        SELECT config, metric, value, round(CASE WHEN base = 0 THEN 0 ELSE (value - base) /
          (CASE WHEN metric IN ('spearman', 'pearson') THEN abs(base) ELSE base END) * 100 END, 6) AS delta_pct
        FROM lng LEFT JOIN b USING (metric)""",
}
