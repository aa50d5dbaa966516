"""Inputs the reference jobs need, derived from the given tables (FIXTURES.md §3).

Each derived table is a lazy DataFrame over the whole input table; nothing is sampled.
The matching DuckDB fragments sit next to each builder so the oracle SQL derives the same
rows the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import table

PAIR_OFFSETS = (1, 2, 3, 4, 5)
N_BATCHES = 20
LADDER = (64, 32, 16, 8)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def gold_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id_a, id_b) = (i, i + o) for o in 1..5 where both rows exist, with both vectors and
    class labels.  An equi join on ``vec_id = id_a + o``: no cross product."""
    e = embeddings(spark, sf)
    a = e.select(F.col("vec_id").alias("id_a"), F.col("embedding").alias("vec_a"), F.col("label").alias("label_a"),
                 F.explode(F.array(*[F.lit(o) for o in PAIR_OFFSETS])).alias("_o"))
    b = e.select(F.col("vec_id").alias("id_b"), F.col("embedding").alias("vec_b"), F.col("label").alias("label_b"))
    return a.join(b, b["id_b"] == a["id_a"] + a["_o"]).drop("_o")


GOLD_PAIRS_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
gp AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.v AS vec_a, b.v AS vec_b, a.label AS label_a, b.label AS label_b
       FROM e a JOIN e b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2, a.vec_id + 3, a.vec_id + 4, a.vec_id + 5))
"""


def scored_pairs(spark: SparkSession, sf: str, metric: str = "cosine", dims=LADDER) -> DataFrame:
    """Gold pairs over the truncation ladder: ``label`` = full-width cosine, ``score`` = the
    chosen similarity of the d-prefixes (both rounded to 6 decimals), ``batch_id`` = id_a mod 20."""
    p = gold_pairs(spark, sf)
    p = p.withColumn("label", F.round(V.cosine("vec_a", "vec_b"), 6))
    p = p.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    sim = V.by_name(metric)
    score = sim(V.truncate("vec_a", F.col("dim")), V.truncate("vec_b", F.col("dim")))
    return p.select((F.col("id_a") % N_BATCHES).cast("int").alias("batch_id"), "id_a", "id_b", "label_a", "label_b",
                    "dim", "label", F.round(score, 6).alias("score"))


def scored_pairs_multi(spark: SparkSession, sf: str, metrics, dims=LADDER) -> DataFrame:
    """``scored_pairs`` for several similarity functions from one pair join: the scores are
    computed side by side in one projection and unpivoted into ``similarity_fn, score``."""
    p = gold_pairs(spark, sf)
    p = p.withColumn("label", F.round(V.cosine("vec_a", "vec_b"), 6))
    p = p.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    a, b = V.truncate("vec_a", F.col("dim")), V.truncate("vec_b", F.col("dim"))
    scores = F.array(*[F.struct(F.lit(m).alias("similarity_fn"), F.round(V.by_name(m)(a, b), 6).alias("score"))
                       for m in metrics])
    return p.select((F.col("id_a") % N_BATCHES).cast("int").alias("batch_id"), "id_a", "id_b", "label_a", "label_b",
                    "dim", "label", F.explode(scores).alias("_s")).select("*", "_s.similarity_fn", "_s.score").drop("_s")


def _sql_cos(a: str, b: str) -> str:
    return (f"CASE WHEN list_dot_product({a},{a}) > 0 AND list_dot_product({b},{b}) > 0 THEN "
            f"list_dot_product({a},{b}) / (sqrt(list_dot_product({a},{a})) * sqrt(list_dot_product({b},{b}))) ELSE 0 END")


def sql_similarity(metric: str, a: str, b: str) -> str:
    if metric == "cosine":
        return _sql_cos(a, b)
    if metric in ("dot", "dot_product"):
        return f"list_dot_product({a},{b})"
    if metric == "tanimoto":
        return (f"list_dot_product({a},{b}) / greatest(list_dot_product({a},{a}) + list_dot_product({b},{b}) "
                f"- list_dot_product({a},{b}), 1e-9)")
    if metric == "euclidean":
        return f"-sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
    if metric == "manhattan":
        return f"-list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"
    raise ValueError(metric)


def scored_pairs_sql(metric: str = "cosine", suffix: str = "") -> str:
    """CTEs e, gp, sp (each name followed by ``suffix``) deriving ``scored_pairs``."""
    sim = sql_similarity(metric, "list_slice(vec_a, 1, d)", "list_slice(vec_b, 1, d)")
    gp = GOLD_PAIRS_SQL.replace("e AS (", f"e{suffix} AS (").replace("FROM e a JOIN e b", f"FROM e{suffix} a JOIN e{suffix} b")
    gp = gp.replace("gp AS (", f"gp{suffix} AS (")
    return gp + f""",
sp{suffix} AS (SELECT CAST(id_a % 20 AS INTEGER) AS batch_id, id_a, id_b, label_a, label_b, d AS dim,
              round({_sql_cos('vec_a', 'vec_b')}, 6) AS label, round({sim}, 6) AS score
       FROM gp{suffix} CROSS JOIN (VALUES (64), (32), (16), (8)) t(d))
"""


N_CLASSES = 10
#: The whole vector as ten logits: component i counts for class i mod 10.
LOGITS_SQL = ("list_transform(range(0, 10), lambda c: list_sum(list_transform(range(c + 1, len(embedding) + 1, 10), "
              "lambda i: CAST(embedding[i] AS DOUBLE))))")


def logits_table(spark: SparkSession, sf: str) -> DataFrame:
    """Classification rows: logits = the whole vector folded into ten classes, class = ``label``, split by md5."""
    e = embeddings(spark, sf)

    def of_class(c: int):
        return lambda x, i: i % N_CLASSES == c

    logits = F.array(*[F.aggregate(F.filter("embedding", of_class(c)), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
                       for c in range(N_CLASSES)])
    return e.select("vec_id", logits.alias("logits"), "label", split_col())


def split_col() -> "F.Column":
    h = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(h < 8, "train").when(h < 9, "val").otherwise("test").alias("split")


SPLIT_SQL = ("CASE WHEN CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 8 THEN 'train' "
             "WHEN CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 9 THEN 'val' "
             "ELSE 'test' END")
