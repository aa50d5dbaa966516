"""Streaming (2.K) and the UDF surface (2.L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs as U
from ..functions import vectors as V
from ..operators import candidates as C
from ..session import scratch_path
from ..sources.tables import table
from ..streaming import ingest as S
from . import derived as D


def _arrival(col: str, n: int):
    return F.pmod(F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n))


def ingest_incremental(spark, sf):
    """Two arrivals of the embeddings table: the second run of the stream picks up only the
    second file set (batch 1); the sink equals the batch ladder table."""
    base = scratch_path(spark, "ingest")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    for arrival in range(2):
        e.where(_arrival("vec_id", 2) == arrival).write.mode("append").parquet(f"{base}/src")
        S.ingest_vectors(spark, f"{base}/src", e.schema, f"{base}/sink", f"{base}/ckpt", D.LADDER, "prefix", base_dim=64)
    back = spark.read.parquet(f"{base}/sink")
    return back.select(F.col("batch_id").cast("int").alias("batch_id"), "model", F.col("dim").cast("int").alias("dim"),
                       "vec_id", F.size("embedding").alias("n"), F.round(V.l2_norm("embedding"), 6).alias("norm"))


def resume_by_batch(spark, sf):
    """Two of three batches were written by an interrupted run of parallel writers; the others remain."""
    indexed = C.batch_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 64)
    path = scratch_path(spark, "resume-sink")
    indexed.where(F.floor(F.col("batch_start") / 64) % 3 != 1).write.parquet(path)
    return S.remaining_rows(indexed, spark.read.parquet(path), "batch_start").select("doc_id", "batch_start")


def library_update_stream(spark, sf):
    base = scratch_path(spark, "library")
    docs = table(spark, sf, "documents").select(F.col("text").alias("key"), F.col("n_chars").cast("double").alias("score"),
                                                "lang", "doc_id")
    lib0 = docs.where(F.col("lang") == "en").groupBy("key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "key").limit(50)
    lib0.write.parquet(f"{base}/lib/v=0")
    cands = docs.where(F.col("lang") != "en")
    for part in range(3):
        cands.where(_arrival("doc_id", 3) == part).select("key", "score").write.mode("append").parquet(f"{base}/src")
        S.library_stream(spark, f"{base}/src", "key string, score double", f"{base}/lib", f"{base}/ckpt", "key", "score", 50)
    return S.current_library(spark, f"{base}/lib").select(F.md5("key").alias("key_md5"), "score")


def embed_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    emb = U.embed_batches(d, "text", "v", lambda: U.hashed_token_encoder(64), batch_size=128, normalize=True,
                          truncate_dim=16)
    return emb.select("doc_id", F.posexplode("v").alias("pos", "value")).select(
        "doc_id", F.col("pos").cast("int").alias("pos"), F.round("value", 6).alias("value"))


SCORERS = ("n_chars", "n_tokens", "digit_ratio", "upper_ratio")


def score_function(spark, sf):
    """Every scorer in one pass over the documents."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    scores = [F.struct(F.lit(n).alias("name"), F.round(U.score_function(n)(F.col("text")), 6).alias("score")) for n in SCORERS]
    return d.select("doc_id", F.explode(F.array(*scores)).alias("_s")).select("doc_id", "_s.name", "_s.score")


def generate_candidates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lanes = C.weighted_lanes(d.select("doc_id"), ["doc_id"], [0.4, 0.6], [2, 1])
    refs = d.join(lanes, "doc_id")
    out = U.generate_candidates(refs, "doc_id", "text", "lane", U.sentence_drop_generator(3))
    return out.where("error IS NULL").select("doc_id", "cand_idx", F.md5("candidate").alias("candidate_md5"))


def custom_similarity(spark, sf):
    V.register_similarity("cosine_squared", U.cosine_squared, overwrite=True)
    p = D.gold_pairs(spark, sf)
    return p.select("id_a", "id_b", F.round(V.similarity("cosine_squared", "vec_a", "vec_b"), 6).alias("similarity"))


QUERIES = {
    "ingest_incremental": ingest_incremental,
    "resume_by_batch": resume_by_batch,
    "library_update_stream": library_update_stream,
    "embed_batches": embed_batches,
    "score_function": score_function,
    "generate_candidates": generate_candidates,
    "custom_similarity": custom_similarity,
}

_ARR2 = "CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2"
_NORM = "sqrt(list_dot_product(CAST(list_slice(embedding, 1, d) AS DOUBLE[]), CAST(list_slice(embedding, 1, d) AS DOUBLE[])))"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

ORACLE = {
    "ingest_incremental": f"""SELECT CAST({_ARR2} AS INTEGER) AS batch_id, 'prefix' AS model, CAST(d AS INTEGER) AS dim, vec_id,
        CAST(d AS INTEGER) AS n, round(CASE WHEN d < 64 AND {_NORM} > 0 THEN 1.0 ELSE {_NORM} END, 6) AS norm
        FROM embeddings CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)""",
    "resume_by_batch": """SELECT doc_id, batch_start FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64) * 64 AS batch_start
        FROM documents) WHERE (batch_start // 64) % 3 = 1""",
    "embed_batches": f"""WITH tk AS (SELECT doc_id, unnest({_TOK}) AS tok FROM documents),
        c AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS INTEGER) AS pos, count(*) AS cnt
              FROM tk GROUP BY ALL),
        c16 AS (SELECT * FROM c WHERE pos < 16),
        n AS (SELECT doc_id, sqrt(sum(cnt * cnt)) AS nrm FROM c16 GROUP BY doc_id),
        grid AS (SELECT doc_id, CAST(p AS INTEGER) AS pos FROM documents, range(16) r(p))
        SELECT g.doc_id, g.pos, round(CASE WHEN n.nrm > 0 THEN coalesce(c16.cnt, 0) / n.nrm ELSE 0 END, 6) AS value
        FROM grid g LEFT JOIN c16 ON c16.doc_id = g.doc_id AND c16.pos = g.pos LEFT JOIN n ON n.doc_id = g.doc_id""",
    "score_function": r"""SELECT doc_id, 'n_chars' AS name, round(CAST(length(text) AS DOUBLE), 6) AS score FROM documents
        UNION ALL SELECT doc_id, 'n_tokens', round(CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS DOUBLE), 6) FROM documents
        UNION ALL SELECT doc_id, 'digit_ratio', round(CASE WHEN length(text) > 0 THEN
            (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / length(text) ELSE 0 END, 6) FROM documents
        UNION ALL SELECT doc_id, 'upper_ratio', round(CASE WHEN length(text) > 0 THEN
            (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / length(text) ELSE 0 END, 6) FROM documents""",
    "generate_candidates": """WITH s AS (SELECT doc_id, string_split(text, '.') AS segs FROM documents),
        i AS (SELECT doc_id, segs, unnest(range(0, least(3, len(segs)))) AS i FROM s WHERE len(segs) >= 2)
        SELECT doc_id, CAST(i AS INTEGER) AS cand_idx,
          md5(array_to_string(list_concat(list_slice(segs, 1, i), list_slice(segs, i + 2, len(segs))), '.')) AS candidate_md5
        FROM i""",
    "library_update_stream": """WITH docs AS (SELECT text AS key, CAST(n_chars AS DOUBLE) AS score, lang,
            CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS part FROM documents),
        lib0 AS (SELECT key, max(score) AS score FROM docs WHERE lang = 'en' GROUP BY key ORDER BY score DESC, key LIMIT 50),""" + ",".join(
        f"""
        lib{i + 1} AS (SELECT key, max(score) AS score FROM (
            SELECT key, score FROM lib{i}
            UNION ALL SELECT key, score FROM docs WHERE lang <> 'en' AND part = {i} AND score IS NOT NULL
              AND score > (SELECT coalesce(min(score), 0.0) FROM lib{i}) AND key NOT IN (SELECT key FROM lib{i}))
          GROUP BY key ORDER BY score DESC, key LIMIT 50)""" for i in range(3)) + """
        SELECT md5(key) AS key_md5, score FROM lib3""",
    "custom_similarity": "WITH " + D.GOLD_PAIRS_SQL + f"SELECT id_a, id_b, round(({D._sql_cos('vec_a', 'vec_b')}) * "
                         f"({D._sql_cos('vec_a', 'vec_b')}), 6) AS similarity FROM gp",
}
