"""Registered queries: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bit_sliced, bpe, conversation_repair, hard_negatives, kdtree, licenses, ngram_join, packing, piece_bpe, ppm, pstable, quality, toxicity
from .common import fold, table


def op1_bit_sliced_topk(spark, sf_dir):
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op2_toxicity(spark, sf_dir):
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")),
                                  public_tokenizers.PATTERN, capacity=1024, end_id=2)


def op4_quality(spark, sf_dir):
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.encode_decode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
                             public_tokenizers.PATTERN)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = ppm.identify(docs, fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_kd_sharding(spark, sf_dir):
    out = kdtree.shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_ngram_jaccard(spark, sf_dir):
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark, sf_dir):
    return piece_bpe.encode_decode(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def damaged(conversations):
    """Rows with the contract's damage (NULLs: one space); ``here`` is false where it drops a row."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(text_of("role")).alias("role"), text.alias("text"),
                                (kind != 0).alias("here"), F.explode(copies).alias("copy"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), here=F.col("here"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, n_positives=5, n_negatives=5, scale=256.0, low_pct=80, high_pct=100)


def op7_embedding_near_dedup(spark, sf_dir):
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES = {
    "op1_bit_sliced_topk": op1_bit_sliced_topk,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op1_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    # the edits as one path through the rows: the cheapest (cost, audit) for each place, row by row
    "op12_conversation_repair": r"""
WITH RECURSIVE powers AS (
  SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS UBIGINT)] || CAST(range(8) AS UBIGINT[]),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), dealt AS (
  SELECT n.*, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS UBIGINT)),
         lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295::UBIGINT) % 20 AS kind FROM named n, powers
), rows_now AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         substr(role, 1, 1) AS ini, rtrim(ltrim(text, E' \t\n\x0b\x0c\r'), E' \t\n\x0b\x0c\r') AS body FROM rows_now
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{c: 0::BIGINT, a: '', m: ''}] AS s0, CAST([] AS STRUCT(c BIGINT, a VARCHAR, m VARCHAR)[]) AS s1,
         [{c: 5::BIGINT, a: 'I', m: chr(10) || 'user:'}] AS s2, [{c: 10::BIGINT, a: 'II', m: chr(10) || 'user:' || chr(10) || 'assistant:'}] AS s3
  FROM counted
  UNION ALL
  SELECT conv_id, i, n0, n1,
         list_sort(n2 || list_transform(n0 || n1 || n3, lambda x: {c: x.c + 5, a: x.a || 'I', m: x.m || chr(10) || 'user:'}))[:1],
         list_sort(n3 || list_transform(n2, lambda x: {c: x.c + 5, a: x.a || 'I', m: x.m || chr(10) || 'assistant:'})
                      || list_transform(n0 || n1, lambda x: {c: x.c + 10, a: x.a || 'II', m: x.m || chr(10) || 'user:' || chr(10) || 'assistant:'}))[:1]
  FROM (
    SELECT f.conv_id, f.i,
      list_transform(s0, lambda x: {c: x.c + 2, a: x.a || 'D', m: x.m}) AS n0,
      list_sort(list_transform(s1, lambda x: {c: x.c + 2, a: x.a || 'D', m: x.m})
        || list_transform(CASE WHEN f.fault IN ('', 'truncated') AND f.ini = 's' THEN s0 ELSE [] END,
             lambda x: {c: x.c + CASE WHEN f.fault = '' THEN 0 ELSE 5 END, a: x.a || 'K', m: x.m || chr(10) || f.role || ':' || f.text}))[:1] AS n1,
      list_sort(list_transform(s2, lambda x: {c: x.c + 2, a: x.a || 'D', m: x.m})
        || list_transform(CASE WHEN f.fault IN ('', 'truncated') THEN s0 || s1 || s3 ELSE [] END,
             lambda x: {c: x.c + CASE WHEN f.fault = '' THEN 0 ELSE 5 END + CASE WHEN f.ini = 'u' THEN 0 ELSE 1 END,
                        a: x.a || CASE WHEN f.ini = 'u' THEN 'K' ELSE 'R' END,
                        m: x.m || chr(10) || CASE WHEN f.ini = 'u' THEN f.role ELSE 'user' END || ':' || f.text}))[:1] AS n2,
      list_sort(list_transform(s3, lambda x: {c: x.c + 2, a: x.a || 'D', m: x.m})
        || list_transform(CASE WHEN f.fault IN ('', 'truncated') THEN s2 ELSE [] END,
             lambda x: {c: x.c + CASE WHEN f.fault = '' THEN 0 ELSE 5 END + CASE WHEN f.ini = 'a' THEN 0 ELSE 1 END,
                        a: x.a || CASE WHEN f.ini = 'a' THEN 'K' ELSE 'R' END,
                        m: x.m || chr(10) || CASE WHEN f.ini = 'a' THEN f.role ELSE 'assistant' END || ':' || f.text}))[:1] AS n3
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
), best AS (
  SELECT c.*, list_sort(s0 || s3)[1] AS b FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(substr(b.m, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""",
}
