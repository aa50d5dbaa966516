"""Fingerprints (2.I) and candidate generation post-processing (2.F, 2.H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import candidates as C
from ..operators import fingerprints as FP
from ..session import reliable_checkpoint
from ..sources.tables import table

FP_SIZE = 2048
LADDER_SIZES = (2048, 1024, 256, 64)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def fp_shingle(spark, sf):
    bits = FP.shingle_fingerprint(_docs(spark, sf), "doc_id", "text", FP_SIZE, radius=2, held=True)
    return FP.bits_summary(bits, ["doc_id"]).withColumn("n_bits", F.col("n_bits").cast("long"))


def fp_shingle_functional(spark, sf):
    bits = FP.shingle_fingerprint(_docs(spark, sf), "doc_id", "text", FP_SIZE, radius=2, functional=True, held=True)
    return FP.bits_summary(bits, ["doc_id"]).withColumn("n_bits", F.col("n_bits").cast("long"))


def fp_size_ladder(spark, sf):
    bits = FP.shingle_fingerprint(_docs(spark, sf), "doc_id", "text", radius=2, sizes=LADDER_SIZES, held=True)
    return FP.bits_summary(bits, ["doc_id", "fp_size"]).withColumn("n_bits", F.col("n_bits").cast("long"))


def _graph(spark, sf):
    """A path graph per order: its line numbers in order.  The edges come from the node before and
    after, within an order's few lines; no join of the table with itself."""
    li = table(spark, sf, "lineitem")
    nodes = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("lbl"))
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    near = nodes.select("l_orderkey", F.col("l_linenumber").alias("src"),
                        F.array(F.lag("l_linenumber").over(at), F.lead("l_linenumber").over(at)).alias("_near"))
    edges = near.select("l_orderkey", "src", F.explode("_near").alias("dst"))
    return nodes, edges.where(F.abs(F.col("dst") - F.col("src")) == 1)


def fp_graph(spark, sf):
    nodes, edges = _graph(spark, sf)
    bits = FP.graph_fingerprint(nodes, edges, "l_orderkey", "l_linenumber", "lbl", radius=2, fp_size=FP_SIZE)
    return FP.bits_summary(bits, ["l_orderkey"]).withColumn("n_bits", F.col("n_bits").cast("long"))


#: Coarser classes of the node labels: returned or not.
FUNCTIONAL_LABELS = {"AF": "returned", "RF": "returned", "NF": "kept", "NO": "kept"}


def fp_graph_functional(spark, sf):
    nodes, edges = _graph(spark, sf)
    bits = FP.graph_fingerprint(nodes, edges, "l_orderkey", "l_linenumber", "lbl", radius=2, fp_size=FP_SIZE,
                                functional=FUNCTIONAL_LABELS)
    return FP.bits_summary(bits, ["l_orderkey"]).withColumn("n_bits", F.col("n_bits").cast("long"))


def _doc_pairs(spark, sf, offsets):
    """(id, id + offset) with both fingerprints, packed into 32 integers each."""
    bits = FP.shingle_fingerprint(_docs(spark, sf), "doc_id", "text", FP_SIZE, radius=2, held=True)
    fp = reliable_checkpoint(FP.packed_bits(bits, ["doc_id"], FP_SIZE))
    a = fp.select(F.col("doc_id").alias("id_a"), F.col("words").alias("bits_a"),
                  F.explode(F.array(*[F.lit(o) for o in offsets])).alias("_o"))
    b = fp.select(F.col("doc_id").alias("id_b"), F.col("words").alias("bits_b"))
    return a.join(b, b["id_b"] == a["id_a"] + a["_o"])


def sim_tanimoto_bits(spark, sf):
    p = _doc_pairs(spark, sf, [1])
    return p.select("id_a", "id_b", F.round(V.tanimoto_packed("bits_a", "bits_b"), 6).alias("similarity"))


def fp_similarity_pairs(spark, sf):
    p = _doc_pairs(spark, sf, [1, 2, 3, 4, 5])
    return p.select("id_a", "id_b", F.round(V.tanimoto_packed("bits_a", "bits_b"), 6).alias("similarity"))


def _cands(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             "l_extendedprice", "l_discount")
    max_price = li.agg(F.max("l_extendedprice")).scalar()
    return C.score_candidates(o, li, "o_orderkey", "l_orderkey", F.col("l_extendedprice") / max_price,
                              F.lit(1.0) - F.col("l_discount"))


_KEYS = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def join_reference_candidates(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", "o_orderpriority", "l_linenumber",
                                                                     "l_partkey", "l_extendedprice")


def score_candidates(spark, sf):
    c = _cands(spark, sf)
    return c.select(*_KEYS, F.round("base_score", 6).alias("base_score"), F.round("similarity", 6).alias("similarity"),
                    F.round("score", 6).alias("score"))


def composite_score(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.round(V.composite_score(F.col("l_tax") * 10, F.lit(1.0) - F.col("l_discount"), 0.9, 0.5), 6)
                     .alias("score"))


def changed_only(spark, sf):
    from ..operators.prep import changed_only as co
    c = _cands(spark, sf)
    return co(c, "similarity").select(*_KEYS, F.round("similarity", 6).alias("similarity"))


def _order():
    return [F.col("score").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]


def topk_per_group(spark, sf):
    c = _cands(spark, sf).select(*_KEYS, F.round("score", 6).alias("score"))
    return C.topk_per_group(c, ["o_orderkey"], _order(), 3, reference_quirk=True)


def best_per_group(spark, sf):
    c = _cands(spark, sf).select(*_KEYS, F.round("score", 6).alias("score"))
    return C.best_per_group(c, ["o_orderkey"], "score", ["l_linenumber", "l_partkey", "l_suppkey"])


def topn_global(spark, sf):
    c = _cands(spark, sf).select(*_KEYS, F.round("score", 6).alias("score"))
    return C.topn_global(c, _order()[:1] + [F.col("o_orderkey")] + _order()[1:], 100)


def weighted_lanes(spark, sf):
    d = _docs(spark, sf).select("doc_id")
    return C.weighted_lanes(d, ["doc_id"], [0.4, 0.6], [2, 1])


def batch_index(spark, sf):
    return C.batch_index(_docs(spark, sf).select("doc_id"), ["doc_id"], 64)


def mask_segment(spark, sf):
    m = C.mask_segment(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", seed=7, min_tokens=1, max_tokens=5)
    return m.select("doc_id", "seg_pos", "n_tokens", "mask", F.md5("masked").alias("masked_md5"))


def mask_repeat(spark, sf):
    m = C.mask_repeat(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", 3, seed=7, min_tokens=2, max_tokens=6)
    return m.select("doc_id", F.col("round").cast("int").alias("round"), "seg_pos", "n_tokens", "mask",
                    F.md5("masked").alias("masked_md5"))


def fragment_explode(spark, sf):
    f = C.fragment_explode(_docs(spark, sf), "doc_id", "text", "n_chars")
    return f.select("doc_id", F.col("n_chars").alias("score"), F.md5("fragment").alias("fragment_md5"))


LIBRARY_SIZE = 1000


def fragment_library(spark, sf):
    """An empty library is offered the documents that aren't English, then all documents.  Kinds: fragments
    held and records accepted."""
    docs = _docs(spark, sf).select("text", F.col("n_chars").cast("double").alias("score"), "lang")
    library, records = docs.select(F.col("text").alias("fragment"), "score").limit(0), docs.select("text", "score").limit(0)
    for offered in (docs.where(F.col("lang") != "en"), docs):
        library, records = C.fragment_library_update(library, records, offered, "text", "score", LIBRARY_SIZE)
    return (library.select(F.lit("fragment").alias("kind"), F.md5("fragment").alias("key_md5"), "score")
            .unionByName(records.select(F.lit("record").alias("kind"), F.md5("text").alias("key_md5"), "score")))


def fragment_pair_combine(spark, sf):
    f = C.fragment_explode(_docs(spark, sf), "doc_id", "text", "n_chars")
    pairs = C.fragment_pair_combine(f, "fragment", seed=3)
    return pairs.select(F.md5("left").alias("left_md5"), F.md5("right").alias("right_md5"),
                        F.md5("combined").alias("combined_md5"))


def feature_families(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(C.feature_families(F.col("text")), ",").alias("families"))


def tokenize_strings(spark, sf):
    d = _docs(spark, sf).select("doc_id", C.tokenize(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").cast("long").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("tokens_md5"))


QUERIES = {
    "fp_shingle": fp_shingle,
    "fp_shingle_functional": fp_shingle_functional,
    "fp_size_ladder": fp_size_ladder,
    "fp_graph": fp_graph,
    "fp_graph_functional": fp_graph_functional,
    "sim_tanimoto_bits": sim_tanimoto_bits,
    "fp_similarity_pairs": fp_similarity_pairs,
    "join_reference_candidates": join_reference_candidates,
    "score_candidates": score_candidates,
    "composite_score": composite_score,
    "changed_only": changed_only,
    "topk_per_group": topk_per_group,
    "best_per_group": best_per_group,
    "topn_global": topn_global,
    "weighted_lanes": weighted_lanes,
    "batch_index": batch_index,
    "mask_segment": mask_segment,
    "mask_repeat": mask_repeat,
    "fragment_explode": fragment_explode,
    "fragment_library": fragment_library,
    "fragment_pair_combine": fragment_pair_combine,
    "feature_families": feature_families,
    "tokenize_strings": tokenize_strings,
}

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CLASS = ("list_transform({t}, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'N' WHEN length(x) <= 3 THEN 'S' "
          "WHEN length(x) <= 7 THEN 'M' ELSE 'L' END)")


def _grams_sql(tok_expr: str) -> str:
    parts = [f"list_transform(range(0, greatest(len(tk) - {n} + 1, 0)), lambda i: '{n}:' || "
             f"array_to_string(list_slice(tk, i + 1, i + {n}), ' '))" for n in (1, 2, 3)]
    return f"""t AS (SELECT doc_id, {tok_expr} AS tk FROM documents),
g AS (SELECT doc_id, unnest(list_concat({', '.join(parts)})) AS gram FROM t)"""


def _bits_sql(size_expr: str = "2048", keys: str = "doc_id") -> str:
    return f"""c AS (SELECT {keys}, CAST(('0x' || substr(md5(gram), 1, 8)) AS BIGINT) % ({size_expr} // 4) AS bucket,
                  count(*) AS cnt FROM g GROUP BY ALL),
b AS (SELECT {keys}, CAST(bucket * 4 + j AS INTEGER) AS bit FROM c, (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) th(j, t) WHERE cnt >= t)"""


_SUMMARY = "count(*) AS n_bits, md5(string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit)) AS bits_md5"

_DOC_BITS = ("WITH " + _grams_sql(_TOK) + ", " + _bits_sql() +
             ", fp AS (SELECT doc_id, list_sort(list(DISTINCT bit)) AS bits FROM b GROUP BY doc_id)")

_CANDS = """cands AS (SELECT o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
       l.l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS base_score, 1.0 - l.l_discount AS similarity
    FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
sc AS (SELECT *, least(greatest(base_score / 0.9, 0), 1) + least(greatest(similarity / 0.7, 0), 1) AS score FROM cands
       WHERE base_score IS NOT NULL AND similarity IS NOT NULL),
r AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round(score, 6) AS score FROM sc)"""

_H40 = "CAST(('0x' || substr({h}, 1, 10)) AS BIGINT)"
_GRAPH = """nodes AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS lbl FROM lineitem GROUP BY ALL),
fwd AS (SELECT a.l_orderkey, a.l_linenumber AS src, b.l_linenumber AS dst FROM nodes a JOIN nodes b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
edges AS (SELECT l_orderkey, src, dst FROM fwd UNION ALL SELECT l_orderkey, dst, src FROM fwd),
h0 AS (SELECT l_orderkey, l_linenumber, md5(lbl) AS h FROM nodes),
n1 AS (SELECT e.l_orderkey, e.src, sum(""" + _H40.format(h="h.h") + """) AS s, count(*) AS deg FROM edges e
       JOIN h0 h ON h.l_orderkey = e.l_orderkey AND h.l_linenumber = e.dst GROUP BY ALL),
h1 AS (SELECT h.l_orderkey, h.l_linenumber, md5(h.h || ':' || CAST(coalesce(n.s, 0) AS VARCHAR) || ':' ||
       CAST(coalesce(n.deg, 0) AS VARCHAR)) AS h FROM h0 h LEFT JOIN n1 n ON n.l_orderkey = h.l_orderkey AND n.src = h.l_linenumber),
n2 AS (SELECT e.l_orderkey, e.src, sum(""" + _H40.format(h="h.h") + """) AS s, count(*) AS deg FROM edges e
       JOIN h1 h ON h.l_orderkey = e.l_orderkey AND h.l_linenumber = e.dst GROUP BY ALL),
h2 AS (SELECT h.l_orderkey, h.l_linenumber, md5(h.h || ':' || CAST(coalesce(n.s, 0) AS VARCHAR) || ':' ||
       CAST(coalesce(n.deg, 0) AS VARCHAR)) AS h FROM h1 h LEFT JOIN n2 n ON n.l_orderkey = h.l_orderkey AND n.src = h.l_linenumber),
allh AS (SELECT l_orderkey, h FROM h0 UNION ALL SELECT l_orderkey, h FROM h1 UNION ALL SELECT l_orderkey, h FROM h2),
c AS (SELECT l_orderkey, CAST(('0x' || substr(md5(h), 1, 8)) AS BIGINT) % 512 AS bucket, count(*) AS cnt FROM allh GROUP BY ALL),
b AS (SELECT l_orderkey, CAST(bucket * 4 + j AS INTEGER) AS bit FROM c, (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) th(j, t) WHERE cnt >= t)"""

_SEG = "string_split(text, '.')"
_HASH = "CAST(('0x' || substr(md5('{seed}:' || CAST(doc_id AS VARCHAR) || ':' || {rnd} || ':{tag}'), 1, 8)) AS BIGINT)"


def _mask_sql(seed: int, lo: int, hi: int, rnd: str) -> str:
    pos = f"({_HASH.format(seed=seed, rnd=rnd, tag='seg')} % len(segs))"
    n = f"({lo} + {_HASH.format(seed=seed, rnd=rnd, tag='len')} % {hi - lo})"
    return f"""m0 AS (SELECT doc_id, {rnd} AS rnd, {_SEG} AS segs, {pos} AS seg_pos, {n} AS n_tokens FROM documents{', ' + 'rr' if rnd != "'0'" else ''}),
m1 AS (SELECT *, '[*{{' || CAST(length(segs[seg_pos + 1]) AS VARCHAR) || '-' ||
       CAST(length(segs[seg_pos + 1]) + n_tokens AS VARCHAR) || '}}]' AS mask FROM m0),
m2 AS (SELECT *, array_to_string(list_transform(range(0, len(segs)), lambda i: CASE WHEN i = seg_pos THEN mask ELSE segs[i + 1] END), '.')
       AS masked FROM m1)"""


_FRAG = r"""fr AS (SELECT DISTINCT doc_id, n_chars, f AS fragment FROM (SELECT doc_id, n_chars,
        unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?;\n]+'), lambda x: trim(x)), lambda x: length(x) > 0)) AS f
        FROM documents))"""

def _round_sql(i: int, offered: str) -> str:
    """CTEs of one round: lib{i} and rec{i} from lib{i-1} and rec{i-1}."""
    return rf"""
acc{i} AS (SELECT text, max(score) AS score FROM o WHERE {offered} AND text IS NOT NULL AND score > (SELECT coalesce(min(score), 0.0) FROM lib{i - 1})
           AND NOT EXISTS (SELECT 1 FROM rec{i - 1} r WHERE r.text = o.text) GROUP BY text),
lib{i} AS (SELECT fragment, max(score) AS score FROM (SELECT * FROM lib{i - 1} UNION ALL SELECT {_PIECES} AS fragment, score FROM acc{i})
           GROUP BY fragment ORDER BY score DESC, fragment LIMIT {LIBRARY_SIZE}),
rec{i} AS (SELECT * FROM rec{i - 1} UNION ALL SELECT * FROM acc{i})"""


_PIECES = r"unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?;\n]+'), lambda x: trim(x)), lambda x: length(x) > 0))"
_LIBRARY = """o AS (SELECT text, CAST(n_chars AS DOUBLE) AS score, lang FROM documents),
lib0 AS (SELECT text AS fragment, score FROM o WHERE FALSE),
rec0 AS (SELECT text, score FROM o WHERE FALSE),""" + _round_sql(1, "lang <> 'en'") + "," + _round_sql(2, "TRUE")

ORACLE = {
    "fp_shingle": "WITH " + _grams_sql(_TOK) + ", " + _bits_sql() + f" SELECT doc_id, {_SUMMARY} FROM b GROUP BY doc_id",
    "fp_shingle_functional": "WITH " + _grams_sql(_CLASS.format(t=_TOK)) + ", " + _bits_sql()
                             + f" SELECT doc_id, {_SUMMARY} FROM b GROUP BY doc_id",
    "fp_size_ladder": "WITH " + _grams_sql(_TOK).replace("unnest(list_concat", "s.fp_size, unnest(list_concat").replace(
        "AS gram FROM t)", "AS gram FROM t, (VALUES (2048), (1024), (256), (64)) s(fp_size))")
        + ", " + _bits_sql("fp_size", "doc_id, fp_size") + f" SELECT doc_id, fp_size, {_SUMMARY} FROM b GROUP BY doc_id, fp_size",
    "fp_graph": "WITH " + _GRAPH + f" SELECT l_orderkey, {_SUMMARY} FROM b GROUP BY l_orderkey",
    "fp_graph_functional": "WITH " + _GRAPH.replace("md5(lbl)", "md5(CASE WHEN lbl IN ('AF', 'RF') THEN 'returned' WHEN lbl IN ('NF', 'NO') THEN 'kept' ELSE lbl END)") + f" SELECT l_orderkey, {_SUMMARY} FROM b GROUP BY l_orderkey",
    "sim_tanimoto_bits": _DOC_BITS + """ SELECT a.doc_id AS id_a, b.doc_id AS id_b, round(CASE WHEN len(list_distinct(list_concat(a.bits, b.bits))) > 0
        THEN len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits))) ELSE 0 END, 6) AS similarity
        FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 1""",
    "fp_similarity_pairs": _DOC_BITS + """ SELECT a.doc_id AS id_a, b.doc_id AS id_b, round(CASE WHEN len(list_distinct(list_concat(a.bits, b.bits))) > 0
        THEN len(list_intersect(a.bits, b.bits)) / len(list_distinct(list_concat(a.bits, b.bits))) ELSE 0 END, 6) AS similarity
        FROM fp a JOIN fp b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2, a.doc_id + 3, a.doc_id + 4, a.doc_id + 5)""",
    "join_reference_candidates": """SELECT o.o_orderkey, o.o_orderpriority, l.l_linenumber, l.l_partkey, l.l_extendedprice
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""",
    "score_candidates": "WITH " + _CANDS + """ SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round(base_score, 6) AS base_score,
        round(similarity, 6) AS similarity, round(score, 6) AS score FROM sc""",
    "composite_score": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        round(least(greatest(l_tax * 10 / 0.9, 0), 1) + least(greatest((1.0 - l_discount) / 0.5, 0), 1), 6) AS score FROM lineitem""",
    "changed_only": "WITH " + _CANDS + """ SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round(similarity, 6) AS similarity
        FROM sc WHERE round(similarity, 6) <> 1.0""",
    "topk_per_group": "WITH " + _CANDS + """ SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM r
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey)
              <= least(3, count(*) OVER (PARTITION BY o_orderkey) - 1)""",
    "best_per_group": "WITH " + _CANDS + """ SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM r
        QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
    "topn_global": "WITH " + _CANDS + """ SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, score FROM r
        ORDER BY score DESC, o_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""",
    "weighted_lanes": """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS total FROM documents),
        s AS (SELECT *, CAST(floor(total * 0.4) AS BIGINT) AS b1 FROM n),
        g AS (SELECT *, CASE WHEN p >= b1 THEN 1 ELSE 0 END AS segment,
                 CASE WHEN p >= b1 THEN b1 ELSE 0 END AS st, CASE WHEN p >= b1 THEN total ELSE b1 END AS en,
                 CASE WHEN p >= b1 THEN 1 ELSE 2 END AS m, CASE WHEN p >= b1 THEN 2 ELSE 0 END AS base FROM s),
        q AS (SELECT *, (en - st) // m AS q, (en - st) - ((en - st) // m) * m AS r, p - st AS pp FROM g)
        SELECT doc_id, CAST(segment AS INTEGER) AS segment, CAST(base + CASE WHEN pp < r * (q + 1) THEN pp // (q + 1)
               ELSE r + (pp - r * (q + 1)) // q END AS INTEGER) AS lane FROM q""",
    "batch_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, "
                   "((row_number() OVER (ORDER BY doc_id) - 1) // 64) * 64 AS batch_start FROM documents",
    "mask_segment": "WITH " + _mask_sql(7, 1, 5, "'0'") + """ SELECT doc_id, CAST(seg_pos AS INTEGER) AS seg_pos,
        CAST(n_tokens AS INTEGER) AS n_tokens, mask, md5(masked) AS masked_md5 FROM m2""",
    "mask_repeat": "WITH rr AS (SELECT unnest([1, 2, 3]) AS round), " + _mask_sql(7, 2, 6, "CAST(round AS VARCHAR)")
                   + """ SELECT doc_id, CAST(rnd AS INTEGER) AS round, CAST(seg_pos AS INTEGER) AS seg_pos,
        CAST(n_tokens AS INTEGER) AS n_tokens, mask, md5(masked) AS masked_md5 FROM m2""",
    "fragment_explode": "WITH " + _FRAG + " SELECT doc_id, n_chars AS score, md5(fragment) AS fragment_md5 FROM fr",
    "fragment_library": "WITH " + _LIBRARY + """ SELECT 'fragment' AS kind, md5(fragment) AS key_md5, score FROM lib2
        UNION ALL SELECT 'record', md5(text), score FROM rec2""",
    "fragment_pair_combine": "WITH " + _FRAG + """, d AS (SELECT DISTINCT fragment FROM fr),
        n AS (SELECT fragment, row_number() OVER (ORDER BY md5('3:' || fragment), fragment) AS rn FROM d)
        SELECT md5(a.fragment) AS left_md5, md5(b.fragment) AS right_md5, md5(a.fragment || '.' || b.fragment) AS combined_md5
        FROM n a JOIN n b ON b.rn = a.rn + 1""",
    "feature_families": "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in C.FEATURE_FAMILIES.items())
        + "], lambda x: x IS NOT NULL)), ',') AS families FROM documents",
    "tokenize_strings": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}]+|[0-9]+|[^\s\p{L}0-9]')) AS BIGINT) AS n_tokens,
        md5(array_to_string(regexp_extract_all(text, '[\p{L}]+|[0-9]+|[^\s\p{L}0-9]'), ' ')) AS tokens_md5 FROM documents""",
}
