"""Sources, sinks, preparation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import prep as P
from ..session import scratch_path
from ..sources import io
from ..sources.tables import table
from . import derived as D


def _docs(spark, sf):
    return table(spark, sf, "documents")


def scan_by_extension(spark, sf):
    return io.scan_by_extension(spark, f"{sf}/documents.parquet", ["doc_id", "lang", "n_chars"])


def _rescanned(spark, sf, extension: str, **options):
    """Documents written in another format and read again by extension with their schema."""
    docs = _docs(spark, sf).select("doc_id", "lang", "text", "n_chars")
    path = f"{scratch_path(spark, extension)}/documents.{extension}"
    io.sink_by_extension(docs, path)
    back = io.scan_by_extension(spark, path, ["doc_id", "lang", "text", "n_chars"], docs.schema, **options)
    return back.select("doc_id", "lang", "n_chars", F.md5("text").alias("text_md5"))


def scan_csv(spark, sf):
    return _rescanned(spark, sf, "csv", multiline=True)


def scan_json(spark, sf):
    return _rescanned(spark, sf, "json")


def scan_required_columns(spark, sf):
    return io.require_columns(_docs(spark, sf), ["source", "doc_id", "lang"])


def scan_headerless(spark, sf):
    path = scratch_path(spark, "headerless")
    _docs(spark, sf).select("source", F.col("doc_id").cast("string")).write.option("sep", " ").csv(path)
    return io.scan_headerless(spark, path, ("source", "doc_id"))


def scan_row_range(spark, sf, offset: int = 100, n: int = 500):
    return io.scan_row_range(spark, f"{sf}/documents.parquet", offset, n, ["doc_id", "lang"])


def _tagged(spark, sf):
    """Every document with its dataset (the language) and split: one scan, two columns."""
    return _docs(spark, sf).select(F.col("lang").alias("dataset"), P.hash_split("doc_id").alias("split"), "doc_id")


def split_union(spark, sf):
    return _tagged(spark, sf)


def split_union_tables(spark, sf):
    """Documents, benchmark items and pages as three datasets in three splits, united by name; a
    column that a dataset lacks is NULL there."""
    sets = {"documents": _docs(spark, sf).select(F.col("doc_id").alias("id"), F.md5("text").alias("content_md5"), "lang"),
            "benchmark": table(spark, sf, "benchmark").select(F.md5("text").alias("content_md5"), F.col("item_id").alias("id")),
            "pages": table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.md5("html").alias("content_md5"), "url")}
    parts = {split: {name: df.where(P.hash_split("id") == split) for name, df in sets.items()} for split in ("train", "val", "test")}
    return P.split_union(parts).select("dataset", "split", "id", "content_md5", "lang", "url")


def split_sizes(spark, sf):
    return P.split_sizes(_tagged(spark, sf), batch_size=32)


def pending_inputs(spark, sf):
    docs = _docs(spark, sf)
    done = docs.join(table(spark, sf, "labels").where(F.col("toxic") == 1), "doc_id").select("source")
    return P.pending_inputs(docs, "source", ["src1", "src2"], done, "source")


def materialize_if_absent(spark, sf):
    path = scratch_path(spark, "source-stats")
    build = lambda: _docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("docs"),
                                                          F.sum("n_chars").alias("chars"))
    first = io.materialize_if_absent(spark, path, build)
    return io.materialize_if_absent(spark, path, lambda: first.limit(0))  # second call reuses the table


def vector_table_write(spark, sf):
    path = scratch_path(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    for d in D.LADDER:
        io.vector_table_write(e.select("vec_id", V.truncate_renorm("embedding", d).alias("embedding")), path, "prefix", d)
    back = spark.read.parquet(path)
    return back.select("model", F.col("dim").cast("int").alias("dim"), "vec_id", F.size("embedding").alias("n"),
                       F.round(V.l2_norm("embedding"), 6).alias("norm"))


def vector_table_read_dim(spark, sf):
    path = scratch_path(spark, "vectors")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    for d in D.LADDER:
        io.vector_table_write(e.select("vec_id", V.truncate("embedding", d).alias("embedding")), path, "prefix", d)
    r = io.vector_table_read_dim(spark, path, "prefix", 16)
    return r.select("vec_id", F.size("embedding").alias("n"), F.round(V.l2_norm("embedding"), 6).alias("norm"))


def sink_parquet(spark, sf):
    path = scratch_path(spark, "sink")
    io.sink_parquet(_docs(spark, sf).select("doc_id", "lang", "n_chars"), path, codec="gzip")
    return spark.read.parquet(path)


def sink_tsv(spark, sf):
    base = scratch_path(spark, "tsv")
    e = table(spark, sf, "embeddings")
    io.sink_tsv(e, "vec_id", "embedding", f"{base}/matrix", f"{base}/meta", ["label"], 64)
    schema = ", ".join(f"c{i} double" for i in range(64))
    m = spark.read.schema(schema).option("sep", "\t").csv(f"{base}/matrix")
    return m.select(*[F.round(f"c{i}", 6).alias(f"c{i}") for i in range(4)],
                    F.round(sum(F.col(f"c{i}") for i in range(64)), 6).alias("total"))


def _results(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.lit("events").alias("run"), F.col("user_id").cast("int").alias("epoch"),
                     F.col("event_id").alias("steps"), F.col("event_type").alias("metric"),
                     F.col("value").cast("double").alias("value"))


def sink_results_append(spark, sf):
    path = scratch_path(spark, "results")
    r = _results(spark, sf)
    io.sink_results_append(r.where(F.col("metric") != "click"), path)
    io.sink_results_append(r.where(F.col("metric") == "click"), path)
    return io.read_results(spark, path)


def last_metric(spark, sf):
    return io.last_metric(_results(spark, sf))


def canonical_pairs(spark, sf):
    p = D.gold_pairs(spark, sf).withColumn("same", (F.col("label_a") == F.col("label_b")).cast("int"))
    return P.canonical_pairs(p, "id_a", "id_b", "same", "double")


def canonical_labelled(spark, sf):
    return P.canonical_labelled(table(spark, sf, "labels"), "doc_id", "quality")


def cast_schema(spark, sf):
    o = table(spark, sf, "orders")
    return P.cast_schema(o, {"o_orderkey": "bigint", "o_custkey": "int", "o_totalprice": "float",
                             "o_orderstatus": "string", "o_orderdate": "date"})


def sample_exact(spark, sf):
    return P.sample_exact(_docs(spark, sf).select("doc_id", "lang"), 100, 42, "doc_id", on_short="error")


def dedupe_keep_first(spark, sf):
    return P.dedupe_keep_first(_docs(spark, sf).select("doc_id", "text", "lang", "source"), ["text"], "doc_id") \
        .select("doc_id", "lang", "source")


def dedupe_canonical(spark, sf):
    return P.dedupe_canonical(_docs(spark, sf).select("doc_id", "text"), "text", "doc_id") \
        .select("doc_id", F.md5("canonical").alias("key_md5"))


def drop_missing(spark, sf):
    j = _docs(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.drop_missing(j, ["quality"]).select("doc_id", "lang", "quality")


def derive_column(spark, sf):
    expr = F.expr("try_cast(regexp_extract(text, '[0-9]+', 0) AS BIGINT)")
    return P.derive_column(_docs(spark, sf).select("doc_id", "text"), "first_number", expr).select("doc_id", "first_number")


def label_head(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("prob", F.round(F.abs(F.col("embedding")[0].cast("double")), 2))
    return P.label_head(e, "label", 3, 5, "vec_id", "prob", "label").select("vec_id", "label", "legend")


def union_all(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang")
    return P.union_all([docs.where(P.hash_split("doc_id") == s) for s in ("train", "val", "test")])


def union_distinct(spark, sf):
    a = _docs(spark, sf).select(F.md5("text").alias("text_md5"))
    b = table(spark, sf, "benchmark").select(F.md5("text").alias("text_md5"))
    return P.union_distinct([a, b])


def intersect_ids(spark, sf):
    return _docs(spark, sf).select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


def except_ids(spark, sf):
    return _docs(spark, sf).select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


def library_update(spark, sf):
    docs = _docs(spark, sf).select(F.col("text").alias("key"), F.col("n_chars").cast("double").alias("score"), "lang")
    lib = docs.where(F.col("lang") == "en").groupBy("key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "key").limit(50)
    cand = docs.where(F.col("lang") != "en").select("key", "score")
    return P.library_update(lib, cand, "key", "score", 50).select(F.md5("key").alias("key_md5"), "score")


def _library_and_candidates(spark, sf):
    docs = _docs(spark, sf).select(F.col("text").alias("key"), F.col("n_chars").cast("double").alias("score"), "source",
                                   "doc_id")
    # library: documents from the sources named up to 'src3'; candidates: all other sources
    return docs.where(F.col("source") <= "src3").select("key"), docs.where(F.col("source") > "src3")


def join_semi_seen(spark, sf):
    """Candidates whose key the library already holds (exact copies of English texts)."""
    lib, cand = _library_and_candidates(spark, sf)
    return cand.join(lib, "key", "left_semi").select("doc_id", "score")


def join_anti_new(spark, sf):
    lib, cand = _library_and_candidates(spark, sf)
    return cand.join(lib, "key", "left_anti").select("doc_id", "score")


QUERIES = {
    "join_semi_seen": join_semi_seen,
    "join_anti_new": join_anti_new,
    "scan_by_extension": scan_by_extension,
    "scan_csv": scan_csv,
    "scan_json": scan_json,
    "scan_required_columns": scan_required_columns,
    "scan_headerless": scan_headerless,
    "scan_row_range": scan_row_range,
    "split_union": split_union,
    "split_union_tables": split_union_tables,
    "split_sizes": split_sizes,
    "pending_inputs": pending_inputs,
    "materialize_if_absent": materialize_if_absent,
    "vector_table_write": vector_table_write,
    "vector_table_read_dim": vector_table_read_dim,
    "sink_parquet": sink_parquet,
    "sink_tsv": sink_tsv,
    "sink_results_append": sink_results_append,
    "last_metric": last_metric,
    "canonical_pairs": canonical_pairs,
    "canonical_labelled": canonical_labelled,
    "cast_schema": cast_schema,
    "sample_exact": sample_exact,
    "dedupe_keep_first": dedupe_keep_first,
    "dedupe_canonical": dedupe_canonical,
    "drop_missing": drop_missing,
    "derive_column": derive_column,
    "label_head": label_head,
    "union_all": union_all,
    "union_distinct": union_distinct,
    "intersect_ids": intersect_ids,
    "except_ids": except_ids,
    "library_update": library_update,
}

_SPLIT = ("CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 8 THEN 'train' "
          "WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 9 THEN 'val' ELSE 'test' END")
_TAGGED = f"tg AS (SELECT lang AS dataset, {_SPLIT} AS split, doc_id FROM documents)"
_NORM = "sqrt(list_dot_product(CAST(list_slice(embedding, 1, d) AS DOUBLE[]), CAST(list_slice(embedding, 1, d) AS DOUBLE[])))"

ORACLE = {
    "join_semi_seen": """SELECT doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents d WHERE source > 'src3'
        AND EXISTS (SELECT 1 FROM documents l WHERE l.source <= 'src3' AND l.text = d.text)""",
    "join_anti_new": """SELECT doc_id, CAST(n_chars AS DOUBLE) AS score FROM documents d WHERE source > 'src3'
        AND NOT EXISTS (SELECT 1 FROM documents l WHERE l.source <= 'src3' AND l.text = d.text)""",
    "scan_by_extension": "SELECT doc_id, lang, n_chars FROM documents",
    "scan_csv": "SELECT doc_id, nullif(lang, '') AS lang, n_chars, md5(nullif(text, '')) AS text_md5 FROM documents",
    "scan_json": "SELECT doc_id, lang, n_chars, md5(text) AS text_md5 FROM documents",
    "scan_required_columns": "SELECT source, doc_id, lang FROM documents",
    "scan_headerless": "SELECT source, CAST(doc_id AS VARCHAR) AS doc_id FROM documents",
    "scan_row_range": """SELECT doc_id, lang, row_number FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS row_number
        FROM documents) WHERE row_number > 100 AND row_number <= 600""",
    "split_union": f"WITH {_TAGGED} SELECT dataset, split, doc_id FROM tg",
    "split_union_tables": f"""WITH t AS (SELECT 'documents' AS dataset, doc_id AS id, md5(text) AS content_md5, lang, CAST(NULL AS VARCHAR) AS url FROM documents
        UNION ALL SELECT 'benchmark', item_id, md5(text), NULL, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, md5(html), NULL, url FROM pages)
        SELECT dataset, {_SPLIT.replace("doc_id", "id")} AS split, id, content_md5, lang, url FROM t""",
    "split_sizes": f"""WITH {_TAGGED}, per AS (SELECT dataset, split, count(*) AS rows FROM tg GROUP BY dataset, split),
        tot AS (SELECT split, sum(rows) AS split_rows FROM per GROUP BY split)
        SELECT dataset, split, rows, CAST(split_rows AS BIGINT) AS split_rows, round(1e-5 * sqrt(32.0), 12) AS scaled_lr,
          round(0.05 * sqrt(32.0 / (split_rows * 32.0 * 1)), 12) AS weight_decay FROM per JOIN tot USING (split)""",
    "pending_inputs": """WITH c AS (SELECT DISTINCT source FROM documents WHERE contains(source, 'src1') OR contains(source, 'src2')),
        d AS (SELECT DISTINCT d.source AS done FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)
        SELECT source FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE instr(c.source, d.done) > 0)""",
    "materialize_if_absent": "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source",
    "vector_table_write": f"""SELECT 'prefix' AS model, CAST(d AS INTEGER) AS dim, vec_id, CAST(d AS INTEGER) AS n,
        round(CASE WHEN d < len(embedding) AND {_NORM} > 0 THEN 1.0 ELSE {_NORM} END, 6) AS norm
        FROM embeddings CROSS JOIN (VALUES (64), (32), (16), (8)) t(d)""",
    "vector_table_read_dim": """SELECT vec_id, 16 AS n, round(sqrt(list_dot_product(CAST(list_slice(embedding, 1, 16) AS DOUBLE[]),
        CAST(list_slice(embedding, 1, 16) AS DOUBLE[]))), 6) AS norm FROM embeddings""",
    "sink_parquet": "SELECT doc_id, lang, n_chars FROM documents",
    "sink_tsv": "SELECT " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS c{i}" for i in range(4))
                + ", round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
    "sink_results_append": """SELECT 'events' AS run, CAST(user_id AS INTEGER) AS epoch, event_id AS steps, event_type AS metric,
        value FROM events""",
    "last_metric": """SELECT event_type AS metric, value FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id DESC) = 1""",
    "canonical_pairs": """WITH e AS (SELECT vec_id, label FROM embeddings)
        SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS DOUBLE) AS label
        FROM e a JOIN e b ON b.vec_id IN (a.vec_id + 1, a.vec_id + 2, a.vec_id + 3, a.vec_id + 4, a.vec_id + 5)""",
    "canonical_labelled": "SELECT doc_id AS id, CAST(quality AS BIGINT) AS label FROM labels",
    "cast_schema": """SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, CAST(o_totalprice AS FLOAT) AS o_totalprice,
        o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders""",
    "sample_exact": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100",
    "dedupe_keep_first": """SELECT doc_id, lang, source FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "dedupe_canonical": r"""WITH k AS (SELECT doc_id, coalesce(
            CASE WHEN NOT regexp_matches(text, '[\x00-\x08\x0E-\x1F\x{FFFD}]') THEN nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '') END,
            nullif(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g'), '')) AS canonical FROM documents)
        SELECT doc_id, md5(canonical) AS key_md5 FROM k WHERE canonical IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY doc_id) = 1""",
    "drop_missing": """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)
        WHERE l.quality IS NOT NULL""",
    "derive_column": """SELECT doc_id, first_number FROM (SELECT doc_id,
        TRY_CAST(regexp_extract(text, '[0-9]+', 0) AS BIGINT) AS first_number FROM documents) WHERE first_number IS NOT NULL""",
    "label_head": """SELECT vec_id, label, CAST(label AS VARCHAR) || ' - prob: ' ||
        format('{:.2f}', round(abs(CAST(embedding[1] AS DOUBLE)), 2)) AS legend
        FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 5""",
    "union_all": "SELECT doc_id, lang FROM documents",
    "union_distinct": "SELECT md5(text) AS text_md5 FROM documents UNION SELECT md5(text) FROM benchmark",
    "intersect_ids": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "except_ids": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "library_update": """WITH docs AS (SELECT text AS key, CAST(n_chars AS DOUBLE) AS score, lang FROM documents),
        lib AS (SELECT key, max(score) AS score FROM docs WHERE lang = 'en' GROUP BY key ORDER BY score DESC, key LIMIT 50),
        mn AS (SELECT coalesce(min(score), 0.0) AS m FROM lib),
        fresh AS (SELECT key, score FROM docs, mn WHERE lang <> 'en' AND score IS NOT NULL AND score > m
                  AND key NOT IN (SELECT key FROM lib)),
        merged AS (SELECT key, max(score) AS score FROM (SELECT * FROM lib UNION ALL SELECT * FROM fresh) GROUP BY key)
        SELECT md5(key) AS key_md5, score FROM merged ORDER BY score DESC, key LIMIT 50""",
}
