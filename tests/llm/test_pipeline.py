
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from embedframe.llm import queries
from embedframe.llm.common import table

from ..conftest import SF001, SF01
from .conftest import DOCS, edge_rows
from .test_ngram_join import brute

CONTRACT = {
    "op1_bit_sliced_topk": ["query_id", "rank", "vec_id", "score"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_license_scan": ["doc_id", "license", "start", "past", "coverage"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("name", CONTRACT)
def test_queries_return_their_columns_for_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, SF001)
    assert set(CONTRACT[name]) <= set(df.columns)
    if "doc_id" in df.columns and name not in ("op3_best_fit_packing", "op5_license_scan"):
        assert df.count() == table(spark, SF001, "documents").count()


def test_stages_on_sf001(spark, tmp_path):
    docs = table(spark, SF01, "documents")
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in table(spark, SF01, "labels").collect()}
    kept = {}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF01).write.parquet(f"file://{tmp_path}/{k}")
        before, columns = docs, docs.columns
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = ({r["doc_id"] for r in before.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()})
    start, toxic_kept = kept["toxicity"]
    clean = [i for i in start if i in labels and not labels[i]["toxic"]]
    toxic = [i for i in start if i in labels and labels[i]["toxic"]]
    assert sum(i in toxic_kept for i in clean) >= 0.98 * len(clean) and sum(i in toxic_kept for i in toxic) < 0.5 * len(toxic)
    start, good = kept["quality"]
    fine = [i for i in start if i in labels and labels[i]["quality"]]
    assert sum(i in good for i in fine) >= 0.98 * len(fine)
    start, single = kept["ngram_jaccard"]
    assert single == {i for i, (_, c) in brute([(i, by_id[i]) for i in start]).items() if i == c}
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == single


def test_edge_rows_pass_every_stage(spark, edge_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(14)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    docs = edge_docs
    for k, (_, stage) in enumerate(P.STAGES[:3]):
        stage(spark, docs, sf).write.parquet(f"{sf}/s{k}")
        docs = spark.read.parquet(f"{sf}/s{k}")
        assert docs.columns == [f.name for f in DOCS.fields]
    # nothing is toxic or bad here; the copy of 0 and the repeated row go
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    want = {r[0] for r in edge_rows()} - {1, 6, 13}
    assert {None if n else i for n, i in ids} >= want and len(ids) <= len(edge_rows()) - 3
    for _, stage in P.STAGES:
        assert stage(spark, no_docs, sf).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    out = P.run(spark, SF001)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
