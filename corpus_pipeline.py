"""The corpus pipeline: a list of stages over ``documents``, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  The filters return the columns of
``docs`` unchanged; the last stage returns the packed pieces.  Texts pass through the filters'
tasks as Arrow columns and are shuffled once, where near duplicates are removed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedframe.llm import ngram_join, packing, quality, toxicity
from embedframe.llm.common import fold, fresh, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic probability is below 0.5.  The grammar learns from the labelled rows of
    ``docs`` outside one fold; NULL and empty texts stay."""
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    score = fresh(docs, "toxic_score")
    return toxicity.score(docs, grammar, "text", score_col=score).where(F.col(score) < 0.5).drop(score)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.7 or more, learned like the stage before."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    score = fresh(docs, "quality_score")
    return quality.score(docs, model, "text", score_col=score).where(F.col(score) >= 0.7).drop(score)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the
    smallest id.  Equal rows are one document; rows without an id can't be told apart and stay."""
    found = ngram_join.components(docs)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN,
                                  capacity=1024, end_id=2)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("ngram_jaccard", jaccard_stage), ("packing", pack_stage)]

#: No SQL states tokenisation or trained scores; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
