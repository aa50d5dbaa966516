"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition when ``df`` has fewer partitions than the session's default
    parallelism.

    Used before CPU-heavy per-row work (tokenising, n-grams, Python encoders): a small input
    stored as one Parquet row group is otherwise read and processed by a single task.  On a
    cluster reading many files the input already has more partitions than cores and nothing
    changes.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
