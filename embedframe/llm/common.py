"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Rows in one Arrow batch.  Whole texts travel in a batch, and one may be very long.
BATCH_ROWS = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder and read again: lineage ends
    there, and a lost executor re-reads the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_1``, ``name_2``... that no column of ``df`` has."""
    taken, out, k = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL ids: the remainder of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def with_columns(df: DataFrame, added: list[tuple[str, T.DataType]], text_col: str,
                 compute: Callable[[list[str | None]], list[pa.Array]], carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``df`` (all when None) plus ``added`` columns that ``compute``
    makes from the texts of a batch.  Rows pass through as Arrow columns; nothing is shuffled."""
    small_batches(df.sparkSession)
    keep = df.columns if carry is None else carry
    passed = text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType)  # then it travels once
    tmp = fresh(df, "_text")
    src = df.select(*[F.col(f"`{c}`") for c in keep], *([] if passed else [F.col(f"`{text_col}`").cast("string").alias(tmp)]))
    schema = T.StructType([*src.drop(tmp).schema.fields, *[T.StructField(n, t) for n, t in added]])
    names = [n for n, _ in added]
    at, n_keep = keep.index(text_col) if passed else len(keep), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(i) for i in range(n_keep)] + compute(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return src.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, in_training: Column, max_rows: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text) of at most ``max_rows`` labelled rows that ``in_training`` (an expression on
    the id) admits: those of the smallest id hashes, so the same rows for the same table.  At most
    ``max_rows`` ids are broadcast; the documents are read where they lie.  An id that stands in several
    rows gives one of them, the least text, so the bound holds whatever the documents."""
    picked = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
              .where(F.col("_id").isNotNull() & F.col("_label").isNotNull()).groupBy("_id").agg(F.max("_label").alias("_label"))
              .withColumnRenamed("_id", id_col).where(in_training).withColumnRenamed(id_col, "_id")
              .orderBy(F.xxhash64("_id"), "_id").limit(int(max_rows)))
    return (docs.select(F.col(id_col).alias("_did"), F.col(text_col).cast("string").alias("_t"))
            .join(F.broadcast(picked), F.col("_did") == F.col("_id"))
            .groupBy("_did").agg(F.max("_label").alias("_label"), F.min("_t").alias("_t"))
            .select(F.col("_did").alias("id"), F.col("_label").alias("label"), F.coalesce("_t", F.lit("")).alias("text")))


def broadcast_value(spark: SparkSession, value: Any):
    return spark.sparkContext.broadcast(value)


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: T.StructType | str,
             compute: Callable[[pa.RecordBatch], list[pa.Array] | None]) -> DataFrame:
    """``compute`` on the rows of each group of ``keys``, sorted by ``order``; groups follow one another
    in a task's Arrow stream, so very many small ones cost little.  A group is held in memory: keep
    groups bounded."""
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    ranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held and any(b.column(k)[0] != held[-1].column(k)[held[-1].num_rows - 1] for k in keys):
                yield _joined(held)
                held = []
            change = np.zeros(b.num_rows - 1, bool)
            for k in keys:
                c = b.column(k)
                change |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            for i, (at, past) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = b.slice(at, past - at)
                if i == len(cuts) - 2:  # may go on in the next batch
                    held.append(part)
                elif held:
                    yield _joined([*held, part])
                    held = []
                else:
                    yield part
        if held:
            yield _joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            arrays = compute(g)
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, names)

    return ranged.mapInArrow(run, schema)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def rows_of(col: pa.Array, dtype) -> np.ndarray:
    """A list column whose rows have one length, as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), -1)
