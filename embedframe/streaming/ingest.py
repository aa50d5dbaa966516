"""Incremental ingest and resume.

The reference resumes by hand (offset files, "last batch" lookups).  Here a file-source
stream with ``trigger(availableNow=True)`` does it: the checkpoint records which input files
are done, a rerun processes only new files, and ``foreachBatch`` writes each micro-batch into
its own ``batch_id=N`` folder with overwrite, so a replayed batch replaces its own output
instead of appending twice.  Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..operators import prep as P


def _run_available(stream_df: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> None:
    q = (stream_df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def write_vector_batch(batch: DataFrame, batch_id: int, sink_dir: str, dims: Sequence[int], model: str,
                       id_col: str = "vec_id", vec_col: str = "embedding", base_dim: int | None = None) -> None:
    """One micro-batch → one vector row per (row, dimension), truncated and renormalised when
    d < base dimension, written with overwrite into ``batch_id=<id>``: a replayed batch
    replaces its own output."""
    rows = batch.select(id_col, vec_col).withColumn("dim", F.explode(F.array(*[F.lit(int(d)) for d in dims])))
    vec = V.truncate_renorm(vec_col, F.col("dim")) if base_dim is None else \
        F.when(F.col("dim") < base_dim, V.normalize(V.truncate(vec_col, F.col("dim")))).otherwise(V.as_double(vec_col))
    out = rows.withColumn(vec_col, vec).withColumn("model", F.lit(model))
    out.write.mode("overwrite").partitionBy("model", "dim").parquet(f"{sink_dir}/batch_id={batch_id}")


def ingest_vectors(spark: SparkSession, source_dir: str, schema: T.StructType | str, sink_dir: str, checkpoint: str,
                   dims: Sequence[int], model: str, id_col: str = "vec_id", vec_col: str = "embedding",
                   base_dim: int | None = None) -> None:
    """Process the files of ``source_dir`` not seen yet (see ``write_vector_batch``)."""
    src = spark.readStream.schema(schema).parquet(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_vector_batch(batch, batch_id, sink_dir, dims, model, id_col, vec_col, base_dim)

    _run_available(src, checkpoint, write)


def resume_point(sink: DataFrame, batch_col: str = "batch_start", size: int = 64):
    """Next batch start = max(batch_start) + size over the rows already written (0 when empty)."""
    return sink.agg(F.coalesce(F.max(batch_col) + F.lit(size), F.lit(0))).scalar()


def remaining_rows(indexed: DataFrame, sink: DataFrame, batch_col: str = "batch_start") -> DataFrame:
    """Rows of the batches that the sink does not hold, holes left by parallel writers included."""
    return indexed.join(sink.select(batch_col).distinct(), batch_col, "left_anti").select(*indexed.columns)


def library_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, library_dir: str,
                   checkpoint: str, key_col: str, score_col: str, top_n: int) -> None:
    """``library_update`` fed by micro-batches.  Versions are written to ``v=<batch_id>``
    folders (overwrite); batch N starts from the highest version up to N, so a replayed batch gives
    the same version again."""
    src = spark.readStream.schema(schema).parquet(source_dir)

    def update(batch: DataFrame, batch_id: int) -> None:
        lib = current_library(spark, library_dir, batch_id)
        new = P.library_update(lib.select(key_col, score_col), batch.select(key_col, score_col), key_col, score_col, top_n)
        new.write.mode("overwrite").parquet(f"{library_dir}/v={batch_id + 1}")

    _run_available(src, checkpoint, update)


def current_library(spark: SparkSession, library_dir: str, upto: int | None = None) -> DataFrame:
    """The highest version (not above ``upto``)."""
    lib = spark.read.parquet(library_dir)
    lib = lib if upto is None else lib.where(F.col("v") <= upto)
    last = lib.agg(F.max("v")).scalar()
    return lib.where(F.col("v") == last).drop("v")
