"""Incremental ingest: a rerun reads only new files; replays do not duplicate output."""

import numpy as np
from pyspark.sql import functions as F

from embedframe.session import scratch_path
from embedframe.streaming import ingest as S


def test_second_run_only_new_files(spark):
    base = scratch_path(spark, "test-ingest")
    rows = [(i, np.linspace(1, 2, 8).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.where("vec_id < 20").write.parquet(f"{base}/src", mode="append")
    S.ingest_vectors(spark, f"{base}/src", df.schema, f"{base}/sink", f"{base}/ckpt", [8, 4], "m", base_dim=8)
    S.ingest_vectors(spark, f"{base}/src", df.schema, f"{base}/sink", f"{base}/ckpt", [8, 4], "m", base_dim=8)
    first = spark.read.parquet(f"{base}/sink")
    assert first.count() == 40 and first.select("batch_id").distinct().count() == 1
    df.where("vec_id >= 20").write.parquet(f"{base}/src", mode="append")
    S.ingest_vectors(spark, f"{base}/src", df.schema, f"{base}/sink", f"{base}/ckpt", [8, 4], "m", base_dim=8)
    out = spark.read.parquet(f"{base}/sink")
    assert out.count() == 60
    assert out.where("batch_id = 1").select("vec_id").distinct().count() == 10
    norms = out.where("dim = 4").select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_resume_point(spark):
    sink = spark.createDataFrame([(0,), (64,), (128,)], "batch_start long")
    assert spark.range(1).select(S.resume_point(sink, size=64).alias("r")).first().r == 192
    empty = spark.createDataFrame([], "batch_start long")
    assert spark.range(1).select(S.resume_point(empty, size=64).alias("r")).first().r == 0


def test_library_stream_matches_batch_for_one_batch(spark):
    from embedframe.operators.prep import library_update

    base = scratch_path(spark, "test-lib")
    lib = spark.createDataFrame([("a", 5.0), ("b", 3.0)], "key string, score double")
    lib.write.parquet(f"{base}/lib/v=0")
    cands = spark.createDataFrame([("c", 4.0), ("d", 1.0), ("e", 9.0)], "key string, score double")
    cands.write.parquet(f"{base}/src")
    S.library_stream(spark, f"{base}/src", "key string, score double", f"{base}/lib", f"{base}/ckpt", "key", "score", 3)
    streamed = [tuple(r) for r in S.current_library(spark, f"{base}/lib").orderBy("key").collect()]
    batch = [tuple(r) for r in library_update(lib, cands, "key", "score", 3).orderBy("key").collect()]
    assert streamed == batch == [("a", 5.0), ("c", 4.0), ("e", 9.0)]


def test_replayed_batch_is_not_duplicated(spark):
    base = scratch_path(spark, "test-replay")
    df = spark.createDataFrame([(i, [1.0, 2.0, 2.0]) for i in range(7)], "vec_id long, embedding array<double>")
    for _ in range(2):  # the same micro-batch delivered twice
        S.write_vector_batch(df, 3, f"{base}/sink", [3, 2], "m", base_dim=3)
    out = spark.read.parquet(f"{base}/sink")
    assert out.count() == 14 and out.select("batch_id").distinct().first()[0] == 3


def test_holes_below_the_highest_batch_remain(spark):
    indexed = spark.createDataFrame([(i, i // 4 * 4) for i in range(20)], "id int, batch_start int")
    sink = indexed.where("batch_start in (0, 4, 12)")  # batch 8 was never written, 16 neither
    assert sorted(r.id for r in S.remaining_rows(indexed, sink).collect()) == [8, 9, 10, 11, 16, 17, 18, 19]


def test_replayed_library_batch_reads_its_own_start(spark):
    base = scratch_path(spark, "test-lib-replay")
    spark.createDataFrame([("a", 5.0)], "key string, score double").write.parquet(f"{base}/lib/v=0")
    for v, key in ((1, "b"), (2, "c")):
        spark.createDataFrame([(key, float(v + 5))], "key string, score double").write.parquet(f"{base}/lib/v={v}")
    assert [r.key for r in S.current_library(spark, f"{base}/lib", upto=1).collect()] == ["b"]
    assert [r.key for r in S.current_library(spark, f"{base}/lib").collect()] == ["c"]


def test_interrupted_write_is_not_taken_for_a_table(spark, tmp_path):
    from embedframe.sources import io

    path = f"file://{tmp_path}/table"
    spark.range(3).write.parquet(path)
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert not io.is_complete(spark, path)
    assert io.materialize_if_absent(spark, path, lambda: spark.range(10)).count() == 10
    assert io.materialize_if_absent(spark, path, lambda: spark.range(99)).count() == 10
