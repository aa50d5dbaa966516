"""Readers and writers.

All file I/O goes through ``spark.read`` / ``DataFrame.write``: partitioned Parquet for
vector tables (``model``/``dim`` partitions give static partition pruning), CSV/TSV for
headerless inputs and exports, an append-only results table instead of a single CSV file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..operators.ordering import running_sum_before

EXTENSION_FORMATS = C.EXTENSION_FORMATS


def format_for(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    return EXTENSION_FORMATS.get(ext, "parquet")


#: Whole texts survive: quotes are doubled and white space at the ends stays.  CSV has one empty field, read as NULL.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def scan_by_extension(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                      schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """Read a file or folder choosing the format from its extension.

    With a schema, CSV and JSON are read in one pass, and a CSV header that does not name the
    schema's columns in order raises; without one, types are inferred in a pass of their own.
    ``multiline``: CSV fields may hold line breaks; a file is then read by one task, so write files
    of bounded size (JSON lines escape them and stay splittable)."""
    fmt = format_for(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS).option("multiLine", str(multiline).lower()).option("enforceSchema", "false")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return require_columns(df, columns) if columns else df


def scan_row_range(spark: SparkSession, path: str, offset: int, n: int, columns: Sequence[str] | None = None,
                   out_col: str = "row_number") -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``n`` of a Parquet table in the order of its files (by path) and of the
    rows in them, with their number.

    The files' row counts come from their footers (no column is read) and are added up as a distributed
    running sum; the driver gets one row for each file that meets the range, and only those files are
    read.  A range beyond the end has the rows there are."""
    if offset < 0 or n < 0:
        raise ValueError("offset and n must not be negative")
    df = spark.read.parquet(path)
    meta = df.metadataColumn("_metadata")
    sizes = df.select(meta["file_path"].alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    starts = running_sum_before(sizes, ["_file"], (), "_rows", "_start")
    met = starts.where((F.col("_start") < offset + n) & (F.col("_start") + F.col("_rows") > offset)).collect()
    first = F.create_map(*[x for r in met for x in (F.lit(r["_file"]), F.lit(int(r["_start"])))]) if met else F.lit(None).cast("map<string,bigint>")
    number = (first[meta["file_path"]] + meta["row_index"] + 1).alias(out_col)
    inside = df.where(meta["file_path"].isin([r["_file"] for r in met])).select(*(columns or df.columns), number)
    return inside.where((F.col(out_col) > offset) & (F.col(out_col) <= offset + n))


def sink_by_extension(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` to a folder in the format that its extension names, as ``scan_by_extension`` reads it."""
    fmt = format_for(path)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns`` in that order; a missing one raises listing the missing set."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {sorted(set(missing))}; available: {df.columns}")
    return df.select(*columns)


def scan_headerless(spark: SparkSession, path: str, names: Sequence[str] = ("text", "id"),
                    sep: str = " ") -> DataFrame:
    """Separator-delimited text without a header: all columns are strings, named in order."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("sep", sep).option("header", "false").csv(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) through Spark's own Hadoop client, for any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` ended: its success marker is there."""
    fs, p = _hadoop(spark, f"{path.rstrip('/')}/_SUCCESS")
    return bool(fs.exists(p))


def materialize_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                          codec: str = "zstd") -> DataFrame:
    """Reuse a derived table cached next to its source; build and write it when absent.

    The table is written beside ``path`` and renamed, so ``path`` only ever holds a whole write; what an
    interrupted one left there, without a success marker, is replaced."""
    if not is_complete(spark, path):
        part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex[:12]}"
        build().write.option("compression", codec).parquet(part)
        fs, target = _hadoop(spark, path)
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(_hadoop(spark, part)[1], target):
            raise OSError(f"cannot rename {part} to {path}")
    return spark.read.parquet(path)


def sink_parquet(df: DataFrame, path: str, codec: str = "gzip", mode: str = "overwrite",
                 partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def sink_tsv(df: DataFrame, id_col: str, vec_col: str, matrix_path: str, meta_path: str,
             meta_cols: Sequence[str], width: int) -> None:
    """Embedding projector export: a headerless matrix TSV (one component per column) and a
    metadata TSV with a header.  ``width`` is the vector width (fixed by the model)."""
    comps = [F.col(vec_col)[i].cast("double").alias(f"c{i}") for i in range(width)]
    df.select(id_col, *comps).orderBy(id_col).drop(id_col).write.mode("overwrite").option("sep", "\t") \
        .option("header", "false").csv(matrix_path)
    df.select(id_col, *meta_cols).orderBy(id_col).drop(id_col).write.mode("overwrite").option("sep", "\t") \
        .option("header", "true").csv(meta_path)


RESULTS_SCHEMA = "run string, epoch int, steps long, metric string, value double"


def sink_results_append(df: DataFrame, path: str) -> None:
    """Append metric rows ``(run, epoch, steps, metric, value)`` to a results table."""
    cols = [c.split()[0] for c in RESULTS_SCHEMA.split(", ")]
    require_columns(df, cols).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS_SCHEMA).parquet(path)


def last_metric(results: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Last recorded value per metric, ordered by (epoch, steps)."""
    return results.groupBy(*by).agg(F.max_by("value", F.struct("epoch", "steps")).alias("value"))


def vector_table_write(df: DataFrame, path: str, model: str, dim: int, vec_col: str = "embedding",
                       mode: str = "append") -> None:
    """Append vectors of one (model, dimension) to the partitioned vector table."""
    out = df.withColumn("model", F.lit(model)).withColumn("dim", F.lit(int(dim)))
    out.write.mode(mode).partitionBy("model", "dim").parquet(path)


def vector_table_read_dim(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Rows of one (model, dimension): a partition filter, so only that folder is listed and read."""
    return spark.read.parquet(path).where((F.col("model") == model) & (F.col("dim") == int(dim)))
