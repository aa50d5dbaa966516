"""Packing token pieces into sequences of fixed capacity by minimum bin slack.

Only the number of pieces of each length decides a packing, and there are at most ``capacity``
lengths, so the bins are planned on those counts: a table of at most ``capacity`` numbers,
however large the input.  ``minimum_bin_slack`` seeds a bin with the longest piece left and
finds by a bitset subset-sum the fullest feasible combination of the other lengths; that bin
is removed as often as the counts allow (the same combination stays the fullest one while its
pieces last), so there are few distinct bins.  Spark then numbers the pieces of each length
without gaps and joins the numbers to the plan: no task or driver sees the pieces as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bpe import load_added_tokens, load_byte_level_json

PLAN_SCHEMA = "length int, first long, past long, sequence_base long, times int, offset_base int"


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(bin as [(length, times)], number of such bins)] that together use up ``counts``.

    Lengths must lie in 1..capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    order = sorted(left, reverse=True)
    bins = []
    while order:
        seed = order[0]
        room = capacity - seed
        full, mask = 1 << room, (2 << room) - 1
        reach, taken = 1, []
        for n in order:
            if n > room:
                continue
            most = min(left[n] - (n == seed), room // n)
            chunk = 1
            while most > 0 and not reach & full:  # 1, 2, 4, ... copies of this length at once
                chunk = min(chunk, most)
                taken.append((n, chunk, reach))
                reach |= (reach << n * chunk) & mask
                most -= chunk
                chunk *= 2
            if reach & full:
                break
        filled = reach.bit_length() - 1
        used = {seed: 1}
        for n, chunk, before in reversed(taken):
            if not before >> filled & 1:
                used[n] = used.get(n, 0) + chunk
                filled -= n * chunk
        times = min(left[n] // k for n, k in used.items())
        bins.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return bins


def plan_rows(bins: list[tuple[list[tuple[int, int]], int]]) -> list[tuple]:
    """Rows of PLAN_SCHEMA: pieces number first..past-1 of a length lie ``times`` to a sequence."""
    rows, taken, sequence = [], {}, 0
    for used, times in bins:
        offset = 0
        for n, k in used:
            first = taken.get(n, 0)
            taken[n] = first + k * times
            rows.append((n, first, taken[n], sequence, k, offset))
            offset += n * k
        sequence += times
    return rows


def number_within(df: DataFrame, group_col: str, order_cols: list[str], out_col: str) -> DataFrame:
    """``df`` with ``out_col``: 0, 1, 2... within each value of ``group_col``, without gaps.

    Rows are numbered within (group, bucket of a hash of the order columns), and the counts of a
    group's earlier buckets are added, so a group of any size is dealt over many tasks.  The
    buckets number as many as the shuffle partitions."""
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = df.columns
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(*order_cols), F.lit(n)).cast("int"))
    counts = b.groupBy(group_col, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group_col).alias("_g"), F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group_col, "_bucket").orderBy(*order_cols))
    return (b.withColumn("_within", within).join(starts, (F.col(group_col) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
            .select(*cols, (F.col("_start") + F.col("_within") - 1).cast("long").alias(out_col)))


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: the pieces of a sequence lie one after
    another from 0 and fill at most ``capacity``.  ``pieces`` should be a written table, for it is
    read twice.  Rows with equal keys are packed like any others; an empty table stays empty."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).agg(F.count(F.lit(1))).collect()}  # at most capacity rows
    plan = spark.createDataFrame(plan_rows(minimum_bin_slack(counts, capacity)), PLAN_SCHEMA)
    cols = pieces.columns
    number = common.fresh(pieces, "_number")
    numbered = number_within(pieces, length_col, list(key_cols), number)
    plan = plan.select(*[F.col(c).alias(f"_plan_{c}") for c in plan.columns])
    at = F.col(number) - F.col("_plan_first")
    times = F.col("_plan_times").cast("long")
    # The plan has a row for each length of each distinct bin: bounded by capacity, not by the data.
    joined = numbered.join(F.broadcast(plan), (F.col(length_col) == F.col("_plan_length"))
                           & (F.col(number) >= F.col("_plan_first")) & (F.col(number) < F.col("_plan_past")))
    return joined.select(*cols, (F.col("_plan_sequence_base") + F.floor(at / times)).cast("long").alias("sequence_id"),
                         (F.col("_plan_offset_base") + (at % times) * F.col(length_col)).cast("long").alias("offset"))


_ENCODINGS: dict = {}


def encoding(path: str, pattern: str):
    """The encoder of a byte-level vocabulary file, built once in each Python worker.  Ids follow
    merge order there, so ranks give the same ids as the file's merges (a test compares them).  Texts
    are split at the file's added tokens, which keep their own ids."""
    key = (path, pattern)
    if key not in _ENCODINGS:
        import tiktoken
        _ENCODINGS[key] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=load_byte_level_json(path),
                                            special_tokens=load_added_tokens(path))
    return _ENCODINGS[key]


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every whole document: its ids and then
    ``end_id``.  Only documents of more than ``capacity`` ids are cut; their first piece is the
    remainder and the others are full.  NULL texts count as empty: the end id alone."""
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    fields = [src.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern)
        for b in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                tokens = np.append(encode.encode_to_numpy(text or "", allowed_special="all"), end_id).astype("<u4")
                n = len(tokens)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k in range(len(cuts) - 1):
                    part = tokens[cuts[k]:cuts[k + 1]]
                    row.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []),
                                             [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and place (see ``token_pieces`` and ``pack``).

    NULL ids are kept; NULL and empty texts pack as the end id alone; repeated rows are packed
    each; other columns are ignored, whatever their names; an empty table gives an empty one."""
    pieces = common.written(token_pieces(docs, path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity, "length", (id_col, "piece"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``pack_documents(..., with_ids=True)``; a sequence is of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
