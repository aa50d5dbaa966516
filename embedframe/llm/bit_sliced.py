"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to whole numbers.  A block of rows, in id order, is stored as bitmaps: for
each dimension and each binary digit of (value - the block's smallest value) one bit per row.  A
query adds the slices with the weights of its own digits by bitmap arithmetic (carry-save
adders; a negative factor takes the complemented slices), which leaves every row's score as
bitmaps, one for each binary digit.  The best rows are then taken from the most significant
digit downward (O'Neil and Quass 1997): rows certainly in, rows still tied.  The last ties go to
the smallest ids, which are the first bits.

Blocks of the index meet blocks of queries, each pair in one task, and a window keeps the best of
the blocks' best.  Nothing is approximate, and no pair of rows becomes a row of a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass
class Slices:
    """A block of the index: ``bits[at[d]:at[d + 1]]`` are dimension d's bitmaps from the lowest digit."""

    ids: np.ndarray
    low: np.ndarray
    at: np.ndarray
    bits: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, values: np.ndarray) -> Slices:
        """From ids in order and whole numbers (rows, dimensions)."""
        n, dims = values.shape
        low = values.min(axis=0)
        u = (values - low).astype(np.uint64)
        widths = [int(x).bit_length() for x in u.max(axis=0)]
        at = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        words = -(-n // 64)
        bits = np.zeros((int(at[-1]), words * 8), np.uint8)
        for d in range(dims):
            for b in range(widths[d]):
                row = np.packbits((u[:, d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
                bits[at[d] + b, :len(row)] = row
        return cls(ids, low, at, bits.view("<u8"))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the digits of (score - constant), and the constant."""
        waiting: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query.tolist()):
            if not q:
                continue
            own = self.bits[self.at[d]:self.at[d + 1]]
            low = int(self.low[d])
            if q < 0:
                own = own ^ ONES
                constant += q * (low + (1 << len(own)) - 1)
            else:
                constant += q * low
            factor = abs(q)
            for shift in range(factor.bit_length()):
                if factor >> shift & 1:
                    while len(waiting) < shift + len(own):
                        waiting.append([])
                    for b in range(len(own)):
                        waiting[shift + b].append(own[b])
        out = []
        w = 0
        while w < len(waiting):
            level = waiting[w]
            if w + 1 == len(waiting) and len(level) > 1:
                waiting.append([])
            while len(level) > 1:
                a, b = level.pop(), level.pop()
                if level:  # full adder
                    c = level.pop()
                    x = a ^ b
                    level.append(x ^ c)
                    x &= c
                    x |= a & b
                    waiting[w + 1].append(x)
                else:
                    level.append(a ^ b)
                    waiting[w + 1].append(a & b)
            out.append(level[0] if level else np.zeros(self.bits.shape[1], np.uint64))
            w += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, but: int | None = None) -> list[tuple[int, int]]:
        """The k best (id, score) of the rows whose id isn't ``but``; equal scores by smaller id."""
        digits, constant = self.scores(query)
        n = len(self.ids)
        words = self.bits.shape[1]
        tied = np.full(words, ONES)
        if n % 64:
            tied[-1] = np.uint64((1 << n % 64) - 1)
        if but is not None:
            for i in range(*np.searchsorted(self.ids, [but, but + 1]).tolist()):
                tied[i // 64] &= ~np.uint64(1 << i % 64)
        sure = np.zeros(words, np.uint64)
        need = k
        for digit in reversed(digits):  # most significant first
            high = tied & digit
            count = int(np.bitwise_count(high).sum())
            if count > need:
                tied = high
            else:
                sure |= high
                need -= count
                tied = tied & ~digit
                if not need:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if need:
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[:need]])
        score = np.full(len(rows), constant, np.int64)
        for w, digit in enumerate(digits):
            score += ((digit[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
        order = np.lexsort((self.ids[rows], -score))
        return [(int(self.ids[rows[i]]), int(score[i])) for i in order]


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, dims, q) of the rows whose vectors are whole: floor(scale * x), as doubles."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).where(whole & (F.size(vec_col) > 0))
            .select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dims"),
                    F.transform(x, lambda v: F.floor(v * F.lit(scale))).alias("q")))


def build_index(rows: DataFrame, block_rows: int) -> DataFrame:
    """(dims, block, ids, low, at, bits) of ``quantised`` rows; written."""
    sizes = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    placed = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        s = Slices.build(pdf["id"].to_numpy(np.int64), np.stack(pdf["q"].to_numpy()).astype(np.int64))
        return pd.DataFrame({"dims": [int(pdf["dims"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "ids": [s.ids.astype("<i8").tobytes()],
                             "low": [s.low.astype("<i8").tobytes()], "at": [s.at.astype("<i8").tobytes()], "bits": [s.bits.tobytes()]})

    return common.written(placed.select("dims", "block", "id", "q").groupBy("dims", "block").applyInPandas(
        pack, "dims int, block int, ids binary, low binary, at binary, bits binary"), "bit-sliced-index")


def search(rows: DataFrame, index: DataFrame, is_query: Column, k: int, query_rows: int = 16384, least_rows: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best index rows of every row that ``is_query`` admits,
    its own id left out.

    An index block travels once for each query block.  Those have up to ``query_rows`` queries, or fewer where there would
    be less of them than cores, but then ``least_rows`` at least."""
    queries = rows.where(is_query)
    count, cores = F.count(F.lit(1)), F.lit(rows.sparkSession.sparkContext.defaultParallelism)
    n = queries.groupBy("dims").agg(F.greatest(F.ceil(count / query_rows), F.least(cores, F.ceil(count / least_rows))).alias("qblocks"))
    queries = queries.join(n, "dims").withColumn("qblock", F.pmod(F.xxhash64("id", F.lit(1)), F.col("qblocks")).cast("int"))
    blocks = index.select(F.col("dims").alias("dims"), F.col("block").alias("block"))
    asked = queries.join(blocks, "dims").select(*[F.col(c).alias(c) for c in ("dims", "block", "qblock", "id", "q")])
    met = index.join(n, "dims").withColumn("qblock", F.explode(F.sequence(F.lit(0), (F.col("qblocks") - 1).cast("int")))).drop("qblocks")
    key = ["dims", "block", "qblock"]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            s = Slices(np.frombuffer(a["ids"].iloc[0], "<i8"), np.frombuffer(a["low"].iloc[0], "<i8"), np.frombuffer(a["at"].iloc[0], "<i8"),
                       np.zeros((0, 0), np.uint64))
            bits = np.frombuffer(a["bits"].iloc[0], "<u8")
            s.bits = bits.reshape(int(s.at[-1]), -1) if s.at[-1] else np.zeros((0, -(-len(s.ids) // 64)), np.uint64)
            for i, q in zip(b["id"].tolist(), b["q"].to_list(), strict=True):
                out += [(i, v, x) for v, x in s.top(np.asarray(q, np.int64), k, i)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = met.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = 1 << 16) -> DataFrame:
    """The k best rows of each query by integer inner product, exactly (see the module docstring).

    ``is_query`` is an expression on ``id``.  Vectors that are NULL, empty, or hold NULL or non-finite
    components take no part, nor do rows with a NULL id; vectors of another length never meet; ties
    go to smaller ids; a repeated row counts as often as it occurs, but no row with the query's id
    answers it; other columns are ignored; an empty table gives an empty result."""
    rows = common.written(quantised(vectors, id_col, vec_col, scale), "quantised")
    return search(rows, build_index(rows, block_rows), is_query, k)
