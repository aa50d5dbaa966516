"""Global order positions without a single-partition window.

``row_number() OVER (ORDER BY x)`` with no ``PARTITION BY`` moves the whole table into one
task.  ``running_sum_before`` computes the same positions in three distributed steps:

1. range-partition the rows on ``(group, order)`` (one shuffle) and checkpoint them with
   their partition id; a hot group is split over several partitions like any other range;
2. each partition computes its local running sums with a window keyed by the partition id
   (the rows of one range partition move together; JVM code, no Python);
3. per (partition, group) totals give each partition the sum that earlier partitions hold
   for the group it starts with.  Only the first group of a partition can continue from an
   earlier partition, so this offset table has at most one row per partition: it is
   broadcast, and its size is bounded by the partition count, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, reliable_checkpoint


def running_sum_before(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
                       weight_col: str | None = None, out_col: str = "_before",
                       partitions: int | None = None) -> DataFrame:
    """Adds ``out_col`` = sum of ``weight_col`` (1 per row when None) over the rows that come
    strictly before this one in ``(group_cols, order_cols)`` order, within the group.

    Rows with equal keys are ordered arbitrarily among themselves, so make the order unique
    when positions must be repeatable (add the id as the last order column).
    """
    spark = df.sparkSession
    group_cols = list(group_cols)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df if weight_col else df.withColumn("_w", F.lit(1.0))
    wcol = weight_col or "_w"
    key_exprs = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    # The range partition id is written out with the rows (reliable checkpoint in the shared
    # checkpoint folder): both uses below read the same cut of the key space, however the
    # optimiser prunes them, and a lost executor re-reads instead of re-sampling the bounds.
    checkpoint_dir(df.sparkSession)
    ranged = reliable_checkpoint(base.repartitionByRange(n_parts, *key_exprs).withColumn("_pid", F.spark_partition_id()))
    # running sum inside each range partition: a window keyed by the partition id (JVM, codegen)
    w_local = (Window.partitionBy("_pid", *group_cols).orderBy(*key_exprs[len(group_cols):])
               .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_local", F.coalesce(F.sum(F.col(wcol).cast("double")).over(w_local), F.lit(0.0)))
    totals = ranged.groupBy("_pid", *group_cols).agg(F.sum(F.col(wcol).cast("double")).alias("_tot"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_off", F.sum("_tot").over(w))
               .where(F.col("_off").isNotNull() & (F.col("_off") != 0))
               .select("_pid", *group_cols, "_off"))
    # At most one row per partition (see module docstring): a proven broadcast bound.
    offsets = offsets.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(["_pid", *group_cols])], "_off")
    cond = None
    for i, c in enumerate(["_pid", *group_cols]):
        term = local[c].eqNullSafe(offsets[f"_o{i}"])
        cond = term if cond is None else cond & term
    joined = local.join(F.broadcast(offsets), cond, "left").drop(*[f"_o{i}" for i in range(len(group_cols) + 1)])
    out = joined.withColumn(out_col, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0.0)))
    drop = ["_pid", "_local", "_off"] + ([] if weight_col else ["_w"])
    return out.drop(*drop)


def running_logsumexp_before(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str], value_col: str,
                             out_col: str = "_before", partitions: int | None = None) -> DataFrame:
    """Adds ``out_col`` = log Σ exp(``value_col``) over the rows strictly before this one in
    ``(group_cols, order_cols)`` order, within the group; −∞ for the first.

    The same three steps as ``running_sum_before``, in the log domain, so values of any size neither
    overflow nor vanish.  The order must be unique within a group."""
    spark = df.sparkSession
    group_cols = list(group_cols)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.DoubleType()), T.StructField("_upto", T.DoubleType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, so_far = None, -np.inf
        for pdf in batches:
            before = np.empty(len(pdf))
            upto = np.empty(len(pdf))
            group = pdf[group_cols].apply(tuple, axis=1).tolist() if group_cols else [()] * len(pdf)
            cuts = [i for i in range(len(group)) if not i or group[i] != group[i - 1]] + [len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if group[a] != at:
                    at, so_far = group[a], -np.inf
                run = np.logaddexp.accumulate(np.concatenate([[so_far], pdf[value_col].to_numpy(np.float64)[a:b]]))
                before[a:b], upto[a:b], so_far = run[:-1], run[1:], run[-1]
            yield pdf.assign(_local=before, _upto=upto)

    local = reliable_checkpoint(ranged.mapInPandas(scan, schema))
    totals = local.groupBy("_pid", *group_cols).agg(F.max("_upto").alias("_tot"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumn("_all", F.collect_list("_tot").over(w)).where(F.size("_all") > 0)  # at most a value per partition
    top = F.array_max("_all")
    off = top + F.log(F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    offsets = earlier.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(["_pid", *group_cols])], off.alias("_off"))
    cond = None
    for i, c in enumerate(["_pid", *group_cols]):
        term = local[c].eqNullSafe(offsets[f"_o{i}"])
        cond = term if cond is None else cond & term
    # only the first group of a partition can continue an earlier one: a row per partition at most
    joined = local.join(F.broadcast(offsets), cond, "left")
    hi, lo = F.greatest("_local", "_off"), F.least("_local", "_off")
    both = F.when(F.col("_off").isNull(), F.col("_local")).when(lo == float("-inf"), hi).otherwise(hi + F.log1p(F.exp(lo - hi)))
    return joined.withColumn(out_col, both).select(*df.columns, out_col)


def global_row_number(df: DataFrame, order_cols: Sequence[str | Column], group_cols: Sequence[str] = (),
                      out_col: str = "row_number", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``(group, order)`` order, distributed (see module doc)."""
    out = running_sum_before(df, order_cols, group_cols, None, "_rn0", partitions)
    return out.withColumn(out_col, (F.col("_rn0") + 1).cast("long")).drop("_rn0")


#: A value that more than one row in this many holds is frequent; there are fewer of them than this.
FREQUENT = 512


def average_ranks(df: DataFrame, value_col: str, group_cols: Sequence[str] = (), out_col: str = "rank",
                  partitions: int | None = None) -> DataFrame:
    """Fractional ("average") ranks of ``value_col`` within each group; NULL values get NULL.

    The running sum runs over the table of distinct (group, value) counts, which is then
    joined back; ties share the mean of the positions they occupy.  Frequent values (fewer than
    ``FREQUENT`` by their definition, so they can be broadcast) get their rank without a shuffle by value;
    their rows are spread over all tasks of the join that serves the others, which then has no hot key."""
    group_cols = list(group_cols)
    keys = [*group_cols, value_col]
    counts = (df.where(F.col(value_col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("_cnt")))
    ranked = running_sum_before(counts, [value_col], group_cols, "_cnt", "_lt", partitions)
    ranked = ranked.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_cnt",
                           (F.col("_lt") + (F.col("_cnt") + 1) / 2).alias("_rank"))
    often = F.col("_cnt") * FREQUENT > ranked.agg(F.sum("_cnt")).scalar()
    same = None
    for i, c in enumerate(keys):
        term = F.col(c).eqNullSafe(F.col(f"_k{i}")) if c in group_cols else F.col(c) == F.col(f"_k{i}")
        same = term if same is None else same & term
    gone = [f"_k{i}" for i in range(len(keys))]
    near = df.join(F.broadcast(ranked.where(often).select(*gone, F.col("_rank").alias("_often"))), same, "left").drop(*gone)
    # rows that have their rank, or have no value, meet nothing: any place will do
    spread = F.when(F.col("_often").isNotNull() | F.col(value_col).isNull(), F.xxhash64(*df.columns))
    near = near.withColumn("_place", F.coalesce(spread, F.lit(0)))
    rest = ranked.where(~often).select(*gone, F.col("_rank").alias("_seldom"), F.lit(0).cast("long").alias("_at"))
    joined = near.join(rest, same & (F.col("_place") == F.col("_at")), "left")
    return joined.select(*df.columns, F.coalesce("_often", "_seldom").alias(out_col))
