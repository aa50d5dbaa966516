"""Calibrated scalar quantisation of vector columns.

The per-component minimum and step come from one grouped aggregation over
``(component position)``: partial aggregation on every partition, then one row per
component.  The calibration is a single array of d structs (d = vector width, a bound
that does not grow with the table); it reaches the rows as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def int8_ranges(df: DataFrame, vec_col: str) -> DataFrame:
    """One row: ``ranges`` = array of (pos, lo, step) sorted by position, step = (max − min)/255."""
    ex = df.select(F.posexplode(vec_col).alias("pos", "x"))
    per = ex.groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("lo"),
                                ((F.max(F.col("x").cast("double")) - F.min(F.col("x").cast("double"))) / 255.0).alias("step"))
    return per.agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "step"))).alias("ranges"))


def quantize_arrays(df: DataFrame, vec_cols: list[str], ranges: Column, signed: bool = True) -> DataFrame:
    """The columns ``vec_cols`` quantised in place; ``ranges`` is the array of ``int8_ranges`` as a scalar.
    Values outside the calibration take the nearest end."""
    shift, top = (128.0, 127.0) if signed else (0.0, 255.0)

    def q(x, i):
        cal = F.get(F.col("_cal"), i)
        v = F.try_divide(x.cast("double") - cal["lo"], cal["step"]) - F.lit(shift)
        return F.least(F.greatest(v, F.lit(-shift)), F.lit(top)).cast("int").cast("smallint")

    # The scalar subquery is evaluated once per query; higher-order functions cannot hold a
    # subquery, so it is attached as a column first.
    out = df.withColumn("_cal", ranges)
    for c in vec_cols:
        out = out.withColumn(c, F.transform(F.col(c), q))
    return out.drop("_cal")


def quantize_int8(df: DataFrame, vec_col: str, signed: bool = True, ranges: DataFrame | None = None) -> DataFrame:
    """int8: trunc((x − lo)/step − 128); uint8: trunc((x − lo)/step).  ``ranges`` may come from
    another table (calibrate on a corpus, apply to queries)."""
    r = (ranges if ranges is not None else int8_ranges(df, vec_col)).select("ranges").scalar()
    return quantize_arrays(df, [vec_col], r, signed)
