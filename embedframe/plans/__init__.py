"""Registered queries: every key of SURVEY §2 that is built, as ``(spark, sf_dir) -> DataFrame``,
with the DuckDB SQL that computes the same table (absent for keys SQL cannot express)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import approximate, candidates, chains, evaluation, learning, preparation, retrieval, streams, vectors

_MODULES = [retrieval, evaluation, vectors, preparation, candidates, learning, approximate, streams, chains]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        for key, fn in m.QUERIES.items():
            if key in out:
                raise ValueError(f"duplicate query key {key}")
            out[key] = fn
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
