"""Pluggable per-row pieces: encoders, scorers, candidate generators.

* ``embed_batches``: an iterator pandas UDF — the encoder factory runs once per task (one
  model load per worker), rows arrive as Arrow batches and are encoded ``batch_size`` at a
  time.  The built-in ``hashed_token_encoder`` is deterministic so the job is testable.
* ``score_function``: scorer names → Column builders (JVM expressions, no Python per row).
* ``generate_candidates``: a generator factory applied with ``mapInPandas`` per lane; a
  reference whose generation fails yields no candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V

Encoder = Callable[[list[str]], np.ndarray]

MAX_CACHED_TOKENS = 200_000  # in a worker; the rest is hashed again
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def hashed_token_encoder(dim: int = 64) -> Encoder:
    """Text → token counts hashed into ``dim`` buckets (md5 of the lower-cased token)."""
    import regex

    pattern = regex.compile(TOKEN_PATTERN)
    cache: dict[str, int] = {}

    def bucket(tok: str) -> int:
        b = cache.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % dim
            if len(cache) >= MAX_CACHED_TOKENS:
                cache.clear()
            cache[tok] = b
        return b

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts):
            if t is None:
                continue
            for tok in pattern.findall(t.lower()):
                out[i, bucket(tok)] += 1.0
        return out

    return encode


PRECISIONS = ("float32", "float16", "binary")


def _finish(m: np.ndarray, normalize: bool, truncate_dim: int | None, precision: str) -> np.ndarray:
    if truncate_dim:
        m = m[:, :truncate_dim]
    if normalize:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    if precision == "float16":
        m = m.astype(np.float16).astype(np.float64)
    elif precision == "binary":
        m = (m > 0).astype(np.float64)
    elif precision != "float32":
        raise ValueError(f"unknown precision {precision!r}; expected one of {PRECISIONS}")
    return m


def embed_batches(df: DataFrame, text_col: str, out_col: str = "embedding",
                  encoder_factory: Callable[[], Encoder] = hashed_token_encoder, batch_size: int = 256,
                  normalize: bool = True, truncate_dim: int | None = None, precision: str = "float32") -> DataFrame:
    """Encode a text column into ``array<double>`` with a bring-your-own encoder."""
    if precision not in PRECISIONS:
        raise ValueError(f"unknown precision {precision!r}; expected one of {PRECISIONS}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder_factory()  # once per task
        for texts in batches:
            for i in range(0, len(texts), batch_size):  # the worker holds one batch of vectors
                yield pd.Series(list(_finish(enc(texts.iloc[i:i + batch_size].tolist()), normalize, truncate_dim, precision)))
            if not len(texts):
                yield pd.Series([], dtype=object)

    from ..sources.tables import spread

    return spread(df).withColumn(out_col, encode(F.col(text_col)))


# --- scorers ---------------------------------------------------------------------------------

def _n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)).cast("double")


def _ratio(text: Column, pattern: str) -> Column:
    n = F.length(text)
    hits = n - F.length(F.regexp_replace(text, pattern, ""))
    return F.when(n > 0, hits.cast("double") / n).otherwise(F.lit(0.0))


# The built-in scorers by name.
_SCORERS: dict[str, Callable[[Column], Column]] = {
    "n_chars": lambda t: F.length(t).cast("double"),
    "n_tokens": _n_tokens,
    "digit_ratio": lambda t: _ratio(t, "[0-9]"),
    "upper_ratio": lambda t: _ratio(t, "[A-Z]"),
}


def register_scorer(name: str, fn: Callable[[Column], Column], overwrite: bool = False) -> None:
    if name in _SCORERS and not overwrite:
        raise ValueError(f"scorer {name!r} already registered")
    _SCORERS[name] = fn


def score_function(name: str) -> Callable[[Column], Column]:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; expected one of {sorted(_SCORERS)}")
    return _SCORERS[name]


# --- candidate generators ----------------------------------------------------------------------

Generator = Callable[[str], list[str]]


def sentence_drop_generator(num_generate: int = 3, sep: str = ".") -> Callable[[], Generator]:
    """Built-in generator: the reference with one of its first ``num_generate`` segments removed."""
    def factory() -> Generator:
        def gen(text: str) -> list[str]:
            segs = text.split(sep)
            if len(segs) < 2:
                return []
            return [sep.join(segs[:i] + segs[i + 1:]) for i in range(min(num_generate, len(segs)))]
        return gen
    return factory


#: References whose candidates are made and passed on at once.
CANDIDATE_ROWS = 256


def generate_candidates(df: DataFrame, id_col: str, text_col: str, lane_col: str,
                        generator_factory: Callable[[], Generator]) -> DataFrame:
    """(id, lane, cand_idx, candidate, error) for every reference.  Rows are dealt by (lane, id), so a
    lane that holds most rows takes many tasks; each task builds its generator once.  A reference whose
    generator fails gives one row with the error and no candidate, so failures can be counted."""
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField(lane_col, T.IntegerType()), T.StructField("cand_idx", T.IntegerType()),
                           T.StructField("candidate", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = generator_factory()
        for whole in batches:
            for at in range(0, len(whole), CANDIDATE_ROWS):  # the worker holds the candidates of a few references
                pdf, rows = whole.iloc[at:at + CANDIDATE_ROWS], []
                for rid, text, lane in zip(pdf[id_col].tolist(), pdf[text_col].tolist(), pdf[lane_col].tolist()):
                    try:
                        rows += [(rid, lane, j, c, None) for j, c in enumerate(gen(text) if text is not None else [])]
                    except Exception as e:  # noqa: BLE001 - one failed reference must not end the job
                        rows.append((rid, lane, None, None, f"{type(e).__name__}: {e}"))
                out = pd.DataFrame(rows, columns=[f.name for f in schema.fields])
                yield out.astype({id_col: "int64", lane_col: "int32", "cand_idx": "Int32"})

    return df.select(id_col, text_col, F.col(lane_col).cast("int").alias(lane_col)).repartition(lane_col, id_col).mapInPandas(run, schema)


def cosine_squared(a, b) -> Column:
    """Example custom similarity registered under a new name."""
    c = V.cosine(a, b)
    return c * c
