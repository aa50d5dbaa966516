"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of byte contexts of 0 to 3 bytes.  A byte's probability in a
context is its count over (total + distinct), an escape has (distinct) over (total + distinct)
(escape method C) and leads to the context a byte shorter, at last to 1/256.  The statistics
are frozen after the fit, so a text's code length in a language is an exact sum over its bytes,
and the shortest code names the language.

The trees of all languages become one table: a row for each context of three bytes that any
language knows, and one for each of two bytes, with the code length of every next byte in every
language.  A text is then scored with array lookups, whole, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PAD = b"\n\n\n"
BLOCK_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Frozen code lengths: ``bits[row, next byte's rank, language]``; see ``contexts``."""

    langs: list[str]
    ranks: np.ndarray     # byte -> rank; bytes that no language has share the last one
    contexts: np.ndarray  # rank of three bytes -> row
    bits: np.ndarray

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK_BYTES):  # a long text goes in blocks that carry their context
                part = t[at:at + BLOCK_BYTES]
                held.append((i, t[at - 3:at] if at else PAD, part))
                size += len(part)
                if size >= BLOCK_BYTES:
                    self._add(out, held)
                    held, size = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, bytes, bytes]]) -> None:
        a = len(self.bits[0])
        r = self.ranks[np.frombuffer(b"".join(x for _, before, part in held for x in (before, part)), np.uint8)]
        rows = self.contexts[(r[:-3] * a + r[1:-2]) * a + r[2:-1]] * a + r[3:]
        ends = np.cumsum([3 + len(part) for _, _, part in held])
        flat = self.bits.reshape(-1, len(self.langs))
        for (i, _, part), end in zip(held, ends.tolist(), strict=True):
            out[i] += flat[rows[end - 3 - len(part):end - 3]].sum(axis=0, dtype=np.float64)


def gram_counts(df: DataFrame, group_col: str, text_col: str) -> DataFrame:
    """(group, gram, n): four-byte strings of the texts, as integers, each text after three newlines."""
    common.small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(g, []).append(t.encode("utf-8"))
            for g, own in texts.items():
                x = np.frombuffer(PAD + PAD.join(own), np.uint8).astype(np.int64)
                grams = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
                ends = np.cumsum([3 + len(t) for t in own])[:-1]
                if len(ends):  # the strings that end in the newlines between two texts
                    grams = np.delete(grams, (ends[:, None] - 3 + np.arange(3)).ravel())
                values, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(values), pa.string()), pa.array(values, pa.int64()),
                                                  pa.array(n, pa.int64())], ["lang", "gram", "n"])

    part = df.select(F.col(group_col).cast("string"), F.col(text_col)).mapInArrow(run, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, in_training: Column, docs_per_lang: int, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang") -> DataFrame:
    """(lang, text) of about ``docs_per_lang`` documents of each language, all where there are fewer:
    those with the smallest id hashes.  Only ids and languages are counted first."""
    known = docs.where(in_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = {r[0]: min(1.0, docs_per_lang / r[1]) for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not share:
        return docs.where(F.lit(False)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    of = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.where(place < of[F.col(lang_col).cast("string")]).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def fit(sampled: DataFrame, least: int = 2) -> Model:
    """The model of a bounded sample (``sample``): its gram counts are summed by Spark, and the
    driver builds the tables of the distinct ones.  Three-byte contexts seen fewer than ``least``
    times count as unseen."""
    rows = gram_counts(sampled, "lang", "text").toPandas().sort_values(["lang", "gram"])
    langs = sorted(rows["lang"].unique().tolist())
    grams = rows["gram"].to_numpy(np.int64)
    n = rows["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy()) if langs else np.zeros(0, int)
    parts = [(grams >> s) & 255 for s in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate([*parts, [10]]))
    a = len(seen) + 1
    ranks = np.full(256, a - 1, np.int64)
    ranks[seen] = np.arange(len(seen))
    p = [ranks[x] for x in parts]
    bits = np.full((len(langs), 1, a), 8.0)
    for order in range(3):  # contexts of 0, 1 and 2 bytes, dense
        context = np.zeros(len(grams), np.int64)
        for x in p[3 - order:3]:
            context = context * a + x
        size = a ** order
        counts = np.zeros((len(langs), size, a))
        np.add.at(counts, (lang, context, p[3]), n)
        longer = np.tile(bits, (1, size // bits.shape[1], 1)) if order else bits
        bits = _escaped(counts, longer)
    # contexts of three bytes: those seen often enough
    key = (p[0] * a + p[1]) * a + p[2]
    distinct, where = np.unique(key, return_inverse=True)
    enough = np.bincount(where, weights=n, minlength=len(distinct)) >= least
    row_of = np.cumsum(enough) - 1
    kept = enough[where]
    out = np.empty((int(enough.sum()) + a * a, a, len(langs)), np.float32)
    contexts = np.tile(np.arange(a * a, dtype=np.int32) + int(enough.sum()), a)
    contexts[distinct[enough]] = np.arange(int(enough.sum()), dtype=np.int32)
    for k in range(len(langs)):
        own = kept & (lang == k)
        counts = np.zeros((1, int(enough.sum()), a), np.float32)
        counts[0, row_of[where[own]], p[3][own]] = n[own]
        out[:int(enough.sum()), :, k] = _escaped(counts, bits[k][distinct[enough] % (a * a)][None])[0]
        out[int(enough.sum()):, :, k] = bits[k]
    return Model(langs, ranks, contexts, out)


def _escaped(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths from counts and the shorter context's lengths: [language, context, byte]."""
    total = counts.sum(axis=2, keepdims=True)
    kinds = (counts > 0).sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log2(total + kinds) - np.log2(counts)
        escape = np.where(total > 0, np.log2(total + kinds) - np.log2(np.maximum(kinds, 1)), 0.0)
    return np.where(counts > 0, seen, escape + shorter)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) of every whole text; score is the language's posterior under
    equal priors.  NULL texts, texts without a letter, and all texts under a model without
    languages are ``und`` with score 0.  Ties go to the first language in order.  The table is
    broadcast; its size depends on the languages and their bytes, not on the documents."""
    shared = common.broadcast_value(docs.sparkSession, model)

    def compute(texts: list[str | None]) -> list[pa.Array]:
        m = shared.value
        usable = [i for i, t in enumerate(texts) if t and m.langs and LETTER.search(t)]
        lang, score, length = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        if usable:
            bits = m.code_lengths([texts[i].encode("utf-8") for i in usable])
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            for j, i in enumerate(usable):
                lang[i], score[i], length[i] = m.langs[best[j]], float(posterior[j]), float(least[j])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(length, pa.float64())]

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType())]
    return common.with_columns(docs.select(id_col, text_col), added, text_col, compute, carry=[id_col])


def identify(docs: DataFrame, in_training: Column, docs_per_lang: int = 2000, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """Fit on a bounded sample of the rows that ``in_training`` admits and predict every document.

    Empty texts are ``und``; repeated rows get equal results; other columns are ignored; an empty
    table gives an empty result."""
    model = fit(sample(docs, in_training, docs_per_lang, id_col, text_col, lang_col))
    return predict(docs, model, id_col, text_col)
