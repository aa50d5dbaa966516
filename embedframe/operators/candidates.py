"""Candidate scoring, top-k selection, lanes, batches, masking and fragments.

Top-k per group is ``row_number() ≤ k`` with a literal k, so Catalyst inserts a partial
``WindowGroupLimit`` before the shuffle: a group holding a third of all rows is cut to k
rows on every partition before it moves.  "Best per group" is a ``max_by`` aggregate
(partial aggregation).  Lanes and batches use distributed row numbers and arithmetic, never
a window over a whole segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import reliable_checkpoint
from .ordering import global_row_number
from .. import constants as C


def score_candidates(refs: DataFrame, cands: DataFrame, ref_key: str, cand_key: str, base_score: Column,
                     similarity: Column, score_cutoff: float = C.SCORE_CUTOFF, sim_cutoff: float = C.SIMILARITY_CUTOFF,
                     composite: bool = True) -> DataFrame:
    """Join each reference with its candidates (equi join), add ``base_score``, ``similarity``
    and ``score`` (composite, or the base score when switched off); drop rows with a NULL."""
    j = refs.join(cands, refs[ref_key] == cands[cand_key])
    j = j.withColumn("base_score", base_score).withColumn("similarity", similarity)
    score = V.composite_score("base_score", "similarity", score_cutoff, sim_cutoff) if composite else F.col("base_score")
    return j.withColumn("score", score).na.drop(subset=["base_score", "similarity", "score"])


def topk_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                   reference_quirk: bool = True) -> DataFrame:
    """Best ``k`` rows per group.  With ``reference_quirk`` at most n − 1 rows of a group of n
    are kept (a group of one keeps none), as the reference does.

    The quirk only bites when n ≤ k, so the k + 1 best rows are enough to decide it: their
    count c is n when n ≤ k and k + 1 otherwise, and min(k, c − 1) rows are kept.  Both
    windows share one partitioning and the first one is a partial ``WindowGroupLimit``."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    if not reference_quirk:
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    top = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k + 1)
    top = top.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(*group_cols)))
    return top.where(F.col("_rn") <= F.least(F.lit(k), F.col("_c") - 1)).drop("_rn", "_c")


def best_per_group(df: DataFrame, group_cols: Sequence[str], score_col: str, tiebreak: Sequence[str]) -> DataFrame:
    """The best row per group (highest score, then the smallest tiebreak columns)."""
    others = [c for c in df.columns if c not in group_cols]
    key = F.struct(F.col(score_col).isNull(), -F.col(score_col), *tiebreak)  # smallest first; any orderable tiebreak
    return (df.groupBy(*group_cols).agg(F.min_by(F.struct(*others), key).alias("_b"))
            .select(*group_cols, *[F.col(f"_b.{c}").alias(c) for c in others]))


def topn_global(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """n best rows overall: a top-n (each partition keeps n rows, one merge of n·partitions)."""
    return df.orderBy(*order).limit(n)


def batch_index(df: DataFrame, order_cols: Sequence[str], size: int) -> DataFrame:
    """0-based row position and ``batch_start = floor(row/size)·size``; the last row is kept."""
    numbered = global_row_number(df, order_cols, out_col="_rn")
    return (numbered.withColumn("row", (F.col("_rn") - 1).cast("long"))
            .withColumn("batch_start", (F.floor(F.col("row") / size) * size).cast("long")).drop("_rn"))


def check_lanes(fractions: Sequence[float], lanes: Sequence[int]) -> None:
    """Each segment has a share of the rows and a positive number of lanes; shares make up the whole."""
    if empty := [i for i, m in enumerate(lanes) if m < 1]:
        raise ValueError(f"segments without a lane: {empty}")
    if len(lanes) != len(fractions):
        raise ValueError(f"{len(lanes)} lane counts for {len(fractions)} shares")
    if abs(1.0 - (whole := sum(fractions))) > 1e-5:
        raise ValueError(f"the shares make up {whole:g} of the rows, not 1")


def weighted_lanes(df: DataFrame, order_cols: Sequence[str], fractions: Sequence[float],
                   lanes: Sequence[int]) -> DataFrame | None:
    """Cut the ordered rows into segments (size int(total·f), the last takes the rest) and each
    segment into m near-equal lanes, larger lanes first.  Adds ``segment`` and ``lane`` (global
    lane number).  No segments → None.

    Positions come from the distributed row numbering; segment and lane are arithmetic on the
    position and the total (one scalar aggregate), so no window spans a segment."""
    if len(lanes) == 0:
        return None
    check_lanes(fractions, lanes)
    total = df.agg(F.count(F.lit(1))).scalar()
    numbered = global_row_number(df, order_cols, out_col="_rn").withColumn("_pos", F.col("_rn") - 1)
    # segment bounds: start_i = Σ_{j<i} int(total·f_j); the last segment ends at total
    starts, lane_base = [F.lit(0)], [0]
    for f in fractions[:-1]:
        starts.append(starts[-1] + F.floor(total * F.lit(float(f))).cast("long"))
    for m in lanes[:-1]:
        lane_base.append(lane_base[-1] + m)
    seg = F.lit(0)
    for i in range(1, len(fractions)):
        seg = F.when(F.col("_pos") >= starts[i], F.lit(i)).otherwise(seg)
    out = numbered.withColumn("segment", seg)
    start_c = F.element_at(F.array(*starts), F.col("segment") + 1)
    end_c = F.element_at(F.array(*(starts[1:] + [total])), F.col("segment") + 1)
    m_c = F.element_at(F.array(*[F.lit(int(m)) for m in lanes]), F.col("segment") + 1)
    base_c = F.element_at(F.array(*[F.lit(b) for b in lane_base]), F.col("segment") + 1)
    seg_len = end_c - start_c
    q = F.floor(seg_len / m_c)
    r = seg_len - q * m_c
    p = F.col("_pos") - start_c
    lane_in = F.when(p < r * (q + 1), F.floor(p / (q + 1))).otherwise(r + F.floor(F.try_divide(p - r * (q + 1), q)))
    return out.withColumn("lane", (base_c + lane_in).cast("int")).drop("_rn", "_pos")


# --- masking ------------------------------------------------------------------------------

def hash_int(*parts: Column) -> Column:
    """Non-negative integer from the first 8 hex digits of md5(parts joined by ':')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def mask_segment(df: DataFrame, id_col: str, text_col: str, seed: int = 0, min_tokens: int = 1, max_tokens: int = 5,
                 round_col: str | None = None, sep: str = ".") -> DataFrame:
    """Split the text on ``sep``, pick one segment (repeatable md5 choice from seed, id and round),
    replace it by ``[*{L-(L+n)}]`` with L its length and n in [min, max) (max when min > max,
    min when equal), and join back.  Adds ``seg_pos``, ``n_tokens``, ``mask`` and ``masked``."""
    rnd = F.col(round_col) if round_col else F.lit(0)
    segs = F.split(F.col(text_col), "\\" + sep if sep in ".|*+?()[]{}^$\\" else sep, -1)
    pos = F.pmod(hash_int(F.lit(seed), F.col(id_col), rnd, F.lit("seg")), F.size(F.col("_segs")))
    if min_tokens > max_tokens:
        n = F.lit(max_tokens)
    elif min_tokens == max_tokens:
        n = F.lit(min_tokens)
    else:
        n = F.lit(min_tokens) + F.pmod(hash_int(F.lit(seed), F.col(id_col), rnd, F.lit("len")), F.lit(max_tokens - min_tokens))
    out = df.withColumn("_segs", segs).withColumn("seg_pos", pos.cast("int")).withColumn("n_tokens", n.cast("int"))
    length = F.length(F.get(F.col("_segs"), F.col("seg_pos")))
    out = out.withColumn("mask", F.format_string(C.MASK_TEMPLATE, length, length + F.col("n_tokens")))
    # slices around the chosen segment: no lambda, so nothing per-row is re-evaluated per element
    masked = F.array_join(F.concat(F.slice("_segs", F.lit(1), F.col("seg_pos")), F.array(F.col("mask")),
                                   F.slice("_segs", F.col("seg_pos") + 2, F.greatest(F.size("_segs"), F.lit(1)))), sep)
    return out.withColumn("masked", masked).drop("_segs")


def mask_repeat(df: DataFrame, id_col: str, text_col: str, rounds: int, **kw) -> DataFrame:
    """``rounds`` maskings per row (one row per round)."""
    return mask_segment(df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))), id_col, text_col,
                        round_col="round", **kw)


# --- fragments ----------------------------------------------------------------------------

FRAGMENT_SPLIT = r"[.!?;\n]+"


def fragment_explode(df: DataFrame, id_col: str, text_col: str, score_col: str) -> DataFrame:
    """Distinct non-empty pieces of each record (split on sentence punctuation), each inheriting
    the parent's score."""
    pieces = F.array_distinct(F.filter(F.transform(F.split(F.col(text_col), FRAGMENT_SPLIT), lambda x: F.trim(x)),
                                       lambda x: F.length(x) > 0))
    return df.select(id_col, score_col, F.explode(pieces).alias("fragment"))


def fragment_library_update(library: DataFrame, records: DataFrame, candidates: DataFrame, text_col: str, score_col: str,
                            top_n: int) -> tuple[DataFrame, DataFrame]:
    """One round of a fragment library: (fragments, records) after ``candidates`` were offered.

    ``library`` holds (fragment, score), ``records`` the (text, score) accepted so far.  A candidate is
    accepted when its score is above the library's smallest (0.0 for an empty library) and its whole text isn't
    among the records; NULL texts and scores never are.  Accepted texts are cut into fragments that
    inherit the score, and the ``top_n`` best fragments stay (ties by text).  A text offered
    twice counts once and a fragment is held once, each with its best score.

    The smallest score is one aggregated value (scalar subquery), the seen-test an anti join; both
    results are written, for a next round reads them several times."""
    lowest = library.agg(F.coalesce(F.min(score_col).cast("double"), F.lit(0.0))).scalar()
    offered = candidates.where(F.col(text_col).isNotNull() & (F.col(score_col).cast("double") > lowest))
    best = offered.groupBy(text_col).agg(F.max(F.col(score_col).cast("double")).alias(score_col))
    accepted = reliable_checkpoint(best.join(records.select(text_col), text_col, "left_anti"))
    pieces = fragment_explode(accepted, text_col, text_col, score_col).select("fragment", score_col)
    merged = library.select("fragment", F.col(score_col).cast("double").alias(score_col)).unionByName(pieces)
    held = merged.groupBy("fragment").agg(F.max(score_col).alias(score_col)).orderBy(F.col(score_col).desc(), "fragment").limit(top_n)
    return reliable_checkpoint(held), records.select(text_col, F.col(score_col).cast("double").alias(score_col)).unionByName(accepted)


def fragment_pair_combine(fragments: DataFrame, frag_col: str, seed: int = 0, joiner: str = ".") -> DataFrame:
    """Pair distinct fragments in a seeded pseudo-random order: the fragment at position i with
    the one at i + 1 (an equi join on the position), and join each pair into a new record.
    Linear in the number of fragments; no pair enumeration."""
    distinct = fragments.select(frag_col).distinct().withColumn(
        "_k", F.md5(F.concat(F.lit(f"{seed}:"), F.col(frag_col))))
    numbered = global_row_number(distinct, ["_k", frag_col], out_col="_rn")
    a = numbered.select(F.col("_rn").alias("_i"), F.col(frag_col).alias("left"))
    b = numbered.select((F.col("_rn") - 1).alias("_i"), F.col(frag_col).alias("right"))
    return a.join(b, "_i").select("_i", "left", "right",
                                  F.concat(F.col("left"), F.lit(joiner), F.col("right")).alias("combined"))


# The feature families and the pattern that marks each (re-aimed at text).
FEATURE_FAMILIES: Mapping[str, str] = {
    "digit": r"[0-9]",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "url": r"https?://",
    "upper": r"[A-Z]",
    "accent": r"[àâäéèêëîïôöùûüçñß]",
    "question": r"\?",
    "exclamation": r"!",
    "newline": r"\n",
}


def feature_families(text: Column, families: Mapping[str, str] = FEATURE_FAMILIES) -> Column:
    """Sorted array of the family names whose pattern occurs in the text."""
    names = [F.when(text.rlike(p), F.lit(n)) for n, p in families.items()]
    return F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull())))


TOKEN_REGEX = r"[\p{L}]+|[0-9]+|[^\s\p{L}0-9]"


def tokenize(text: Column, pattern: str = TOKEN_REGEX) -> Column:
    """Regex tokens (words, numbers, single punctuation marks)."""
    return F.regexp_extract_all(text, F.lit(pattern), 0)
