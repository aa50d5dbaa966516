"""Dataset preparation: canonical schemas, sampling, de-duplication, splits, set operations
(SURVEY §2.A/2.B/2.G)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

# --- canonical schemas ------------------------------------------------------------------------

def canonical_pairs(df: DataFrame, a_col: str, b_col: str, label_col: str, label_type: str = "double",
                    names: Sequence[str] = ("id_a", "id_b", "label")) -> DataFrame:
    """Rename the configured columns to the pair schema, cast the label, drop the rest."""
    missing = [c for c in (a_col, b_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(F.col(a_col).alias(names[0]), F.col(b_col).alias(names[1]),
                     F.col(label_col).cast(label_type).alias(names[2]))


def canonical_labelled(df: DataFrame, key_col: str, label_col: str, names: Sequence[str] = ("id", "label")) -> DataFrame:
    missing = [c for c in (key_col, label_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(F.col(key_col).alias(names[0]), F.col(label_col).cast("bigint").alias(names[1]))


def cast_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Bring a re-read table back to its declared types; a missing column raises."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


# --- sampling ---------------------------------------------------------------------------------

def seeded_key(seed: int | str, id_col: str) -> Column:
    """Repeatable pseudo-random order key: md5(seed ‖ ':' ‖ id) (portable across engines)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


HEX_DIGITS = 32
#: A refinement step counts the rows by this many hex digits: at most 16^3 = 4096 bins (and one for no id) reach the driver.
BIN_DIGITS = 3


def _order_statistic(keys: DataFrame, key: str, n: int, enough: int) -> tuple[str, int, int]:
    """Where the ``n``-th smallest key lies: (prefix, rows of that prefix still wanted, all rows).

    Every row whose key is below the prefix belongs to the n smallest.  Each step counts the rows under
    the prefix found so far by its next digits; steps end when the prefix holds at most ``enough`` rows or no digits
    are left (equal keys)."""
    prefix, wanted, total = "", n, None
    while True:
        under = keys.where(F.substring(key, 1, len(prefix)) == prefix) if prefix else keys
        bins = under.groupBy(F.substring(key, len(prefix) + 1, BIN_DIGITS).alias("_d")).agg(F.count(F.lit(1)).alias("_n")).collect()
        total = sum(r["_n"] for r in bins) if total is None else total
        if wanted > sum(r["_n"] for r in bins):
            return "~", 0, total  # fewer rows than wanted: all keys are below
        for d, count in sorted((r["_d"], r["_n"]) for r in bins):
            if wanted <= count:
                break
            wanted -= count
        prefix += d
        if count <= enough or len(prefix) >= HEX_DIGITS:
            return prefix, wanted, total


def sample_exact(df: DataFrame, n: int, seed: int | str, id_col: str, on_short: str = "error") -> DataFrame:
    """Exactly ``n`` rows chosen by the seeded md5 order (ties by id, rows without id last).
    ``on_short='error'`` raises when the table has fewer than n rows, ``'clip'`` returns them all.

    The n-th key is found by counting digits of the keys (one pass over the ids for each 4096-fold of rows); a
    filter keeps the rows below it, and only rows that share its digits are sorted.  Whole rows are neither sorted nor shuffled.
    Rows with the same id are equal in the order: any of them may make up the number."""
    if on_short not in ("error", "clip"):
        raise ValueError("on_short must be 'error' or 'clip'")
    if n <= 0:
        return df.limit(0)
    key = F.coalesce(seeded_key(seed, id_col), F.lit("g" * HEX_DIGITS))
    keyed = df.withColumn("_sk", key)
    prefix, wanted, total = _order_statistic(keyed.select("_sk"), "_sk", n, max(16 ** BIN_DIGITS, n // 16))
    if on_short == "error" and total < n:
        raise ValueError(f"requested {n} rows but the table has {total}")
    head = F.substring("_sk", 1, len(prefix))
    below = keyed.where(head < prefix)
    if not wanted:
        return below.drop("_sk")
    edge = keyed.where(head == prefix)
    # all keys equal: the number is made up from any of them
    edge = edge.limit(wanted) if len(prefix) >= HEX_DIGITS else edge.orderBy("_sk", id_col).limit(wanted)
    return below.unionByName(edge).drop("_sk")


# --- de-duplication ---------------------------------------------------------------------------

def dedupe_keep_first(df: DataFrame, key_cols: Sequence[str], order_col: str) -> DataFrame:
    """Drop exact duplicates of ``key_cols``, keeping the row with the smallest ``order_col``.

    ``min_by`` over a struct of the row is an ordinary aggregate with a map-side partial
    step, so a key repeated in a third of the table is collapsed on every partition before
    the shuffle instead of being sorted in one window task.  NULLs of ``order_col`` come last; a key
    with nothing else keeps one of its rows.
    """
    others = [c for c in df.columns if c not in key_cols]
    first = F.struct(F.col(order_col).isNull(), F.col(order_col))
    agg = df.groupBy(*key_cols).agg(F.min_by(F.struct(*others), first).alias("_first"))
    return agg.select(*key_cols, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*df.columns)


DAMAGED = r"[\x00-\x08\x0E-\x1F\x{FFFD}]"


def canonical_text(text: Column) -> Column:
    """Primary canonical form: lower case, whitespace runs collapsed, trimmed; NULL if empty, or if the
    text is damaged (control or replacement characters)."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when((F.length(t) > 0) & ~text.rlike(DAMAGED), t)


def fallback_text(text: Column) -> Column:
    """Fallback canonical form: letters and digits only (lower case); NULL if nothing is left."""
    t = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(t) > 0, t)


def dedupe_canonical(df: DataFrame, text_col: str, order_col: str, key_col: str = "canonical") -> DataFrame:
    """Key = primary canonical form, else the fallback, else NULL (row dropped); one row per key."""
    keyed = df.withColumn(key_col, F.coalesce(canonical_text(F.col(text_col)), fallback_text(F.col(text_col))))
    return dedupe_keep_first(keyed.where(F.col(key_col).isNotNull()), [key_col], order_col)


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with NULL — or NaN in floating columns — in any of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def derive_column(df: DataFrame, name: str, expr: Column, drop_failed: bool = True) -> DataFrame:
    """Add a per-row derived column (use ``try_*`` functions so a failure gives NULL) and drop
    the rows where it failed."""
    out = df.withColumn(name, expr)
    return drop_missing(out, [name]) if drop_failed else out


def changed_only(df: DataFrame, sim_col: str, digits: int = 6) -> DataFrame:
    """Keep candidates whose similarity to the reference is not 1.0 (after rounding)."""
    return df.where(F.round(F.col(sim_col).cast("double"), digits) != 1.0)


def label_head(df: DataFrame, label_col: str, label, n: int, order_col: str, prob_col: str,
               category_col: str) -> DataFrame:
    """First n rows of one label with a legend string ``category - prob: p``."""
    sub = df.where(F.col(label_col) == F.lit(label)).orderBy(order_col).limit(n)
    return sub.withColumn("legend", F.concat(F.col(category_col).cast("string"), F.lit(" - prob: "),
                                             F.format_number(F.col(prob_col).cast("double"), 2)))


# --- splits -----------------------------------------------------------------------------------

def split_union(parts, dataset_col: str = "dataset", split_col: str = "split") -> DataFrame:
    """Tag each (dataset, split) table and union them by name.

    ``parts`` is ``{split: {dataset: df}}`` or a list of ``(split, dataset, df)`` entries; a
    dataset key repeated within a split raises (checked for every split, not only train)."""
    if isinstance(parts, Mapping):
        entries = [(split, name, df) for split, datasets in parts.items() for name, df in datasets.items()]
    else:
        entries = list(parts)
    for split in {e[0] for e in entries}:
        check_unique_keys([name for s, name, _ in entries if s == split])
    if not entries:
        raise ValueError("no datasets given")
    out = None
    for split, name, df in entries:
        tagged = df.withColumn(dataset_col, F.lit(name)).withColumn(split_col, F.lit(split))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def check_unique_keys(keys: Sequence[str]) -> None:
    dup = sorted({k for k in keys if list(keys).count(k) > 1})
    if dup:
        raise ValueError(f"duplicate dataset keys: {dup}")


def hash_split(id_col: str, train: int = 8, val: int = 1) -> Column:
    """Repeatable split from md5 of the id (buckets of ten)."""
    h = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(h < train, "train").when(h < train + val, "val").otherwise("test")


def split_sizes(tagged: DataFrame, dataset_col: str = "dataset", split_col: str = "split",
                batch_size: int = 32, epochs: int = 1, lr_base: float = 1e-5) -> DataFrame:
    """Rows per (dataset, split); per split the total rows (= steps per epoch as counted by the
    trainer), learning rate lr·√B and decay 0.05·√(B / (S·B·E))."""
    per = tagged.groupBy(dataset_col, split_col).agg(F.count(F.lit(1)).alias("rows"))
    tot = per.groupBy(split_col).agg(F.sum("rows").alias("split_rows"))
    b = float(batch_size)
    return per.join(tot, split_col).select(
        dataset_col, split_col, "rows", "split_rows",
        F.round(F.lit(lr_base) * F.sqrt(F.lit(b)), 12).alias("scaled_lr"),
        F.round(F.lit(C.WEIGHT_DECAY_FACTOR) * F.sqrt(F.lit(b) / (F.col("split_rows") * b * epochs)), 12).alias("weight_decay"))


def pending_inputs(inputs: DataFrame, name_col: str, wanted: Sequence[str], completed: DataFrame,
                   completed_col: str) -> DataFrame:
    """Names that contain any wanted substring and contain none of the completed names, sorted
    descending.

    "Contains a completed name" is an equality join: each candidate is cut into its substrings of
    the lengths that completed names have (names are short, so there are few lengths), and one
    that equals a completed name rules the candidate out."""
    cond = None
    for w in wanted:
        term = F.col(name_col).contains(w)
        cond = term if cond is None else cond | term
    cand = inputs.select(name_col).distinct().where(cond)
    done = completed.select(F.col(completed_col).alias("_done")).where(F.col("_done").isNotNull()).distinct()
    lengths = done.agg(F.collect_set(F.length("_done"))).scalar()
    cut = cand.withColumn("_lengths", lengths).withColumn("_n", F.explode("_lengths"))
    cut = cut.withColumn("_at", F.explode(F.when(F.col("_n") == 0, F.array(F.lit(1))).when(
        F.length(name_col) >= F.col("_n"), F.sequence(F.lit(1), F.length(name_col) - F.col("_n") + 1)).otherwise(F.array().cast("array<int>"))))
    cut = cut.select(name_col, F.substring(F.col(name_col), F.col("_at"), F.col("_n")).alias("_done"))
    seen = cut.join(done, "_done", "left_semi").select(name_col).distinct()
    return cand.join(seen, name_col, "left_anti").orderBy(F.col(name_col).desc())


# --- set operations -------------------------------------------------------------------------

def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_distinct(parts: Sequence[DataFrame]) -> DataFrame:
    return union_all(parts).distinct()


def library_update(library: DataFrame, candidates: DataFrame, key_col: str, score_col: str, top_n: int) -> DataFrame:
    """Drop candidates with a NULL score, a score not above the current minimum (0.0 for an
    empty library) or a key already in the library; append the rest; keep the n best.

    A key is held once, with its best score.  The minimum is one aggregated value (scalar subquery);
    the seen-check is an anti join."""
    current_min = library.agg(F.coalesce(F.min(score_col).cast("double"), F.lit(0.0))).scalar()
    fresh = (candidates.where(F.col(score_col).isNotNull() & (F.col(score_col).cast("double") > current_min))
             .join(library.select(key_col), key_col, "left_anti"))
    merged = library.select(key_col, score_col).unionByName(fresh.select(key_col, score_col))
    best = merged.groupBy(key_col).agg(F.max(score_col).alias(score_col))
    return best.orderBy(F.col(score_col).desc(), F.col(key_col)).limit(top_n)
