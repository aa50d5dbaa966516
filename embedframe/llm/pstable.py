"""Near-duplicate vectors by p-stable hashing, checked by exact cosine.

Unit vectors are hashed by floor((a . v + b) / width) with Gaussian a (Datar et al. 2004); ``k`` such
numbers make the bucket of a table, and there are ``tables`` of them.  With width 2, k 14 and 48
tables a pair at the threshold 0.93 (distance 0.374) shares a bucket with probability 0.995, a pair
of cosine 0.97 with more than 0.9999, and an unrelated pair in about one table of 24 000.

Only members of buckets with company travel on, and equal vectors travel once, as a class.  A pair
that meets in several tables is checked in the first of them only: each vector carries its
buckets, so a task sees whether an earlier table has the pair.  A bucket's task gives out counts
and links that span components, not pairs; a bucket of any size is cut into blocks of bounded size
that meet two by two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.learn import connected_components
from . import common

BLOCK_ROWS = 4096


def hash_family(dims: int, tables: int, k: int, width: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims])
    return rng.normal(size=(dims, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 1 << 62, (tables, k)) | 1


def buckets(unit: np.ndarray, tables: int, k: int, width: float) -> np.ndarray:
    """(rows, tables) bucket numbers of unit vectors."""
    a, b, mix = hash_family(unit.shape[1], tables, k, width)
    h = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, k)
    with np.errstate(over="ignore"):
        h = (h * mix).sum(axis=2)
        return (h ^ (h >> 29)) * np.int64(0x5851F42D4C957F2D)


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows (id, class), classes (class, label, vec, n)): rows with a label and a finite nonzero
    vector; a class is the rows with equal label and vector, named by its smallest id."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = (df.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(whole)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                    F.transform(x, lambda v: v + F.lit(0.0)).alias("vec")))
    rows = common.written(rows, "lsh-rows")
    cls = rows.groupBy("label", "vec").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    cls = common.written(cls.select("class", "label", "vec", "n"), "lsh-classes")
    return rows, cls


def block_links(cls: list[int], weight: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, split: int, own: bool,
                threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Counts of linked rows, and links that span components, of the pairs of one block: all pairs
    (``own``), or rows before ``split`` with rows from it on.  Pairs with an earlier table in common
    are left to that."""
    m = len(cls)
    group = np.arange(m)
    count = np.zeros(m, np.int64)
    links = []
    at = np.arange(m)
    for i in range(m if own else split):
        js = at[i + 1:] if own else at[split:]
        js = js[unit[js] @ unit[i] >= threshold]
        if table and len(js):
            js = js[~(keys[js, :table] == keys[i, :table]).any(axis=1)]
        if not len(js):
            continue
        count[i] += weight[js].sum()
        count[js] += weight[i]
        for j in js[group[js] != group[i]].tolist():
            if group[i] != group[j]:
                links.append((cls[i], cls[j]))
                group[group == group[j]] = group[i]
    return {cls[i]: int(count[i]) for i in np.flatnonzero(count)}, links


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = 48, k: int = 14, width: float = 2.0,
                    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows are compared where labels are equal.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows without label or
    id, link with nothing.  Equal vectors link with each other and count one by one.  Other columns are
    ignored; an empty table gives an empty result."""
    spark = vectors.sparkSession
    rows, cls = classes(vectors, id_col, vec_col, label_col)
    common.small_batches(spark)

    def hashed(batches):
        for b in batches:
            vec = b.column(2).to_pylist()
            out = [None] * len(vec)
            for dims in {len(v) for v in vec}:
                at = [i for i, v in enumerate(vec) if len(v) == dims]
                x = np.array([vec[i] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                for i, h in zip(at, buckets(x / np.linalg.norm(x, axis=1, keepdims=True), tables, k, width), strict=True):
                    out[i] = h
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(out, pa.list_(pa.int64()))],
                                             ["class", "label", "vec", "n", "keys"])

    schema = T.StructType([*cls.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    signed = common.written(cls.mapInArrow(hashed, schema), "lsh-signed")
    entries = signed.select("class", "label", F.size("vec").alias("dims"), F.posexplode("keys").alias("table", "bucket"))
    key = ["label", "dims", "table", "bucket"]
    crowded = (entries.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
               .withColumn("subs", F.ceil(F.col("m") / BLOCK_ROWS).cast("int")).drop("m"))
    placed = entries.join(crowded, key).withColumn("sub", F.pmod(F.xxhash64("class"), F.col("subs")).cast("int"))
    # blocks meet two by two: (a, b) with a <= b; a bucket of one block meets itself
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    placed = placed.select(*key, F.least("sub", "other").alias("a"), F.greatest("sub", "other").alias("b"), "sub", "class")
    full = placed.join(signed.select("class", "vec", "n", "keys"), "class")

    def check(g: pa.RecordBatch) -> list[pa.Array] | None:
        x = common.rows_of(g.column("vec"), np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        a, b = g.column("a")[0].as_py(), g.column("b")[0].as_py()
        split = int((g.column("sub").to_numpy() == a).sum())
        counts, links = block_links(g.column("class").to_pylist(), g.column("n").to_numpy(), unit, common.rows_of(g.column("keys"), np.int64),
                                    g.column("table")[0].as_py(), split, a == b, threshold)
        if not counts:
            return None
        src = [*counts, *(p for p, _ in links)]
        dst = [None] * len(counts) + [q for _, q in links]
        return [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array([*counts.values()] + [None] * len(links), pa.int64())]

    found = common.written(common.by_group(full, [*key, "a", "b"], ["sub", "class"], "src long, dst long, n long", check), "lsh-found")
    links = found.where("dst is not null").select("src", "dst").distinct()
    linked = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("linked"))
    comps = connected_components(linked.select(F.col("src").alias("id")), links, "id").select(F.col("id").alias("class"), "component")
    per_class = (cls.select("class", "n").join(linked.withColumnRenamed("src", "class"), "class", "left").join(comps, "class", "left")
                 .select("class", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "class").alias("comp")))
    # rows find their class by its key, so copies need no list
    named = rows.join(cls.select("label", "vec", "class"), ["label", "vec"]).select("id", "class").join(per_class, "class")
    named = named.groupBy("id").agg(F.max("links").alias("links"), F.min("comp").alias("comp"))
    out = vectors.select(F.col(id_col)).join(named, F.col(id_col) == F.col("id"), "left")
    return out.select(id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("comp", F.col(id_col)).cast("long").alias("component_id"),
                      (F.coalesce("comp", F.col(id_col)) == F.col(id_col)).alias("kept"))
