"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

Documents with equal texts form a group, a weighted point: its weight is the group's bytes, its
coordinates the metadata (log size, language, source, smallest id).  A node that shall become
k shards is split along its widest dimension at the weighted quantile k//2 : k (the median when
k is even) until each node is one shard.

The quantile is found by histogram refinement: each round sums the weights of at most ``BINS``
bins of every open node's key range where they lie, and narrows the range to the bin that holds
the quantile.  Rounds stop when that bin weighs at most ``slack`` of a shard; then it goes whole
to the nearer side.  A single group that weighs more is cut between two of its rows, so a group
of copies that holds a third of all bytes spreads over as many shards as it fills, and any other
group stays together.  The driver sees a few numbers for each node, never points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packing import number_within

BINS = 1024
CODE = (1 << 31) - 1


@dataclass
class _Open:
    """A node being split: the key range that holds the quantile, and the weight below it."""

    node: int
    dim: int
    low: int
    high: int
    below: int
    target: float
    shard_weight: float


def _values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small local table of whole numbers."""
    cells = ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(names)})")


def _scaled(col: Column, low: float, high: float) -> Column:
    """A number between ``low`` and ``high`` as an integer code of 31 bits; NULLs are 0."""
    if high <= low:
        return F.lit(0).cast("long")
    return F.coalesce(((col.cast("double") - F.lit(low)) / F.lit(high - low) * F.lit(float(CODE))).cast("long"), F.lit(0).cast("long"))


def _hashed(col: Column) -> Column:
    return F.xxhash64(col).bitwiseAND(F.lit(CODE))


def groups(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, points), both written: rows (id, size, text_crc32, gid); points (gid, size, first, n,
    one key for each dimension)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = common.written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat_ws(":", F.octet_length(text), F.md5(text.cast("binary"))).alias("gid"),
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")), "shard-rows")
    # one of each group's metadata: its smallest, so that copies share a point; text is a function of gid
    points = rows.groupBy("gid").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"),
                                     F.min("lang").alias("lang"), F.min("source").alias("source"))
    points = common.written(points, "shard-points")
    r = points.agg(F.min(F.log2("size")), F.max(F.log2("size")), F.min("id"), F.max("id")).first()
    tie = _hashed(F.col("gid"))
    dims = [_scaled(F.log2("size"), r[0] or 0.0, r[1] or 0.0), _hashed(F.col("lang")), _hashed(F.col("source")),
            _scaled(F.col("id"), float(r[2] or 0), float(r[3] or 0))]
    keyed = points.select("gid", "size", F.lit(0).cast("long").alias("first"), "n",
                          *[F.shiftleft(d, 31).bitwiseOR(tie).alias(f"k{i}") for i, d in enumerate(dims)])
    return rows.drop("lang", "source"), keyed


def _weights(points: DataFrame, state: list[_Open], keys: int) -> DataFrame:
    """(node, bin, weight, size, rows, distinct keys, smallest key) of the bins of the open ranges."""
    spark = points.sparkSession
    s = _values(spark, [(o.node, o.dim, o.low, o.high, max(1, -(-(o.high - o.low + 1) // BINS))) for o in state],
                ["_node", "_dim", "_low", "_high", "_step"])
    key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(keys)]), F.col("_dim").cast("int") + 1)
    part = (points.join(F.broadcast(s), F.col("node") == F.col("_node")).withColumn("_key", key)
            .where((F.col("_key") >= F.col("_low")) & (F.col("_key") <= F.col("_high"))))
    return part.groupBy("node", F.floor((F.col("_key") - F.col("_low")) / F.col("_step")).cast("long").alias("bin")).agg(
        F.sum(F.col("size") * F.col("n")).alias("w"), F.min("size").alias("size"), F.sum("n").alias("n"),
        F.min("_key").alias("lo"), F.max("_key").alias("hi"))


def _cuts(points: DataFrame, state: list[_Open], keys: int, slack: float) -> dict[int, tuple[int, int, int, int]]:
    """node -> (dim, last key that goes left, key that is cut or -1, rows of it that go left)."""
    done: dict[int, tuple[int, int, int, int]] = {}
    while state:
        open_of = {o.node: o for o in state}
        bins = _weights(points, state, keys)
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most BINS rows a node
        target = _values(points.sparkSession, [(o.node, max(1, round(o.target - o.below))) for o in state], ["_node", "_target"])
        found = (bins.withColumn("upto", upto).join(F.broadcast(target), F.col("node") == F.col("_node"))
                 .where((F.col("upto") >= F.col("_target")) & (F.col("upto") - F.col("w") < F.col("_target"))).collect())
        state = []
        for r in found:  # one row for each open node
            o = open_of[r["node"]]
            before = o.below + r["upto"] - r["w"]
            if r["w"] <= slack * o.shard_weight or r["lo"] == r["hi"] and r["n"] == 1:
                whole = before + r["w"] - o.target < o.target - before
                done[o.node] = (o.dim, r["hi"] if whole else r["lo"] - 1, -1, 0)
            elif r["lo"] == r["hi"]:
                left = min(r["n"], max(0, round((o.target - before) / r["size"])))
                done[o.node] = (o.dim, r["lo"] - 1, r["lo"], left)
            else:
                state.append(_Open(o.node, o.dim, r["lo"], r["hi"], before, o.target, o.shard_weight))
    return done


def _split(points: DataFrame, done: dict[int, tuple[int, int, int, int]], leaves: dict[int, int], keys: int) -> DataFrame:
    """Points with the children's node numbers; a group that a cut runs through becomes two points.
    Children are numbered by the first shard that they hold."""
    spark = points.sparkSession
    rows = [(node, *done[node], node + leaves[node] // 2) for node in done]
    c = _values(spark, rows, ["_node", "_dim", "_last", "_cut", "_left", "_right"])
    key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(keys)]), F.col("_dim").cast("int") + 1)
    j = points.join(F.broadcast(c), F.col("node") == F.col("_node"), "left").withColumn("_key", key)
    left = (F.when(F.col("_node").isNull() | (F.col("_key") <= F.col("_last")), F.col("n"))
            .when(F.col("_key") == F.col("_cut"), F.least("n", "_left")).otherwise(F.lit(0)))
    parts = F.array(F.struct(F.col("node").alias("node"), F.col("first").alias("first"), left.cast("long").alias("n")),
                    F.struct(F.coalesce("_right", "node").alias("node"), (F.col("first") + left).cast("long").alias("first"),
                             (F.col("n") - left).cast("long").alias("n")))
    parts = F.filter(parts, lambda p: p["n"] > 0)
    ks = [f"k{i}" for i in range(keys)]
    return j.select("gid", "size", F.explode(parts).alias("p"), *ks).select("gid", "size", "p.first", "p.n", *ks, "p.node")


def shard(docs: DataFrame, shards: int, slack: float = 0.005, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; sizes are UTF-8 bytes plus 16 (NULL text:
    none).  Shards hold near equal bytes.  Equal texts share a shard unless their group weighs more
    than ``slack`` of a shard and a cut runs through it.  Repeated rows and NULL ids keep a slot
    each; fewer groups than shards leave shards empty; an empty table gives an empty result; columns
    other than the four named are ignored."""
    spark = docs.sparkSession
    rows, points = groups(docs, id_col, text_col, lang_col, source_col)
    keys = sum(c[0] == "k" for c in points.columns)
    points = common.written(points.withColumn("node", F.lit(0).cast("long")), "shard-level")
    leaves = {0: shards}
    while any(k > 1 for k in leaves.values()):
        spread = [F.struct((F.max(f"k{i}") / F.lit(1 << 31) - F.min(f"k{i}") / F.lit(1 << 31)).alias("w"), F.lit(-i).alias("i"),
                           F.min(f"k{i}").alias("lo"), F.max(f"k{i}").alias("hi")) for i in range(keys)]
        stats = points.groupBy("node").agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.greatest(*spread).alias("widest")).collect()
        state = []
        for r in stats:  # at most a row for each shard
            k = leaves[r["node"]]
            if k > 1:
                state.append(_Open(r["node"], -r["widest"]["i"], r["widest"]["lo"], r["widest"]["hi"], 0,
                                   r["w"] * (k // 2) / k, r["w"] / k))
        if not state:
            break
        done = _cuts(points, state, keys, slack)
        points = common.written(_split(points, done, leaves, keys), "shard-level")
        leaves = {n: x for node, k in leaves.items() for n, x in
                  (((node, k // 2), (node + k // 2, k - k // 2)) if k > 1 else ((node, k),))}
    # rows of a group, in id order, go to its points' ranges
    cut = points.groupBy("gid").agg(F.count(F.lit(1)).alias("parts"), F.min("node").alias("shard"))
    parted = points.select(F.col("gid").alias("_gid"), "first", "n", F.col("node").alias("_shard"))
    # (written, for the numbering deals a large group over many tasks, and the join's tasks have it whole)
    located = common.written(rows.join(cut, "gid"), "shard-located")
    # only the few groups that a cut runs through need their rows numbered: at most one for each cut
    inner = number_within(located.where(F.col("parts") > 1).drop("shard"), "gid", ["id", "text_crc32"], "_at")
    inner = inner.join(parted, (F.col("gid") == F.col("_gid")) & (F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("first") + F.col("n")))
    names = [F.col("id").alias(id_col), "size", "text_crc32"]
    out = located.where(F.col("parts") == 1).select(*names, F.col("shard").cast("int").alias("shard")).unionByName(
        inner.select(*names, F.col("_shard").cast("int").alias("shard")))
    out = common.written(out, "shard-rows")
    return number_within(out, "shard", [id_col, "text_crc32"], "slot")
