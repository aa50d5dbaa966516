"""Density clustering and classification on vectors.

Density clusters follow the DBSCAN* reading of HDBSCAN at one radius ε:

* core distance = distance to the m-th nearest neighbour (``knn``, self excluded);
* two core points (core ≤ ε) are linked when their distance is ≤ ε, i.e. when their mutual
  reachability max(core_a, core_b, d) is ≤ ε;
* clusters are the connected components with at least ``min_size`` points; all other
  points are noise (−1).  A cluster is named by its smallest member id.

The ε-links are found exactly, without listing them: each (block, block) task of
``knn.blocked_cogroup`` computes its distances a tile at a time, finds the connected components of its
local ε-graph with numpy and emits one (node, local root) row per node — a spanning star per
local component.  Those stars connect exactly the same nodes as the full ε-graph, with at
most 2·block_rows rows per task however dense a cluster is.  The global components come from
min-label propagation with pointer jumping, a reliable ``checkpoint`` each round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, reliable_checkpoint
from . import knn as K


PIVOTS = 16


def core_distance(df: DataFrame, m: int, id_col: str = "vec_id", vec_col: str = "embedding",
                  block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    """(id, core): Euclidean distance to the m-th nearest other row (rounded to 6 decimals)."""
    nn = K.knn(df, df, m, "euclidean", id_col=id_col, vec_col=vec_col, block_rows=block_rows, pivots=PIVOTS)
    return nn.where(F.col("rank") == m).select(F.col("query_id").alias(id_col), (-F.col("similarity")).alias("core"))


def near_pairs(q: np.ndarray, c: np.ndarray, eps: float, joined=None):
    """(i, j) places of pairs with a rounded Euclidean distance of at most ``eps``, a tile at a time.  Inner products decide
    all but the pairs near ``eps``, whose distance is taken from differences.  ``joined`` gives the labels of both sides so far: where
    most of a tile has one label, only its pairs with a row of another label are looked at."""
    centre = c.mean(0)
    x, y = q - centre, c - centre
    half_q, half_c = np.einsum("ij,ij->i", x, x) / 2, np.einsum("ij,ij->i", y, y) / 2

    def near(own: np.ndarray, other: np.ndarray):
        size = half_q[own, None] + half_c[None, other]
        d2 = 2.0 * (size - x[own] @ y[other].T)
        slack = 1e-13 * size.max()
        i, j = np.divmod(np.flatnonzero(d2 <= max(eps + 6e-7, 0.0) ** 2 + slack), d2.shape[1])
        unsure = np.flatnonzero(d2[i, j] > max(eps - 6e-7, 0.0) ** 2 - slack)
        if len(unsure):
            d = -K._round_half_up(K.pair_similarity(q, c, own[i[unsure]], other[j[unsure]], "euclidean"))
            i, j = np.delete(i, unsure[d > eps]), np.delete(j, unsure[d > eps])
        return own[i], other[j]

    for a in range(0, len(q), K.TILE_QUERIES):
        for b in range(0, len(c), K.TILE_ROWS):
            own, other = np.arange(a, min(a + K.TILE_QUERIES, len(q))), np.arange(b, min(b + K.TILE_ROWS, len(c)))
            parts = [(own, other)]
            if joined is not None:
                label_q, label_c = (label[at] for label, at in zip(joined(), (own, other), strict=True))
                most = np.partition(label_q, len(own) // 2)[len(own) // 2]
                apart_q, apart_c = label_q != most, label_c != most
                if apart_q.sum() * len(other) + (~apart_q).sum() * apart_c.sum() < len(own) * len(other) // 2:
                    parts = [(own[apart_q], other), (own[~apart_q], other[apart_c])]
            for some, others in parts:
                if len(some) and len(others):
                    yield near(some, others)


def _local_star(eps: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"src": pd.Series([], dtype="int64"), "dst": pd.Series([], dtype="int64")})
        if len(left) == 0 or len(right) == 0 or left["_qb"].iloc[0] > right["_cb"].iloc[0]:
            return empty  # the same two blocks meet once more
        qid = left["_qid"].to_numpy().astype(np.int64)
        cid = right["_cid"].to_numpy().astype(np.int64)
        nodes, inv = np.unique(np.concatenate([qid, cid]), return_inverse=True)
        qi, ci = inv[: len(qid)], inv[len(qid):]
        label = np.arange(len(nodes))
        for rows, cols in K.same_length(left["_qv"], right["_cv"]):
            joined = lambda: (label[qi[rows]], label[ci[cols]])  # noqa: B023, E731 - the labels of the moment
            for i, j in near_pairs(K._stack(left["_qv"].iloc[rows]), K._stack(right["_cv"].iloc[cols]), eps, joined):
                a, b = qi[rows[i]], ci[cols[j]]
                apart = label[a] != label[b]
                a, b = label[a[apart]], label[b[apart]]
                changed = len(a) > 0
                while changed:  # min-label propagation over the edges between labels, with pointer jumping
                    new = label.copy()
                    np.minimum.at(new, a, label[b])
                    np.minimum.at(new, b, label[a])
                    new = new[new]
                    changed = not np.array_equal(new, label)
                    label = new
        while not np.array_equal(label, label[label]):
            label = label[label]
        keep = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.DataFrame({"src": nodes[keep], "dst": nodes[label[keep]]})

    return run


def eps_links(points: DataFrame, eps: float, id_col: str = "vec_id", vec_col: str = "embedding",
              block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    """(src, dst) rows whose connected components equal those of the ε-graph of ``points``.  Both sides have the same blocks
    (``spread`` 1), or pairs of blocks that count as met would not meet; at least eight where they keep 1024 rows."""
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
    points = K.usable(points, vec_col)
    block_rows = min(block_rows, max(1024, -(-points.count() // 8)))
    return K.blocked_cogroup(points, points, _local_star(eps), schema, id_col=id_col, vec_col=vec_col,
                             block_rows=block_rows, spread=1)


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id", max_rounds: int | None = None) -> DataFrame:
    """(id, component) with component = smallest id in the component.

    Each round: every node takes the smallest label among itself and its neighbours (a
    grouped ``min`` with partial aggregation), then jumps to its label's label.  Labels are
    checkpointed to the shared checkpoint folder each round, so lineage stays one round deep
    and a lost executor recomputes at most one round.  Rounds continue until no label
    changes (an explicit ``max_rounds`` raises instead of returning partial components).
    """
    checkpoint_dir(nodes.sparkSession)
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b"))
    e = reliable_checkpoint(e)
    labels = reliable_checkpoint(nodes.select(F.col(id_col).cast("long").alias("id")).distinct().withColumn("label", F.col("id")))
    rounds = 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")
        rounds += 1
        nb = e.join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b") \
              .groupBy("a").agg(F.min("lb").alias("m"))
        step = labels.join(nb.withColumnRenamed("a", "id"), "id", "left") \
                     .select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = step.alias("x").join(step.select(F.col("id").alias("lid"), F.col("label").alias("ll")),
                                    F.col("x.label") == F.col("lid"), "left") \
                   .select(F.col("x.id").alias("id"), F.col("x.old").alias("old"),
                           F.least(F.col("x.label"), F.coalesce("ll", "x.label")).alias("label"))
        new = reliable_checkpoint(jump)
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("id", "label")
        if changed == 0:
            break
    return labels.select(F.col("id").alias(id_col), F.col("label").alias("component"))


def density_clusters(df: DataFrame, eps: float, m: int = 5, min_size: int = 5, id_col: str = "vec_id",
                     vec_col: str = "embedding", block_rows: int = K.BLOCK_ROWS, core: DataFrame | None = None) -> DataFrame:
    """(id, cluster, core): cluster = smallest member id, −1 for noise."""
    core = core if core is not None else core_distance(df, m, id_col, vec_col, block_rows)
    core = reliable_checkpoint(core)
    pts = df.join(core.where(F.col("core") <= eps).select(id_col), id_col, "left_semi")
    comps = components_at(pts, core, eps, id_col, vec_col, block_rows)
    return label_clusters(df.select(id_col), comps, core, min_size, id_col)


def components_at(points: DataFrame, core: DataFrame, eps: float, id_col: str, vec_col: str,
                  block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    links = eps_links(points, eps, id_col, vec_col, block_rows)
    return connected_components(points.select(F.col(id_col).alias("id")), links, "id") \
        .withColumnRenamed("id", id_col)


def label_clusters(ids: DataFrame, comps: DataFrame, core: DataFrame, min_size: int, id_col: str) -> DataFrame:
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    c = comps.join(sizes, "component").select(
        id_col, F.when(F.col("_n") >= min_size, F.col("component")).otherwise(F.lit(-1)).alias("cluster"))
    return ids.join(c, id_col, "left").join(core, id_col, "left").select(
        id_col, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), "core")


def cluster_sweep(comps: DataFrame, ids: DataFrame, min_sizes: Sequence[int], id_col: str = "vec_id") -> DataFrame:
    """Cluster counts for several minimum sizes from one set of components: the component
    size table (one row per component) is expanded by the parameter list."""
    total = ids.agg(F.count(F.lit(1))).scalar()
    sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    ex = sizes.withColumn("min_size", F.explode(F.array(*[F.lit(int(s)) for s in min_sizes])))
    agg = ex.groupBy("min_size").agg(
        F.sum(F.when(F.col("n") >= F.col("min_size"), 1).otherwise(0)).cast("long").alias("n_clusters"),
        F.sum(F.when(F.col("n") >= F.col("min_size"), F.col("n")).otherwise(0)).cast("long").alias("n_clustered"))
    return agg.select("min_size", "n_clusters", "n_clustered", (total - F.col("n_clustered")).alias("n_noise"))


def assign_clusters(new_rows: DataFrame, clustered: DataFrame, vectors: DataFrame, id_col: str = "vec_id",
                    vec_col: str = "embedding", block_rows: int = K.BLOCK_ROWS) -> DataFrame:
    """Label new rows by their nearest clustered core point; probability = min(1, core/dist).  A new row
    that equals a member, or has its id, meets that member like any other."""
    members = vectors.join(clustered.where(F.col("cluster") >= 0).select(id_col, "cluster", "core"), id_col)
    nn = K.knn(new_rows, members, 1, "euclidean", id_col=id_col, vec_col=vec_col, block_rows=block_rows, exclude_self=False, pivots=PIVOTS)
    j = nn.join(members.select(F.col(id_col).alias("neighbor_id"), "cluster", "core"), "neighbor_id")
    dist = -F.col("similarity")
    prob = F.when(dist <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("core") / dist))
    return j.select(F.col("query_id").alias(id_col), "cluster", F.round(prob, 6).alias("probability"))


# --- classification ---------------------------------------------------------------------------

def _features(df: DataFrame, vec_col: str, dim: int | None) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    from ..functions import vectors as V
    v = V.truncate_renorm(vec_col, dim) if dim else V.as_double(vec_col)
    return df.withColumn("features", array_to_vector(v))


def classifier_fit_predict(train: DataFrame, test: DataFrame, vec_col: str, label_col: str, dim: int | None = None,
                           model: str = "logistic", hidden: int = 32, seed: int = 0, max_iter: int = 100) -> DataFrame:
    """Fit a classification head on (truncated, renormalised) embeddings and predict ``test``.

    ``logistic``: multinomial logistic regression; ``mlp``: one sigmoid hidden layer (Spark ML
    has no dropout or tanh layer).  Training is Spark ML's distributed optimiser."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    tr = _features(train, vec_col, dim).withColumn("label", F.col(label_col).cast("double"))
    te = _features(test, vec_col, dim)
    if model == "logistic":
        est = LogisticRegression(family="multinomial", maxIter=max_iter, featuresCol="features", labelCol="label")
    elif model == "mlp":
        n_in = dim or len(tr.select(vec_col).first()[0])
        n_out = tr.agg(F.max("label")).first()[0]
        est = MultilayerPerceptronClassifier(layers=[n_in, hidden, int(n_out) + 1], seed=seed, maxIter=max_iter,
                                             featuresCol="features", labelCol="label")
    else:
        raise ValueError(f"unknown model {model!r}; expected 'logistic' or 'mlp'")
    fitted = est.fit(tr)
    return fitted.transform(te).withColumn("prediction", F.col("prediction").cast("int")).drop("features",
                                                                                               "rawPrediction",
                                                                                               "probability")


# --- density hierarchy (discretised excess-of-mass selection) -----------------------------------

def density_hierarchy(df: DataFrame, eps_ladder: Sequence[float], m: int = 5, min_size: int = 5,
                      id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = K.BLOCK_ROWS,
                      core: DataFrame | None = None) -> DataFrame:
    """(id, cluster): clusters chosen from a ladder of radii by excess of mass
    (Campello, Moulavi, Sander 2013), on a discretised hierarchy.

    * For each ε of the ladder (largest first, λ = 1/ε) the components of the mutual
      reachability graph with ≥ ``min_size`` points are computed (``components_at``).
    * A component whose parent (the component holding it one step up) has exactly one such
      child continues the parent's cluster; two or more children are new clusters.
    * stability(C) = Σ over its points of (λ at which the point leaves C − λ at C's birth).
    * Bottom-up, a cluster is kept when its stability is at least the sum of what its
      children keep; the root (a single top component) is never kept.  Points outside the
      kept clusters are −1; a kept cluster is named by the smallest id at its birth.

    Every step is a join or grouped aggregation; the cluster tree itself has at most
    (rows / min_size) nodes per step.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    ladder = sorted({float(e) for e in eps_ladder}, reverse=True)
    lam = [1.0 / e for e in ladder]
    n_levels = len(ladder)
    core = reliable_checkpoint((core if core is not None else core_distance(df, m, id_col, vec_col, block_rows)))
    memb = None
    for level, eps in enumerate(ladder):
        pts = df.join(core.where(F.col("core") <= eps).select(id_col), id_col, "left_semi")
        comps = components_at(pts, core, eps, id_col, vec_col, block_rows)
        sizes = comps.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        keep = comps.join(sizes.where(F.col("_n") >= min_size), "component").select(
            F.col(id_col).alias("id"), F.lit(level).alias("level"), F.col("component").alias("comp"))
        keep = reliable_checkpoint(keep)
        memb = keep if memb is None else memb.unionByName(keep)
    memb = reliable_checkpoint(memb)

    # parent component one level up, children counts
    up = memb.select("id", (F.col("level") + 1).alias("level"), F.col("comp").alias("pcomp"))
    links = memb.join(up, ["id", "level"]).select("level", "comp", "pcomp").distinct()
    n_children = links.groupBy((F.col("level") - 1).alias("plevel"), "pcomp").agg(F.count(F.lit(1)).alias("nch"))
    comps_all = memb.select("level", "comp").distinct()
    roots = comps_all.where(F.col("level") == 0)
    single_root = roots.count() == 1

    # cluster id per component, level by level: continue the parent's cluster when it is the only child
    cid = roots.select("level", "comp", F.col("level").alias("blevel"), F.col("comp").alias("bcomp"))
    cid = reliable_checkpoint(cid)
    all_cid = cid
    parent_of = {}
    for level in range(1, n_levels):
        nch = n_children.select(F.col("plevel").alias("_pl"), F.col("pcomp").alias("_pc"), "nch")
        cur = (links.where(F.col("level") == level)
               .join(nch, (F.col("_pl") == level - 1) & (F.col("pcomp") == F.col("_pc")))
               .select("comp", "pcomp", "nch"))
        prev = cid.select(F.col("comp").alias("pcomp"), F.col("blevel").alias("pb"), F.col("bcomp").alias("pbc"))
        cur = cur.join(prev, "pcomp")
        cid = cur.select(F.lit(level).alias("level"), "comp",
                         F.when(F.col("nch") == 1, F.col("pb")).otherwise(F.lit(level)).alias("blevel"),
                         F.when(F.col("nch") == 1, F.col("pbc")).otherwise(F.col("comp")).alias("bcomp"),
                         F.when(F.col("nch") == 1, F.lit(None)).otherwise(F.col("pb")).alias("par_b"),
                         F.when(F.col("nch") == 1, F.lit(None)).otherwise(F.col("pbc")).alias("par_c"))
        cid = reliable_checkpoint(cid)
        parent_of[level] = cid.where(F.col("par_b").isNotNull()).select("blevel", "bcomp", "par_b", "par_c").distinct()
        all_cid = all_cid.unionByName(cid.select("level", "comp", "blevel", "bcomp"))
    all_cid = reliable_checkpoint(all_cid)

    # stability per cluster (blevel, bcomp)
    lam_at = F.element_at(F.array(*[F.lit(x) for x in lam]), F.col("_lvl") + 1)
    pm = memb.join(all_cid, ["level", "comp"]).groupBy("id", "blevel", "bcomp").agg(F.max("level").alias("last"))
    pm = pm.withColumn("_lvl", F.least(F.col("last") + 1, F.lit(n_levels - 1))).withColumn("lam_leave", lam_at)
    pm = pm.withColumn("_lvl", F.col("blevel")).withColumn("lam_birth", lam_at)
    stab = pm.groupBy("blevel", "bcomp").agg(F.sum(F.col("lam_leave") - F.col("lam_birth")).alias("stability"))
    tree = None
    for level, par in parent_of.items():
        tree = par if tree is None else tree.unionByName(par)
    nodes = stab.join(tree, ["blevel", "bcomp"], "left") if tree is not None else \
        stab.withColumn("par_b", F.lit(None).cast("int")).withColumn("par_c", F.lit(None).cast("long"))
    nodes = reliable_checkpoint(nodes.select("blevel", "bcomp", "stability", "par_b", "par_c"))
    is_root = (F.col("blevel") == 0) & F.lit(single_root)

    # bottom-up (deepest birth level first): value = own stability if kept, else the children's sum
    vals = None
    for b in reversed(range(n_levels)):
        cur = nodes.where(F.col("blevel") == b)
        if vals is not None:
            kids = (vals.join(nodes.select("blevel", "bcomp", "par_b", "par_c"), ["blevel", "bcomp"])
                    .where(F.col("par_b").isNotNull())
                    .groupBy(F.col("par_b").alias("blevel"), F.col("par_c").alias("bcomp"))
                    .agg(F.sum("value").alias("_cv"), F.count(F.lit(1)).alias("_nk")))
            cur = cur.join(kids, ["blevel", "bcomp"], "left")
        else:
            cur = cur.withColumn("_cv", F.lit(None).cast("double")).withColumn("_nk", F.lit(None).cast("long"))
        keep = (~is_root) & (F.col("_nk").isNull() | (F.col("stability") >= F.col("_cv")))
        step = cur.select("blevel", "bcomp", keep.alias("keep_self"),
                          F.when(keep, F.col("stability")).otherwise(F.coalesce("_cv", F.lit(0.0))).alias("value"))
        vals = step if vals is None else vals.unionByName(step)
        vals = reliable_checkpoint(vals)

    # top-down: a cluster is selected when it keeps itself and no ancestor is selected
    state = None
    for b in range(n_levels):
        cur = vals.where(F.col("blevel") == b).join(nodes.select("blevel", "bcomp", "par_b", "par_c"), ["blevel", "bcomp"])
        if state is not None:
            par = state.select(F.col("blevel").alias("par_b"), F.col("bcomp").alias("par_c"),
                               (F.col("blocked") | F.col("selected")).alias("_pblock"))
            cur = cur.join(par, ["par_b", "par_c"], "left")
        else:
            cur = cur.withColumn("_pblock", F.lit(False))
        blocked = F.coalesce(F.col("_pblock"), F.lit(False))
        step = cur.select("blevel", "bcomp", blocked.alias("blocked"), (F.col("keep_self") & ~blocked).alias("selected"))
        state = step if state is None else state.unionByName(step)
        state = reliable_checkpoint(state)
    sel = state.where(F.col("selected")).select("blevel", "bcomp")
    labelled = memb.join(all_cid, ["level", "comp"]).join(sel, ["blevel", "bcomp"]).select(
        F.col("id").alias(id_col), F.col("bcomp").alias("cluster")).distinct()
    return df.select(id_col).join(labelled, id_col, "left").select(
        id_col, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
