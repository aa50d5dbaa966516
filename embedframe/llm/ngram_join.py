"""Self-join of texts on the Jaccard similarity of their word shingles, exact.

Texts with equal shingle sets are one *node*.  Then filters come before any pair is formed:

1. *Prefix under a global order.*  All shingles have a global order (of a hash).  Of a set of n
   shingles only the first n - ceil(t n) + l are kept; two sets of similarity t or more share at
   least min(l, l') of those.  Nodes whose prefix holds too few shingles that any other node's
   prefix holds have no partner.
2. *Order by rarity.*  What is left of a prefix is ordered by document frequency, and again only
   the first part can hold the rarest shingle of a similar pair, so passages that very many texts
   share drop out.  Nodes are joined to the smallest node of each shingle left, never to one
   another; the connected components are *families*, and every linked pair lies in one.  Large
   families go through this step again with whole sets: a node stays only if other nodes hold
   ceil(t n) of its shingles, and a pair must share one of the rarest of them, so a passage alone,
   however common, holds no family together.
3. *More global orders.*  Large families are cut into cells by set size (similar sets differ
   by 1/t at most) and bounded bytes.  Where two cells meet, a pair is a candidate only if it shares
   enough prefix shingles under every one of three orders, whose filters are intersected; only
   then are the whole sets compared.
4. *Links that can't change the result are skipped.*  Pairs that are already connected need no
   comparison.  Cells are compared within first, then with a few hubs of their family, and in
   the end all nodes outside their family's largest component with all nodes of similar size,
   so a family of many near copies costs about its size, and no link between different
   components is lost.

Prefixes travel as packed arrays, so there is a row for each batch and bucket, not for each
shingle.  Sets are identified by 64-bit hashes of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.learn import connected_components
from . import common

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F,
                   0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xD6E8FEB86659FD93], np.uint64)
_ORDERS = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)
CHUNK = 1 << 20
CELL_SHINGLES = 500_000
HUBS = 32


@dataclass(frozen=True)
class Rule:
    """Similarity threshold ``num/den`` and shingle length."""

    num: int = 80
    den: int = 100
    words: int = 5

    def need(self, n):
        """ceil(t n): the least overlap that a set of n shingles has with any similar set."""
        return -(-n * self.num // self.den)

    def extra(self, n):
        """l: a tenth of the set, so that a shared passage alone doesn't make a candidate."""
        return np.maximum(1, n // 10)

    def prefix(self, n):
        return np.minimum(n, n - self.need(n) + self.extra(n))

    def least_shared(self, n):
        """Least number of shared prefix shingles with any similar set, which has need(n) at least."""
        return self.extra(self.need(n))

    def similar(self, n, m, overlap):
        return self.den * overlap >= self.num * (n + m - overlap)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; a text of fewer words has one, of all
    its words; without words it has none."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t or "").encode("utf-8"))
        size += len(held[-1]) + 1
        if size >= CHUNK:
            out += _chunk_sets(held, words)
            held, size = [], 0
    return out + (_chunk_sets(held, words) if held else [])


def _chunk_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    x = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    power, inverse = _power(len(x) + 1)
    inside = _WORD[x]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends take turns
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[:len(x)], out=sums[1:])
    w = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _PLACE[7])
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate([[0], ends]))  # of each text, its first word
    n = len(w) - words + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(words):
            s += w[k:k + n] * _PLACE[k % 5] * np.uint64(2 * (k // 5) + 1)
        s = _mix(s)
    none = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(s[a:b - words + 1]))
        elif b > a:
            k = np.arange(b - a)
            whole = (w[a:b] * _PLACE[k % 5] * (2 * (k // 5) + 1).astype(np.uint64)).sum(dtype=np.uint64, keepdims=True)
            out.append(_mix(whole ^ _PLACE[5:6] * np.array([b - a], np.uint64)))
        else:
            out.append(none)
    return out


def node_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_of(tokens: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first ``length`` of the tokens under a global order."""
    if length >= len(tokens):
        return tokens
    return tokens[np.argpartition(_mix(tokens * _ORDERS[order]), length - 1)[:length]]


# --- nodes and families ---------------------------------------------------------------------------

def document_nodes(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, node); node is NULL without shingles."""
    def compute(texts: list[str | None]) -> list[pa.Array]:
        sets = shingle_sets(texts, rule.words)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_id(s) if len(s) else None for s in sets], pa.int64())]

    return common.with_columns(docs.select(id_col, text_col), [("n_shingles", T.LongType()), ("node", T.LongType())],
                               text_col, compute, carry=[id_col])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string").alias("_text"))


def packed_prefixes(docs: DataFrame, rule: Rule, buckets: int, text_col: str) -> DataFrame:
    """(bucket, packed): postings of the first order's prefixes, 13 bytes each (40 bits of the shingle,
    the node), sorted by shingle; the bucket is the shingle's low bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            tokens, nodes = [], []
            for s in shingle_sets(b.column(0).to_pylist(), rule.words):
                if len(s) and (node := node_id(s)) not in seen:
                    if len(seen) < 1_000_000:  # copies within a task travel once
                        seen.add(node)
                    p = prefix_of(s, 0, int(rule.prefix(len(s))))
                    tokens.append(p)
                    nodes.append(np.full(len(p), node, np.int64))
            if tokens:
                yield _packed(np.concatenate(tokens), np.concatenate(nodes), buckets)

    return _texts(docs, text_col).mapInArrow(run, "bucket long, packed binary")


def packed_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """(bucket, packed), as ``packed_prefixes`` gives them, of whole sets (node, tokens), each there once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                tokens = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
                node = np.repeat(b.column(0).to_numpy(), [len(x) for x in tokens])
                yield _packed(np.concatenate(tokens), node, buckets)

    return sets.select("node", "tokens").mapInArrow(run, "bucket long, packed binary")


def _packed(t: np.ndarray, o: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (t & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    t, o, bucket = t[order], o[order], bucket[order]
    packed = np.empty((len(t), 13), np.uint8)
    packed[:, :5] = (t >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    packed[:, 5:] = o.astype("<i8").view(np.uint8).reshape(-1, 8)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(t))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut], pa.int64()), pa.array([packed[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())],
        ["bucket", "packed"])


class _Shared:
    """Postings of the shingles that two nodes or more hold, from postings that arrive in blocks.
    Keeps one node for each distinct shingle of a bucket, so a shingle that very many nodes hold
    takes no more memory than another."""

    def __init__(self) -> None:
        self.key = np.zeros(0, np.int64)
        self.node = np.zeros(0, np.int64)
        self.told = np.zeros(0, bool)

    def add(self, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        head = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else np.zeros(0, int)
        count = np.diff(np.append(head, len(key)))
        at = np.searchsorted(self.key, key[head])
        known = np.zeros(len(head), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[head][inside]
        old = np.where(known, self.node[np.minimum(at, max(0, len(self.key) - 1))], node[head]) if len(self.key) else node[head]
        shared = (count > 1) | known & (old != node[head])
        take = np.repeat(shared, count)
        before = known & shared & ~(self.told[np.minimum(at, len(self.key) - 1)] if len(self.key) else known)
        out = (np.concatenate([key[take], key[head][before]]), np.concatenate([node[take], old[before]]))
        if len(self.key):
            self.told[at[known & shared]] = True
        new = ~known
        merged = np.concatenate([self.key, key[head][new]])
        order = np.argsort(merged, kind="stable")
        self.key = merged[order]
        self.node = np.concatenate([self.node, node[head][new]])[order]
        self.told = np.concatenate([self.told, shared[new]])[order]
        return out


def shared_postings(packed: DataFrame, parts: int, block: int = 2_000_000) -> DataFrame:
    """(token, node) of prefix shingles that two nodes or more hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, held, size = _Shared(), None, [], 0

        def flush() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 13)
            key = np.zeros((len(x), 8), np.uint8)
            key[:, :5] = x[:, :5]
            token = key.view("<i8").ravel() | (now << 40)
            k, n = state.add(token, np.ascontiguousarray(x[:, 5:]).view("<i8").ravel())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["token", "node"])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and (bucket != now or size > block * 13):
                    yield flush()
                    held, size = [], 0
                if bucket != now:
                    state, now = _Shared(), bucket
                held.append(data)
                size += len(data)
        if held:
            yield flush()

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "token long, node long")


def families(docs: DataFrame, nodes: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """(node, family) of the nodes that may have a partner; written."""
    parts, buckets = _buckets(docs)
    shared = common.written(shared_postings(packed_prefixes(docs, rule, buckets, text_col), parts), "join-shared")
    return _families(shared, nodes, F.greatest(F.lit(1), F.floor(_need(rule) / 10)))


def refined_families(sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, family) of the ``sets`` (node, n, tokens) that may have a partner among them, by whole sets.  A
    pair shares need(n) of the shingles that a node has in common with any other, at least one of them among
    the rarest; footers and other passages that do not fill so much of a set link nothing.  Written."""
    parts, buckets = _buckets(sets)
    shared = common.written(shared_postings(packed_sets(sets, buckets), parts), "join-shared")
    return _families(shared, sets.select("node", "n"), _need(rule))


def _buckets(df: DataFrame) -> tuple[int, int]:
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts, min(1 << 22, 1 << (4 * parts - 1).bit_length())


def _need(rule: Rule) -> Column:
    return F.floor((F.col("n") * rule.num + (rule.den - 1)) / rule.den)


def _families(shared: DataFrame, nodes: DataFrame, least: Column) -> DataFrame:
    """Components of the nodes that hold ``least`` (by n) shared shingles or more, over the rarest of these."""
    own = Window.partitionBy("node")  # a node's shingles are at most its prefix
    alive = (shared.join(nodes, "node").withColumn("least", least).withColumn("_all", F.count(F.lit(1)).over(own))
             .where(F.col("_all") >= F.col("least")).select("token", "node", "least"))
    postings = common.written(alive, "join-alive").repartition("token")  # one shuffle serves the two uses below
    held = postings.groupBy("token").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("df"))
    # Order by rarity: of r shared shingles, of which a similar set has ``least``, the r - least + 1 rarest
    # hold the rarest common one.
    kept = (postings.join(held.where("first < last").select("token", "first", "df"), "token")
            .withColumn("_rank", F.row_number().over(own.orderBy("df", "token"))).withColumn("_all", F.count(F.lit(1)).over(own))
            .where(F.col("_rank") <= F.col("_all") - F.col("least") + 1))
    links = kept.where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst")).distinct()
    links = common.written(links, "join-links")
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return common.written(connected_components(ends, links, "id").select(F.col("id").alias("node"), F.col("component").alias("family")),
                          "join-families")


# --- sets of the nodes in families -------------------------------------------------------------------

BLOOM_WORDS = 1 << 19


def _bloom(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (4 MB) over the nodes.  When very many nodes fill it, it lets more
    through, which the join behind it removes."""
    size = BLOOM_WORDS * 64
    both = F.array(F.pmod("node", F.lit(size)), F.pmod(F.shiftright("node", 25), F.lit(size)))
    bits = nodes.select(F.explode(both).alias("bit"))
    rows = (bits.groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) AS int))")).alias("mask")).toPandas())
    out = np.zeros(BLOOM_WORDS, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return out


def member_sets(docs: DataFrame, placed: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """``placed`` (node, and its cell) with ``tokens``, the whole set of every node, once; written."""
    bloom = common.broadcast_value(docs.sparkSession, np.unpackbits(_bloom(placed).view(np.uint8), bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = bloom.value, set()
        for b in batches:
            rows = []
            for s in shingle_sets(b.column(0).to_pylist(), rule.words):
                if len(s):
                    node = node_id(s)
                    if node not in seen and all(bits[p] for p in _positions(node)):
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        rows.append((node, s.tobytes()))
            if rows:
                node, tokens = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tokens, pa.binary())], ["node", "tokens"])

    found = _texts(docs, text_col).mapInArrow(run, "node long, tokens binary")
    return common.written(found.join(placed, "node").dropDuplicates(["node"]), "join-sets")


def _positions(node: int) -> tuple[int, int]:
    """Two bits of the Bloom filter: the node is a hash already."""
    return node % (BLOOM_WORDS * 64), (node >> 25) % (BLOOM_WORDS * 64)


# --- comparison of cells ----------------------------------------------------------------------------

class _Sets:
    """Sets of one task, as numbers of distinct tokens, with their prefixes under every order."""

    def __init__(self, blobs: list[bytes], rule: Rule):
        own = [np.frombuffer(x, np.uint64) for x in blobs]
        self.n = np.array([len(x) for x in own])
        self.extra = rule.extra(self.n)
        distinct, ids = np.unique(np.concatenate(own), return_inverse=True)
        self.ids = np.split(ids.astype(np.int32), np.cumsum(self.n)[:-1])
        self.mark = np.zeros(len(distinct), bool)
        lengths = rule.prefix(self.n).tolist()
        self.prefix = []
        for order in _ORDERS:
            key = _mix(distinct * order)
            self.prefix.append([x if k >= len(x) else x[np.argpartition(key[x], k - 1)[:k]] for x, k in zip(self.ids, lengths, strict=True)])

    def shared(self, one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
        """How many tokens of ``one`` each of ``many`` holds."""
        self.mark[one] = True
        at = np.cumsum([0, *map(len, many[:-1])])
        out = np.add.reduceat(self.mark[np.concatenate(many)], at, dtype=np.int64)
        self.mark[one] = False
        return out


def compare(left: list[tuple[int, int, bytes]], right: list[tuple[int, int, bytes]] | None, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect components: rows are (node, component, tokens).  ``right`` None: ``left`` with
    itself.  Pairs whose components are connected, from before or here, are passed over."""
    both = left + (right or [])
    if len(both) < 2:
        return []
    sets = _Sets([t for _, _, t in both], rule)
    codes = {c: i for i, c in enumerate(dict.fromkeys(c for _, c, _ in both))}
    group = np.array([codes[c] for _, c, _ in both])  # connected rows have one number
    out = []
    n = sets.n
    others = np.arange(len(left), len(both)) if right is not None else np.arange(len(left))
    for i in range(len(left)):
        js = others[(group[others] != group[i]) & (rule.den * np.minimum(n[others], n[i]) >= rule.num * np.maximum(n[others], n[i]))]
        if right is None:
            js = js[js > i]
        for prefix in sets.prefix:  # the filters of all orders are intersected
            if len(js):
                js = js[sets.shared(prefix[i], [prefix[j] for j in js]) >= np.minimum(sets.extra[js], sets.extra[i])]
        if not len(js):
            continue
        overlap = sets.shared(sets.ids[i], [sets.ids[j] for j in js])
        for j in js[rule.similar(n[i], n[js], overlap)].tolist():
            if group[i] != group[j]:
                out.append((both[i][0], both[j][0]))
                group[group == group[j]] = group[i]
    return out


def _compared(rows: DataFrame, keys: list[str], rule: Rule, own: bool) -> DataFrame:
    """(src, dst) of the groups of rows (keys, node, comp, tokens, side)."""
    def run(g: pa.RecordBatch) -> list[pa.Array] | None:
        side = g.column("side").to_numpy()
        both = list(zip(g.column("node").to_pylist(), g.column("comp").to_pylist(), g.column("tokens").to_pylist(), strict=True))
        split = int((side == 0).sum())
        if split == 0 or not own and split == len(both):
            return None
        found = compare(both[:split], None if own else both[split:], rule)
        return [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())] if found else None

    return common.written(common.by_group(rows.select(*keys, "node", "comp", "tokens", "side"), keys, ["side", "node"],
                                          "src long, dst long", run), "join-found")


def sized_families(fam: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, family, n, large); ``large``: the family has more than CELL_SHINGLES shingles.  Written."""
    sized = fam.join(nodes, "node")
    total = sized.groupBy("family").agg(F.sum("n").alias("total"))
    return common.written(sized.join(total, "family").select("node", "family", "n", (F.col("total") > CELL_SHINGLES).alias("large")), "join-sized")


def cells(sized: DataFrame, rule: Rule) -> DataFrame:
    """(node, family, cls, sub, cells, split).  ``cells``: where a node is compared first, as (window,
    part).  A family of up to CELL_SHINGLES shingles is one cell.  A larger one is cut by size class
    (similar sets are in the same class or the next), and each two neighbouring classes are a window; a
    window of too many shingles is cut further by a hash of the node, and then ``split`` marks the
    family, for which cells alone don't bring all similar sizes together.  ``cls`` and ``sub`` place a
    node by its own class."""
    cls = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(rule.den / rule.num))) + 1e-9).cast("long")
    sized = sized.withColumn("cls", F.when(F.col("large"), cls).otherwise(F.lit(0).cast("long")))

    def parts(by: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy("family", by).agg(F.ceil(F.sum("n") / CELL_SHINGLES).alias(f"{by}_parts"))

    windows = sized.withColumn("w", F.explode(F.when(F.col("large"), F.array("cls", F.col("cls") + 1)).otherwise(F.array(F.lit(0).cast("long")))))
    split = parts("w", windows).groupBy("family").agg((F.max("w_parts") > 1).alias("split"))
    part = F.pmod(F.xxhash64("node"), F.col("w_parts"))
    placed = windows.join(parts("w", windows), ["family", "w"]).groupBy("node", "family", "cls").agg(
        F.collect_list(F.struct("w", part.alias("part"))).alias("cells"))  # one or two
    placed = placed.join(parts("cls", sized), ["family", "cls"]).join(split, "family")
    return common.written(placed.withColumn("sub", F.pmod(F.xxhash64("node"), F.col("cls_parts"))).drop("cls_parts"), "join-cells")


def _components_of(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return connected_components(ends, links, "id").select(F.col("id").alias("node"), F.col("component").alias("comp"))


def node_components(docs: DataFrame, nodes: DataFrame, rule: Rule, text_col: str) -> DataFrame:
    """(node, comp) of the nodes with links: comp is the smallest node that links reach."""
    sets = member_sets(docs, sized_families(families(docs, nodes, rule, text_col), nodes), rule, text_col)
    cell = ["family", "cls", "sub"]
    zero = F.lit(0).cast("long")
    placed = ["node", "family", "tokens", "cells", "cls", "sub", "split"]
    whole = sets.where("not large").select("node", "family", "tokens", F.array(F.struct(zero.alias("w"), zero.alias("part"))).alias("cells"),
                                           zero.alias("cls"), zero.alias("sub"), F.lit(False).alias("split"))
    big = sets.where("large").drop("large", "family")
    if big.isEmpty():
        sets = whole
    else:
        where = cells(sized_families(refined_families(big, rule), big.select("node", "n")), rule)
        sets = whole.unionByName(big.drop("n").join(where, "node").select(*placed))
    first = sets.select("family", F.explode("cells").alias("_c"), "node", F.col("node").alias("comp"), "tokens", F.lit(0).alias("side"))
    links = _compared(first.select("family", "_c.w", "_c.part", "node", "comp", "tokens", "side"), ["family", "w", "part"], rule, own=True)
    large = common.written(sets.where("split").select("node", *cell), "join-large")
    if large.isEmpty():
        return _components_of(links)
    tokens = sets.where("split").select("node", "tokens")

    def with_components(links: DataFrame) -> DataFrame:
        return common.written(large.join(_components_of(links), "node", "left").withColumn("comp", F.coalesce("comp", "node")), "join-now")

    # with hubs of the family: a few nodes of each size class.  Rows are placed without their sets.
    now = with_components(links)
    hubs = (now.withColumn("_rank", F.row_number().over(Window.partitionBy("family", "cls").orderBy(F.xxhash64("node"), "node")))
            .where(F.col("_rank") <= HUBS).drop("_rank", "sub"))
    to = hubs.withColumn("_cls", F.col("cls")).drop("cls").withColumn("cls", F.explode(F.array(*[F.col("_cls") + d for d in (-1, 0, 1)])))
    to = to.join(large.select(*cell).distinct(), ["family", "cls"]).select(*cell, "node", "comp", F.lit(1).alias("side"))
    rows = now.select(*cell, "node", "comp", F.lit(0).alias("side")).unionByName(to)
    links = links.unionByName(_compared(rows.join(tokens, "node"), cell, rule, own=False))
    # the nodes outside their family's largest component with all nodes of similar size
    now = with_components(links)
    counts = now.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("largest"))
    a = now.join(largest, "family").where("comp <> largest").select("family", F.col("cls").alias("c1"), F.col("sub").alias("s1"), "node", "comp")
    own = now.select("family", F.col("cls").alias("c2"), F.col("sub").alias("s2"), "node", "comp")
    meet = (a.select("family", "c1", "s1").distinct().join(own.select("family", "c2", "s2").distinct(), "family")
            .where(F.abs(F.col("c1") - F.col("c2")) <= 1))
    keys = ["family", "c1", "s1", "c2", "s2"]
    rows = (a.join(meet, ["family", "c1", "s1"]).select(*keys, "node", "comp", F.lit(0).alias("side"))
            .unionByName(own.join(meet, ["family", "c2", "s2"]).select(*keys, "node", "comp", F.lit(1).alias("side"))))
    return _components_of(links.unionByName(_compared(rows.join(tokens, "node"), keys, rule, own=False)))


def components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links of similarity
    ``rule.num / rule.den`` or more reach.

    NULL and empty texts and texts without words have no shingles and are alone.  Rows with equal
    ids are one document; rows with a NULL id take part, and their component is NULL where no
    other id is in it.  Other columns are ignored; an empty table gives an empty result."""
    own = common.written(document_nodes(docs, rule, id_col, text_col), "join-documents")
    classes = common.written(own.where("node is not null").groupBy("node").agg(
        F.min(id_col).alias("first_id"), F.max("n_shingles").alias("n")), "join-nodes")
    comps = node_components(docs, classes.select("node", "n"), rule, text_col)
    comps = common.written(comps, "join-components")
    smallest = comps.join(classes, "node").groupBy("comp").agg(F.min("first_id").alias("least_id"))
    labels = (classes.join(comps.join(smallest, "comp").select("node", "least_id"), "node", "left")
              .select("node", F.coalesce("least_id", "first_id").alias("component_id")))
    return own.join(labels, "node", "left").select(
        id_col, "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"))
