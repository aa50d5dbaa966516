import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from embedframe.llm import ngram_join as J

from .conftest import WORDS, edge_rows, prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """id -> (n_shingles, smallest id reachable), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {i: lo if v == hi else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(seed, n, words=120):
    """Copies of copies with a few words changed, so that chains and bare misses occur."""
    r = random.Random(seed)
    made = [[r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(words)]]
    for _ in range(n - 1):
        c = list(r.choice(made))
        for _ in range(r.randint(0, 4)):
            c[r.randrange(len(c))] = f"new{r.randint(0, 10 ** 6)}"
        if r.random() < 0.2:
            del c[:r.randint(0, 20)]
        made.append(c)
    return [" ".join(m) for m in made]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.components(df).collect()}


def test_shingle_sets_count_and_overlap_like_words():
    texts = [t for _, t, *_ in edge_rows()] + ["A b C d", "a  B c\td", "a b c d e", "a\x0bb\x0cc\x1cd e f", *near_copies(1, 20)]
    sets = J.shingle_sets(texts)
    for (t, s), (u, v) in combinations(list(zip(texts, sets, strict=True)), 2):
        x, y = shingles(t), shingles(u)
        assert len(s) == len(x) and len(np.intersect1d(s, v)) == len(x & y)


def test_chunks_do_not_change_sets(monkeypatch):
    texts = [prose(i, 40) for i in range(30)] + ["", None, "x"]
    want = [s.tolist() for s in J.shingle_sets(texts)]
    monkeypatch.setattr(J, "CHUNK", 300)
    assert [s.tolist() for s in J.shingle_sets(texts)] == want


def test_prefixes_of_similar_sets_meet_under_every_order():
    rule, r = J.Rule(), np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(1, 200))
        x = r.integers(0, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[int(r.integers(0, n // 5 + 1)):], r.integers(0, 1 << 62, int(r.integers(0, n // 8 + 1))).astype(np.uint64)])
        if rule.similar(len(x), len(y), len(np.intersect1d(x, y))):
            for order in range(3):
                p, q = (J.prefix_of(s, order, int(rule.prefix(len(s)))) for s in (x, y))
                shared = len(np.intersect1d(p, q))
                assert shared >= min(rule.extra(len(x)), rule.extra(len(y))) >= rule.least_shared(max(len(x), len(y)))


def test_shared_postings_in_blocks():
    r = np.random.default_rng(1)
    key, node = r.integers(0, 50, 400), r.integers(0, 40, 400)
    held = defaultdict(set)
    for k, n in zip(key.tolist(), node.tolist(), strict=True):
        held[k].add(n)
    want = {(k, n) for k, ns in held.items() if len(ns) > 1 for n in ns}
    for block in (7, 60, 400):
        state, got = J._Shared(), set()
        for i in range(0, 400, block):
            k, n = state.add(key[i:i + block], node[i:i + block])
            got |= set(zip(k.tolist(), n.tolist(), strict=True))
        assert got == want


@pytest.mark.parametrize("cell", [500_000, 400])
def test_against_all_pairs(spark, monkeypatch, cell):
    """With tiny cells, families of near copies take the way over hubs and outsiders."""
    monkeypatch.setattr(J, "CELL_SHINGLES", cell)
    monkeypatch.setattr(J, "HUBS", 2)
    texts = near_copies(2, 60) + near_copies(3, 40, 30) + [prose(i, 50) for i in range(20)] + near_copies(2, 60)[:10]
    shared = " ".join(f"passage{i}" for i in range(55))
    texts += [f"{prose(500 + i, 90)} {shared} {prose(700 + i, 90)}" for i in range(25)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert len({v for _, v in want.values()}) < len(rows) - 30
    assert run(spark, rows) == want


def footer_rows(n, copies):
    """n texts of which one passage is a good half, and near copies of the first ``copies`` of them."""
    footer = [f"footer{i}" for i in range(66)]
    r, rows = random.Random(4), []
    for i in range(n):
        own = [f"w{r.randint(0, 10 ** 9)}" for _ in range(54)]
        rows.append((2 * i, " ".join(own + footer)))
        if i < copies:
            rows.append((2 * i + 1, " ".join([*own[2:], *footer])))
    return rows


def test_a_common_passage_holds_no_family_together(spark):
    """Of texts that share more than half their shingles, only the near copies are left in families, by twos."""
    rows = footer_rows(300, 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = J.document_nodes(docs, J.Rule(), "doc_id", "text")
    tokens = J.shingle_sets([t for _, t in rows])
    big = spark.createDataFrame([(J.node_id(t), len(t), t.tobytes()) for t in tokens], "node long, n long, tokens binary")
    node = {r["node"]: r["doc_id"] for r in sets.collect()}
    groups = defaultdict(set)
    for r in J.refined_families(big, J.Rule()).collect():
        groups[r["family"]].add(node[r["node"]])
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(20)]


def test_texts_with_a_common_passage_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL_SHINGLES", 3000)
    rows = footer_rows(150, 15)
    assert run(spark, rows) == brute(rows)


def test_a_group_of_copies_holds_most_rows(spark):
    rows = [(i, prose(7)) for i in range(400)] + [(1000 + i, prose(100 + i)) for i in range(20)]
    got = run(spark, rows)
    assert all(got[i][1] == 0 for i in range(400)) and all(got[1000 + i][1] == 1000 + i for i in range(20))


def test_edge_rows(spark, edge_docs, no_docs):
    rows = J.components(edge_docs).collect()
    assert len(rows) == len(edge_rows())
    want = brute([(r[0], r[1]) for r in edge_rows() if r[0] is not None])
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert next(r for r in rows if r["doc_id"] is None)["component_id"] is None
    assert J.components(no_docs).count() == 0
    assert J.components(spark.createDataFrame([(5, None)], "doc_id long, text string")).collect()[0]["n_shingles"] == 0
