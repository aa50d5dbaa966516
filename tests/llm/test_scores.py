import math

import numpy as np
from pyspark.sql import functions as F

from embedframe.llm import quality, queries, toxicity
from embedframe.llm.common import table

from ..conftest import SF01
from .conftest import edge_rows, prose


def grammar():
    return toxicity.Grammar({"idiot": 5.0}, {"blark": 4.0})


def test_clauses_in_context():
    g = grammar()
    score = lambda t: max(g.clauses(t), default=0.0)
    plain = score("what an idiot")
    assert plain == 5.0 and score("some blarkish thing") == 4.0 and score("idi blar") == 0
    assert score("you are an idiot") == 1.25 * plain
    assert score("they are not idiot") == 0.5 * plain
    assert score("he said that idiot") == 0.6 * plain
    assert score("not you. idiot") == plain  # a clause ends the effect
    # a target strengthens what stands before it, too, and only once
    assert score("you kill") == score("kill you") == score("you kill you") == score("I will kill you") == 1.5
    assert score("töte dich") == score("you will be killed") == score("je vais te tuer") == 1.5
    assert score("idiot, you") == 1.25 * plain and score("kill it") == 1.0 and score("kill. you") == 1.0
    assert score("kill a b c you") == 1.5 and score("kill a b c d you") == 1.0
    assert score("a stable shop") == 0 and score("I will not kill you") == 0.75
    assert list(g.clauses("idiot, idiot! fine; blarks")) == [10.0, 4.0]


def test_composition_is_the_product_of_its_parts():
    parts = [toxicity.insult_machine(), toxicity.threat_machine(), toxicity.target_machine(), toxicity.negation_machine(), toxicity.reported_machine()]
    whole = toxicity.compose(parts)
    r = np.random.default_rng(2)
    for _ in range(100):
        at, states = 0, [0] * len(parts)
        for c in r.integers(0, 12, 12).tolist():
            at, factor = whole.steps[at][c]
            moves = [m.steps[s][c] for m, s in zip(parts, states, strict=True)]
            states = [s for s, _ in moves]
            assert factor == math.prod(f for _, f in moves)


def test_clause_scores_against_the_rules_word_by_word():
    """Each word's factor from the rules as stated, looking left and right in its clause."""
    g, r = grammar(), np.random.default_rng(8)
    vocabulary = ["idiot", "blarks", "kill", "you", "not", "said", "a", "b", "c", "d", "."]
    kinds = {"idiot": (toxicity.INSULT, 5.0), "blarks": (toxicity.INSULT, 4.0), "kill": (toxicity.THREAT, 1.0)}
    for _ in range(300):
        words = r.choice(vocabulary, int(r.integers(1, 25))).tolist()
        want = []
        for clause in " ".join(words).split("."):
            ws, total = clause.split(), 0.0
            for i, w in enumerate(ws):
                if w in kinds:
                    kind, weight = kinds[w]
                    near = "you" in ws[max(0, i - 4):i] or "you" in ws[i + 1:i + 5]
                    total += (weight * ((1.5 if kind == toxicity.THREAT else 1.25) if near else 1.0)
                              * (0.5 if "not" in ws[max(0, i - 2):i] else 1.0) * (0.6 if "said" in ws[:i] else 1.0))
            if total:
                want.append(total)
        assert np.allclose(list(g.clauses(" ".join(words))), want)


def test_labelled_sample_holds_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, toxic int")
    got = toxicity.common.labelled_sample(docs, labels, "toxic", F.lit(True), 10)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, "a"), (2, 0, "")]


def test_lexicon_finds_words_and_stems_not_copies():
    texts, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        extra = ["idiot", f"blarq{'abcdefgh'[i % 8]}{i % 5}"] if toxic else []
        texts.append(" ".join([prose(i, 40), *extra]))
        labels.append(int(toxic))
    texts += [prose(9000, 60) + " oddword"] * 40  # one text in forty copies is one piece of evidence
    labels += [1] * 40
    words = toxicity.word_sets(texts)
    found, stems = toxicity.learn_lexicon(words, toxicity.near_copies(texts), labels)
    assert set(found) == {"idiot"} and set(stems) == {"blarq"}
    assert toxicity.learn_lexicon(words, list(range(len(words))), [0] * len(words)) == ({}, {})


def test_toxicity_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.classify(edge_docs, labels, F.lit(True)).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows} <= {0, 1}
    assert toxicity.classify(no_docs, labels, F.lit(True)).count() == 0
    assert toxicity.classify(edge_docs, labels.limit(0), F.lit(True)).agg(F.sum("predicted")).first()[0] == 0


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_toxicity_held_out(spark):
    out = queries.op2_toxicity(spark, SF01).join(table(spark, SF01, "labels"), "doc_id").where("held_out").collect()
    assert auc([(r["score"], r["toxic"]) for r in out]) > 0.75
    assert np.mean([r["predicted"] for r in out if not r["toxic"]]) < 0.05


def test_isotonic_against_all_splits():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 8))
        y, w = r.random(n), r.integers(1, 5, n).astype(float)
        got = quality.isotonic(y, w)
        assert (np.diff(got) >= -1e-12).all()
        best = math.inf
        for cut in range(1 << (n - 1)):  # every partition into runs, where their means are sorted
            edges = [0, *[i + 1 for i in range(n - 1) if cut >> i & 1], n]
            means = [np.average(y[a:b], weights=w[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            if all(p <= q for p, q in zip(means, means[1:], strict=False)):
                best = min(best, sum(((y[a:b] - m) ** 2 * w[a:b]).sum() for a, b, m in zip(edges, edges[1:], means, strict=False)))
        assert ((y - got) ** 2 * w).sum() <= best + 1e-9


def test_normal_equations_equal_one_solve(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, quality.N_STATS))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(int)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x, strict=True)], "label int, stats array<double>").repartition(7)
    model = quality.fit(df, n_features=32)
    a = model.features(x)
    beta = np.linalg.solve(a.T @ a + 1e-3 * len(x) / a.shape[1] * np.eye(a.shape[1]), a.T @ y)
    assert np.allclose(model.raw(x), a @ beta, atol=1e-6)
    p = model.probability(x)
    assert 0 <= p.min() and p.max() <= 1 and auc(list(zip(p, y, strict=True))) > 0.9


def test_kernel_approximation():
    r = np.random.default_rng(5)
    x, width = r.normal(size=(20, quality.N_STATS)), 6.0
    w, b = r.normal(0, 1 / width, (quality.N_STATS, 20_000)), r.uniform(0, 2 * math.pi, 20_000)
    f = np.cos(x @ w + b) * math.sqrt(2 / 20_000)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * width ** 2))
    assert np.abs(f @ f.T - exact).max() < 0.05


def test_quality_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    rows = quality.classify(edge_docs, labels, F.lit(True)).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(no_docs, labels, F.lit(True)).count() == 0
    assert quality.classify(edge_docs, labels.limit(0), F.lit(True)).agg(F.min("score")).first()[0] == 1


def test_quality_held_out(spark):
    out = queries.op4_quality(spark, SF01).join(table(spark, SF01, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95
