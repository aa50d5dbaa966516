"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as a string of word classes: insult, threat, target ("you"), negation, reported
speech, other.  A first machine reads it from the right and marks words that a target follows within
reach, so "kill you" is told like "you kill".  Five small transducers then read classes and marks
from the left and give every word a factor:

* ``insult`` lets insult and threat words through with their learned weight;
* ``threat`` strengthens a threat within a few words of a target, before or after it;
* ``target`` strengthens an insult the same way;
* ``negation`` weakens what follows a negation within a few words;
* ``reported`` weakens what follows a verb of saying in the same clause.

``compose`` builds their product, one deterministic machine: its states are tuples of the
parts' states and its factors the products of theirs.  A clause scores the sum of its factors
times word weights; a document's features are its best clause, the sum of its clauses and how
many of them match, and a logistic curve turns those into a probability.

Insult words are learned from labelled texts, as whole words or as stems (prefixes), which also
match words never seen.  A stem is kept if it occurs in enough *distinct* toxic documents (near
copies count once) and hardly ever in others.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .ngram_join import shingle_sets

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED = range(6)

#: Closed word classes of the grammar, in the languages of the corpus.
TARGETS = "you your yours yourself u tu toi vous votre ton du dich dir ihr euch sie tú ti usted ustedes vosotros te".split()
NEGATIONS = "not no never neither nor isn aren wasn don doesn didn pas jamais ni nicht kein keine nie niemals nunca ni tampoco".split()
REPORTS = "said says say told called calls wrote quoted dit disait dites sagte sagt schrieb dijo dice dijeron escribió".split()
#: Threats as whole words, and as stems of their other forms.
THREATS = ("hurt hurts stab stabs stabbed stabbing shoot shoots shot shooting tue tues tuez frapper frapperai umbringen umbringe "
           "schlagen matar mato golpear golpearé destruir destruiré").split()
THREAT_STEMS = "kill murder destroy strangl tuer détrui assassin töte erwürg ermord zerstör matar golpear apuñal asesin".split()

THREAT_PREFIXES = tuple(THREAT_STEMS)
TOKEN = re.compile(r"\w+|[.!?;:\n]")
STEMS = (3, 4, 5, 6, 7, 8)
AHEAD = 6   # as many as there are classes
REACH = 4   # words between a target and what it strengthens


@dataclass(frozen=True)
class Machine:
    """A transducer over word classes: ``steps[state][symbol] = (next state, factor)``; starts in 0.  A symbol
    is a class, plus ``AHEAD`` where a target follows."""

    steps: tuple[tuple[tuple[int, float], ...], ...]


def _near(trigger: int, reach: int, factor: float, on: tuple[int, ...], ahead: bool = False) -> Machine:
    """Multiplies the classes ``on`` by ``factor``, once, for ``reach`` words after ``trigger`` and, if ``ahead``,
    where the trigger follows."""
    rows = []
    for state in range(reach + 1):
        row = []
        for symbol in range(2 * AHEAD):
            c = symbol % AHEAD
            nxt = reach if c == trigger else max(0, state - 1)
            row.append((nxt, factor if (state or ahead and symbol >= AHEAD) and c in on else 1.0))
        rows.append(tuple(row))
    return Machine(tuple(rows))


def mark_targets(classes: list[int], reach: int = REACH) -> list[int]:
    """The symbols of a text's classes (clause ends are -1): from the right, a word within ``reach`` of a
    target that follows in its clause gets ``AHEAD``."""
    out, left = classes.copy(), 0
    for i in range(len(out) - 1, -1, -1):
        c = out[i]
        if c < 0:
            left = 0
            continue
        if left:
            out[i] = c + AHEAD
        left = reach if c == TARGET else max(0, left - 1)
    return out


def insult_machine() -> Machine:
    return Machine((tuple((0, 1.0 if c % AHEAD in (INSULT, THREAT) else 0.0) for c in range(2 * AHEAD)),))


def threat_machine(reach: int = REACH) -> Machine:
    return _near(TARGET, reach, 1.5, (THREAT,), ahead=True)


def target_machine(reach: int = REACH) -> Machine:
    return _near(TARGET, reach, 1.25, (INSULT,), ahead=True)


def negation_machine(reach: int = 2) -> Machine:
    return _near(NEGATION, reach, 0.5, (INSULT, THREAT))


def reported_machine() -> Machine:
    """From a verb of saying to the end of the clause."""
    calm = tuple((1 if c % AHEAD == REPORTED else 0, 1.0) for c in range(2 * AHEAD))
    told = tuple((1, 0.6 if c % AHEAD in (INSULT, THREAT) else 1.0) for c in range(2 * AHEAD))
    return Machine((calm, told))


def compose(machines: list[Machine]) -> Machine:
    """The product of the machines, over the states reachable from the start."""
    ids = {(0,) * len(machines): 0}
    order = [(0,) * len(machines)]
    steps = []
    for at in order:  # grows while it is read
        row = []
        for c in range(2 * AHEAD):
            moves = [m.steps[s][c] for m, s in zip(machines, at, strict=True)]
            nxt = tuple(s for s, _ in moves)
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append((ids[nxt], math.prod(f for _, f in moves)))
        steps.append(tuple(row))
    return Machine(tuple(steps))


@dataclass
class Grammar:
    """Lexicon (words and stems with weights), composed machine, and logistic coefficients."""

    words: dict[str, float]
    stems: dict[str, float]
    coef: list[float] = field(default_factory=lambda: [-4.0, 1.0, 0.5, 0.5])

    def __post_init__(self) -> None:
        self.machine = compose([insult_machine(), threat_machine(), target_machine(), negation_machine(), reported_machine()])
        self.closed = {w: k for k, ws in ((REPORTED, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in ws}
        self.classes = _Classes(self)

    def classify(self, word: str) -> tuple[int, float]:
        w = self.words.get(word)
        if w is not None:
            return INSULT, w
        for n in STEMS[::-1]:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        k = self.closed.get(word, OTHER)
        if k == OTHER and word.startswith(THREAT_PREFIXES):
            k = THREAT
        return k, 1.0 if k == THREAT else 0.0

    def clauses(self, text: str) -> Iterator[float]:
        """Scores of the clauses that match, in order."""
        tokens = TOKEN.findall(text.lower())
        classes = list(map(self.classes.__getitem__, tokens))
        if not any(w for _, w in classes):
            return
        steps, state, score = self.machine.steps, 0, 0.0
        for k, (_, w) in zip(mark_targets([k for k, _ in classes]), classes, strict=True):
            if k < 0:  # the end of a clause
                if score:
                    yield score
                state, score = 0, 0.0
            else:
                state, factor = steps[state][k]
                score += factor * w
        if score:
            yield score

    def features(self, text: str | None) -> tuple[float, float, float]:
        scores = list(self.clauses(text)) if text else []
        return (max(scores, default=0.0), math.log1p(sum(scores)), math.log1p(len(scores)))

    def probability(self, x: tuple[float, float, float]) -> float:
        z = self.coef[0] + sum(c * v for c, v in zip(self.coef[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Classes(dict):
    """Classes of words seen lately; clause ends are -1."""

    def __init__(self, grammar: Grammar, most: int = 300_000):
        super().__init__()
        self.grammar, self.most = grammar, most

    def __missing__(self, token: str) -> tuple[int, float]:
        out = (-1, 0.0) if len(token) == 1 and token in ".!?;:\n" else self.grammar.classify(token)
        if len(self) >= self.most:
            self.clear()
        self[token] = out
        return out

    def __reduce__(self):
        return (_Classes, (self.grammar, self.most))


def near_copies(texts: list[str]) -> list[int]:
    """A cluster number for each text: those that share two of four minimum hashes of their three-word
    shingles are near copies."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple, int] = {}
    for i, x in enumerate(shingle_sets(texts, 3)):
        if not len(x):
            continue
        least = [int((x * np.uint64(a)).min()) for a in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
        for a in range(4):
            for b in range(a):
                j = seen.setdefault((a, b, least[a], least[b]), i)
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def _chance(toxic: int, n: int, base: float) -> float:
    """Probability that at least ``toxic`` of ``n`` documents are toxic by chance."""
    top = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(base) + (n - k) * math.log1p(-base)
           for k in range(toxic, min(n, toxic + 60) + 1)]
    return min(1.0, math.fsum(map(math.exp, top)))


def word_sets(texts: list[str]) -> list[set[str]]:
    one: dict[str, str] = {}  # equal words of different texts are one string
    return [{one.setdefault(w, w) for w in re.findall(r"\w+", t.lower()) if not w.isdigit()} for t in texts]


def learn_lexicon(words: list[set[str]], cluster: list[int], labels: list[int], least_support: int = 3,
                  min_ratio: float = 20.0, false_keys: float = 0.5) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with weights: log-odds of the share of distinct toxic documents that hold
    them against the share of distinct other documents (``cluster`` numbers near copies alike).
    Of all candidates, ``false_keys`` at most are expected to pass by chance.  A stem is kept where
    words branch (it holds half as many documents again as any longer form), so 'idiot' is not
    shortened to 'idi'."""
    total = [len({c for c, y in zip(cluster, labels, strict=True) if bool(y) == k}) for k in (False, True)]
    if not total[0] or not total[1]:
        return {}, {}
    def keys(ws: set[str]) -> set[str]:
        return {w + "$" for w in ws} | {w[:n] for w in ws for n in STEMS if len(w) >= n}

    toxic = [(ws, c) for ws, c, y in zip(words, cluster, labels, strict=True) if y]
    often = Counter(key for ws, _ in toxic for key in keys(ws))
    toxic_in: dict[str, set[int]] = {k: set() for k, n in often.items() if n >= least_support}
    del often
    for ws, c in toxic:
        for key in keys(ws) & toxic_in.keys():
            toxic_in[key].add(c)
    toxic_in = {k: v for k, v in toxic_in.items() if len(v) >= least_support}
    clean_in: dict[str, set[int]] = {k: set() for k in toxic_in}
    for ws, c, y in zip(words, cluster, labels, strict=True):
        if not y:
            for w in ws:
                if w + "$" in clean_in:
                    clean_in[w + "$"].add(c)
                for n in STEMS:
                    if len(w) < n or w[:n] not in clean_in:
                        break  # a longer stem is in no more toxic documents than a shorter one
                    clean_in[w[:n]].add(c)
    base = total[1] / sum(total)
    support = {k: len(v) for k, v in toxic_in.items()}
    longer: dict[str, int] = defaultdict(int)  # of a key, the most documents that one longer form holds
    for key, n in support.items():
        for k in range(STEMS[0], len(key)):
            if key[:k] in support:
                longer[key[:k]] = max(longer[key[:k]], n)
    good = {}
    for key, toxic in support.items():
        clean = len(clean_in[key])
        rate = (toxic + 0.5) / (total[1] + 1) / ((clean + 0.5) / (total[0] + 1))
        if clean <= 0.1 * toxic and rate >= min_ratio and _chance(toxic, toxic + clean, base) * len(support) <= false_keys:
            good[key] = math.log(rate)
    stems: dict[str, float] = {}
    for key in sorted(good, key=lambda k: (len(k), k)):
        if not key.endswith("$") and support[key] >= 1.5 * longer[key] and not any(key[:n] in stems for n in STEMS if n < len(key)):
            stems[key] = good[key]
    out = {k[:-1]: w for k, w in good.items() if k.endswith("$") and not any(k[:n] in stems for n in STEMS if n < len(k))}
    return out, stems


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Newton's method on a few features."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple]) -> Grammar:
    """The grammar of labelled texts (id, label, text).  Without toxic rows the lexicon is empty, and
    then every score is low."""
    rows = sorted(rows, key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
    texts, labels = [r[2] for r in rows], [int(r[1]) for r in rows]
    words = word_sets(texts)
    cluster = near_copies(texts)
    grammar = Grammar(*learn_lexicon(words, cluster, labels))
    if 0 < sum(labels) < len(labels):
        # the curve is fitted on features from lexicons that have not seen the document
        part = [_half(c) for c in cluster]
        x = np.zeros((len(texts), 3))
        for k in range(2):
            seen = [i for i, h in enumerate(part) if h != k]
            other = Grammar(*learn_lexicon([words[i] for i in seen], [cluster[i] for i in seen], [labels[i] for i in seen]))
            for i, h in enumerate(part):
                if h == k:
                    x[i] = other.features(texts[i])
        grammar.coef = fit_logistic(x, np.array(labels, float)).tolist()
    return grammar


def fit(sample: DataFrame) -> Grammar:
    """``learn`` on a bounded sample (id, label, text; see ``common.labelled_sample``) in one task; only
    the grammar comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(rows))], pa.binary())], ["grammar"])

    found = sample.select("id", "label", "text").repartition(1).mapInArrow(run, "grammar binary").first()
    return pickle.loads(found[0]) if found else Grammar({}, {})


def _half(cluster: int) -> int:
    return xxhash.xxh64_intdigest(str(cluster)) & 1


def score(docs: DataFrame, grammar: Grammar, text_col: str = "text", carry: list[str] | None = None,
          score_col: str = "score") -> DataFrame:
    """``docs`` (or its columns ``carry``) with the toxic probability of every whole text.

    NULL and empty texts match no clause and get the score of a clean text."""
    shared = common.broadcast_value(docs.sparkSession, grammar)  # a lexicon and a few numbers

    def compute(texts: list[str | None]) -> list[pa.Array]:
        g = shared.value
        return [pa.array([g.probability(g.features(t)) for t in texts], pa.float64())]

    return common.with_columns(docs, [(score_col, T.DoubleType())], text_col, compute, carry)


def train(docs: DataFrame, labels: DataFrame, in_training: Column, max_rows: int = 6_000) -> Grammar:
    """Fit on at most ``max_rows`` labelled documents that ``in_training`` admits."""
    return fit(common.labelled_sample(docs, labels, "toxic", in_training, max_rows))


def classify(docs: DataFrame, labels: DataFrame, in_training: Column, max_rows: int = 6_000, threshold: float = 0.5,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every document.  Repeated rows get equal results, other columns are
    ignored, empty tables give empty results."""
    out = score(docs.select(id_col, text_col), train(docs, labels, in_training, max_rows), text_col, [id_col])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


