import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from embedframe.llm import piece_bpe

from .conftest import edge_rows, prose

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pair():
    return piece_bpe.Pieces(PATH, most_words=3000), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80) | st.text("ab x▁\n\tthe ing", max_size=200))
def test_any_text(pair, text):
    mine, theirs = pair
    ids = mine.encode(text)
    assert ids == theirs.encode(text, add_eos=True)
    assert mine.decode(ids) == theirs.decode(ids)


def test_long_words_runs_and_joined_pieces(pair):
    mine, theirs = pair
    r = random.Random(3)
    vocabulary = [theirs.id_to_piece(i) for i in range(3 + 256, theirs.get_piece_size())]
    texts = [" " * n + "x" * n + " " * n for n in (1, 2, 15, 16, 17, 33, 1000)]
    texts += ["a" * 50_000, " " * 50_000, "ab" * 20_000, "漢字仮名" * 5_000, prose(1, 5000), "\n\n \t \n" * 50]
    texts += ["".join(r.choices(vocabulary, k=r.randint(2, 60))) for _ in range(3000)]
    texts += ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3000)) for _ in range(3)]
    for text in texts:
        ids = mine.encode(text)
        assert ids == theirs.encode(text, add_eos=True)
        assert mine.decode(ids) == theirs.decode(ids)


def test_rounds_equal_one_by_one_merges():
    """Vocabularies whose later pieces may rank better than those they are made of."""
    r = random.Random(8)
    for _ in range(60):
        mine = piece_bpe.Pieces.__new__(piece_bpe.Pieces)
        strings = {"".join(r.choices("abc", k=r.randint(2, 5))) for _ in range(r.randint(1, 25))}
        rank = {s: r.randint(0, 12) for s in strings}
        _tables(mine, rank)
        words = ["".join(r.choices("abcd", k=r.randint(1, 70))) for _ in range(50)]
        ids, cuts = mine.merge(words)
        for word, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            assert [mine.names[i] for i in ids[a:b]] == _one_by_one(word, rank)


def _one_by_one(word, rank):
    parts = list(word)
    while True:
        pairs = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def _tables(mine, rank):
    np = piece_bpe.np
    mine.names = [*"abcd", *rank]
    ids = {s: i for i, s in enumerate(mine.names)}
    mine.n, mine.run_rank = len(ids), -1
    mine.char_symbol = np.zeros(0x80, np.int64)
    for c in "abcd":
        mine.char_symbol[ord(c)] = ids[c]
    pairs = {ids[s[:k]] << 32 | ids[s[k:]]: (v, ids[s]) for s, v in rank.items() for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids}
    mine.keys = np.array(sorted(pairs) or [-1], np.int64)
    mine.rank = np.array([pairs[k][0] for k in sorted(pairs)] or [0], np.int64)
    mine.made = np.array([pairs[k][1] for k in sorted(pairs)] or [0], np.int64)
    mine.bigrams = np.array(sorted({ord(x) << 32 | ord(y) for s in rank for x, y in zip(s, s[1:])}), np.int64)


def test_decode_of_any_ids(pair):
    mine, theirs = pair
    r = random.Random(4)
    for _ in range(300):
        ids = [r.choice([r.randrange(3, 259), r.randrange(3, 32000)]) for _ in range(r.randint(0, 20))]
        assert mine.decode(ids) == theirs.decode(ids)


def test_query_on_edge_rows(spark, edge_docs, no_docs, pair):
    rows = piece_bpe.encode_decode(edge_docs, PATH, with_ids=True).collect()
    text = {r[0]: r[1] for r in edge_rows()}
    assert len(rows) == len(edge_rows())
    for r in rows:
        ids = pair[1].encode(text[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == pair[1].decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(pair[1].decode(ids).encode()).hexdigest()
    assert piece_bpe.encode_decode(no_docs, PATH).count() == 0
