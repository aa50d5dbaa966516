import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from embedframe.llm import bpe

from .conftest import edge_rows

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.load_tiktoken(PATH)
    return bpe.Transducer(ranks, max_states=3000), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return [int.from_bytes(data[i:i + 4], "little") for i in range(0, len(data), 4)]


def test_pieces_of_whole_and_joined_tokens(pair):
    machine, theirs = pair
    r = random.Random(5)
    tokens = list(machine.ranks)
    pieces = r.sample(tokens, 4000) + [b"".join(r.choices(tokens, k=r.randint(2, 5))) for _ in range(4000)]
    assert all(ids(machine.encode_bytes(p)) == theirs._encode_single_piece(p) for p in pieces)  # tables start anew meanwhile


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    machine, theirs = pair
    got = ids(machine.encode_pieces(bpe.codec(PATH, public_tokenizers.PATTERN)[1](text)))
    assert got == theirs.encode_ordinary(text)
    parts = list(bpe.decode_stream(got, machine.bytes_of, block=1))
    assert b"".join(parts) == text.encode()
    assert "".join(p.decode() for p in parts) == text  # every part is whole code points


def test_small_vocabulary_with_a_lookahead():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"abcd": 259}
    machine = bpe.Transducer(ranks)
    theirs = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    for p in (b"abc", b"abbc", b"bcab", b"abcdabc", b"bcd", b"aabbccdd" * 5):
        assert ids(machine.encode_bytes(p)) == theirs._encode_single_piece(p)
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})


def test_stream_keeps_code_points_whole():
    s = bpe.Utf8Stream()
    out = [s.feed(bytes([b])) for b in "é漢🙂x".encode()]
    assert [x.decode() for x in out if x] == list("é漢🙂x") and s.close() == b""
    assert s.feed(b"\xe6\xbc") == b"" and s.close() == b"\xe6\xbc"


def test_json_and_ranks_agree():
    assert bpe.load_byte_level_json(str(public_tokenizers.path("byte_bpe_50k.json"))) == bpe.load_tiktoken(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_query_on_edge_rows(spark, edge_docs, no_docs, pair):
    rows = bpe.encode_decode(edge_docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    text = {r[0]: r[1] for r in edge_rows()}
    assert len(rows) == len(edge_rows())
    for r in rows:
        t = text[r["doc_id"]] or ""
        assert r["ids"] == pair[1].encode_ordinary(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r["ids"])).hexdigest()
    assert bpe.encode_decode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
