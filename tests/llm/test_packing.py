import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers
from tokenizers import Tokenizer

from embedframe.llm import packing

from .conftest import edge_rows

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def used(bins):
    out = Counter()
    for b, times in bins:
        for n, k in b:
            out[n] += k * times
    return dict(out)


def test_plan_uses_everything_and_fits():
    r = random.Random(3)
    for _ in range(30):
        counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        bins = packing.minimum_bin_slack(counts, 64)
        assert used(bins) == counts
        assert all(sum(n * k for n, k in b) <= 64 for b, _ in bins)
    assert packing.minimum_bin_slack({}, 10) == []


def test_first_bin_is_the_fullest_with_the_longest_piece():
    r = random.Random(4)
    for _ in range(40):
        counts = {r.randint(1, 20): r.randint(1, 2) for _ in range(5)}
        first = packing.minimum_bin_slack(counts, 23)[0][0]
        longest = max(counts)
        fullest = max(sum(n * k for n, k in zip(counts, ks, strict=True))
                      for ks in product(*[range(c + 1) for c in counts.values()])
                      if dict(zip(counts, ks, strict=True))[longest] and sum(n * k for n, k in zip(counts, ks, strict=True)) <= 23)
        assert sum(n * k for n, k in first) == fullest


def test_few_sequences():
    r = random.Random(9)
    counts = Counter(r.randint(1, 1024) for _ in range(20_000))
    bins = sum(times for _, times in packing.minimum_bin_slack(dict(counts), 1024))
    assert bins <= 1.01 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_documents(spark, edge_docs, no_docs):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    packed = packing.pack_documents(edge_docs, PATH, public_tokenizers.PATTERN, capacity=64, with_ids=True).cache()
    rows = packed.collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text, *_ in edge_rows():
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        copies = 2 if doc_id == 0 else 1
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        if copies == 1:
            assert [i for r in own for i in r["ids"]] == want
            assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == copies * len(want)
        assert all(r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in own)
        assert (len(want) <= 64) == (len(own) == copies)
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(joined[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"] for r in rows)
    assert packing.pack_documents(no_docs, PATH, public_tokenizers.PATTERN).count() == 0


def test_one_length_holds_all_rows(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(7 AS BIGINT) AS length")
    rows = packing.pack(pieces, 20).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000 and len({r["sequence_id"] for r in rows}) == 1500
