import random
from itertools import combinations

from embedframe.llm import licenses

from .conftest import prose


def test_longest_increasing_against_all_choices():
    r = random.Random(1)
    for _ in range(60):
        v = [r.randint(0, 9) for _ in range(r.randint(0, 9))]
        best = max((k for k in range(len(v) + 1) for c in combinations(v, k) if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)
        got = licenses.longest_increasing(v)
        assert len(got) == best and all(v[a] < v[b] for a, b in zip(got, got[1:], strict=False))


def test_patience_matches_are_equal_words_in_order():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 15))] for _ in range(2))
        got = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    words = "the quick brown fox jumps".split()
    assert licenses.patience(words, words) == [(i, i) for i in range(5)]
    assert licenses.patience("x the quick red brown fox".split(), words) == [(1, 0), (2, 1), (4, 2), (5, 3)]


def test_scan_finds_whole_altered_and_repeated_notices():
    s = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["MIT"][1]
    altered = mit.replace("free of charge", "without charge").upper()
    text = f"{prose(1, 300)} {altered} {prose(2, 200)} Released under the MIT License. Released under the MIT License.\n{prose(3, 50)}"
    found = s.scan(text)
    assert [(m.license, m.template) for m in found] == [("MIT", 1), ("MIT", 0), ("MIT", 0)]
    assert found[0].coverage < 1 and text[found[1].start:found[1].past] == "Released under the MIT License"
    assert s.scan(prose(4, 500)) == [] and s.scan(None) == [] and s.scan("licensed " * 500) == []
    long = " ".join(prose(i, 200) for i in range(40)) + " Licensed under CC BY-NC 4.0."
    assert [m.license for m in s.scan(long)] == ["CC-BY-NC-4.0"]


def test_edge_rows(spark, edge_docs, no_docs):
    assert licenses.scan_licenses(edge_docs).count() == 0
    notice = spark.createDataFrame([(1, "Released under the MIT License.", "x")] * 2, "doc_id long, text string, license string")
    assert [r["license"] for r in licenses.scan_licenses(notice).collect()] == ["MIT", "MIT"]
    assert licenses.scan_licenses(no_docs).count() == 0
