import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from embedframe.llm import ppm
from embedframe.llm.common import fold, table

from ..conftest import SF01


def test_code_lengths(spark):
    train = {"a": ["the cat sat on the mat", "that hat"], "b": ["le chat est là", "ça va là"]}
    df = spark.createDataFrame([(k, t) for k, ts in train.items() for t in ts], "lang string, text string").coalesce(1)
    model = ppm.fit(df, least=2)
    for text in ("the chat là", "zzz", "t", "the cat sat on the mat", "漢字"):
        got = model.code_lengths([text.encode()])[0]
        # a context counts as known if any language has seen it often enough
        both = Counter()
        for ts in train.values():
            for t in ts:
                x = b"\n\n\n" + t.encode()
                both.update(x[i - 3:i] for i in range(3, len(x)))
        for k, lang in enumerate(model.langs):
            want = brute([t.encode() for t in train[lang]], text.encode(), {c for c, n in both.items() if n >= 2})
            assert math.isclose(got[k], want, rel_tol=1e-5)


def brute(train, text, known):
    """Bits of a text: counts, escapes and shorter contexts, written out."""
    counts = [Counter() for _ in range(4)]
    for t in train:
        x = b"\n\n\n" + t
        for i in range(3, len(x)):
            for k in range(4):
                counts[k][(x[i - k:i], x[i])] += 1
    total = 0.0
    x = b"\n\n\n" + text
    for i in range(3, len(x)):
        bits = 8.0
        for k in range(4):
            c = x[i - k:i]
            if k == 3 and c not in known:
                continue
            own = {b: n for (d, b), n in counts[k].items() if d == c}
            if own:
                t = sum(own.values()) + len(own)
                bits = -math.log2(own[x[i]] / t) if x[i] in own else bits - math.log2(len(own) / t)
        total += bits
    return total


def test_long_texts_go_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([("a", "abcab" * 30), ("b", "bbcaa" * 30)], "lang string, text string")
    model = ppm.fit(df)
    text = b"abcaabbc" * 100
    whole = model.code_lengths([text, b"a"])
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 64)
    assert np.allclose(whole, model.code_lengths([text, b"a"]))


def test_edge_rows(spark, edge_docs, no_docs):
    out = {r["doc_id"]: r for r in ppm.identify(edge_docs, fold("doc_id", 5) != 0).collect()}
    assert {out[i]["lang_pred"] for i in (2, 3, 4, 9)} == {"und"} and out[2]["score"] == 0
    assert out[1]["lang_pred"] == "en" and out[None]["lang_pred"] == "en"
    assert ppm.identify(no_docs, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(edge_docs, F.lit(False)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = table(spark, SF01, "documents")
    out = ppm.identify(docs, fold("doc_id", 5) != 0).join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where(fold("doc_id", 5) == 0).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
