import zlib
from collections import Counter, defaultdict

from embedframe.llm import kdtree

from .conftest import edge_rows, prose


def test_equal_bytes_and_gapless_slots(spark):
    texts = [prose(i, 20 + i % 90) for i in range(900)] + [prose(5000, 80)] * 300  # a quarter is one text
    rows = [(i, t, ["en", "fr"][i % 2], f"s{i % 7}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = kdtree.shard(df, shards=8, slack=0.02).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) < 1.06 * mean and min(size.values()) > 0.94 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # only groups that a cut runs through are parted: the large one, over few shards
    assert sum(len(s) > 1 for s in where.values()) <= 7 and len(where[texts[-1]]) <= 5


def test_as_many_shards_as_asked_for_any_count(spark):
    df = spark.createDataFrame([(i, prose(i, 30), "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    for n in (1, 3, 5):
        assert {r["shard"] for r in kdtree.shard(df, shards=n).collect()} == set(range(n))


def test_plan_has_no_python(spark, edge_docs):
    plan = kdtree.shard(edge_docs, shards=4)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_edge_rows(spark, edge_docs, no_docs):
    got = kdtree.shard(edge_docs, shards=4).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_rows())
    assert next(r["size"] for r in got if r["doc_id"] == 2) == 16
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.shard(no_docs, shards=4).count() == 0
