"""Lanes, top-k, masking, preparation and sources."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from embedframe.operators import candidates as C
from embedframe.operators import prep as P
from embedframe.sources import io


def _ids(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id long")


def test_weighted_lanes_sizes(spark):
    out = C.weighted_lanes(_ids(spark, 100), ["id"], [0.4, 0.6], [2, 1]).groupBy("lane").count().orderBy("lane").collect()
    assert [(r.lane, r["count"]) for r in out] == [(0, 20), (1, 20), (2, 60)]
    one = C.weighted_lanes(_ids(spark, 101), ["id"], [1.0], [2]).groupBy("lane").count().orderBy("lane").collect()
    assert [r["count"] for r in one] == [51, 50]  # larger lane first
    assert C.weighted_lanes(_ids(spark, 10), ["id"], [], []) is None
    with pytest.raises(ValueError):
        C.weighted_lanes(_ids(spark, 10), ["id"], [0.5, 0.6], [1, 1])
    with pytest.raises(ValueError):
        C.weighted_lanes(_ids(spark, 10), ["id"], [0.5, 0.5], [1])


def test_topk_quirk(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.1), (2, 2, 0.5), (3, 1, 0.3), (3, 2, 0.2), (3, 3, 0.1)],
                               "g int, i int, s double")
    order = [F.col("s").desc(), F.col("i")]
    q = sorted((r.g, r.i) for r in C.topk_per_group(df, ["g"], order, 5, reference_quirk=True).collect())
    assert q == [(2, 2), (3, 1), (3, 2)]  # a group of one keeps none, n − 1 at most
    plain = C.topk_per_group(df, ["g"], order, 2, reference_quirk=False).count()
    assert plain == 5
    best = sorted((r.g, r.i) for r in C.best_per_group(df, ["g"], "s", ["i"]).collect())
    assert best == [(1, 1), (2, 2), (3, 1)]


def test_batch_index_keeps_last_row(spark):
    out = C.batch_index(_ids(spark, 130), ["id"], 64).orderBy("id").collect()
    assert out[-1].batch_start == 128 and out[-1].row == 129 and out[63].batch_start == 0


def test_mask_segment(spark):
    df = spark.createDataFrame([(1, "ab.cde.f"), (2, "single")], "id long, text string")
    out = {r.id: r for r in C.mask_segment(df, "id", "text", seed=1, min_tokens=3, max_tokens=3).collect()}
    r = out[1]
    segs = "ab.cde.f".split(".")
    L = len(segs[r.seg_pos])
    assert r.mask == f"[*{{{L}-{L + 3}}}]"
    segs[r.seg_pos] = r.mask
    assert r.masked == ".".join(segs)
    assert out[2].masked == "[*{6-9}]"
    rep = C.mask_repeat(df, "id", "text", 4, seed=1, min_tokens=5, max_tokens=2)
    assert rep.count() == 8 and {r.n_tokens for r in rep.collect()} == {2}


def test_sample_and_splits(spark):
    df = _ids(spark, 50)
    a = [r.id for r in P.sample_exact(df, 10, 7, "id").collect()]
    b = [r.id for r in P.sample_exact(df, 10, 7, "id").collect()]
    assert a == b and len(set(a)) == 10
    with pytest.raises(ValueError):
        P.sample_exact(df, 51, 7, "id", on_short="error")
    assert P.sample_exact(df, 51, 7, "id", on_short="clip").count() == 50
    with pytest.raises(ValueError):
        P.check_unique_keys(["a", "b", "a"])
    with pytest.raises(ValueError):
        io.require_columns(df, ["id", "missing"])


def test_dedupe_keep_first_and_missing(spark):
    df = spark.createDataFrame([(3, "x", 1.0), (1, "x", float("nan")), (2, "y", None), (4, "z", 2.0)],
                               "id long, k string, v double")
    kept = sorted(r.id for r in P.dedupe_keep_first(df, ["k"], "id").collect())
    assert kept == [1, 2, 4]
    assert sorted(r.id for r in P.drop_missing(df, ["v"]).collect()) == [3, 4]


def test_headerless_and_extension(spark):
    d = tempfile.mkdtemp(prefix="embedframe-test-")
    path = os.path.join(d, "src.txt")
    with open(path, "w") as fh:
        fh.write("CCO id1\nc1ccccc1 id2\n")
    rows = io.scan_headerless(spark, path).collect()
    assert [(r.text, r.id) for r in rows] == [("CCO", "id1"), ("c1ccccc1", "id2")]
    assert io.format_for("a/b.jsonl") == "json" and io.format_for("a/b.smi") == "parquet"
    csv = os.path.join(d, "t.csv")
    with open(csv, "w") as fh:
        fh.write("a,b\n1,x\n")
    assert io.scan_by_extension(spark, csv, ["b", "a"]).columns == ["b", "a"]


def test_library_update_rules(spark):
    lib = spark.createDataFrame([("a", 5.0), ("b", 3.0)], "key string, score double")
    cands = spark.createDataFrame([("a", 9.0), ("c", 2.0), ("d", None), ("e", 4.0), ("f", 8.0)], "key string, score double")
    out = [(r.key, r.score) for r in P.library_update(lib, cands, "key", "score", 3).collect()]
    assert out == [("f", 8.0), ("a", 5.0), ("e", 4.0)]
    empty = spark.createDataFrame([], "key string, score double")
    assert P.library_update(empty, cands, "key", "score", 10).count() == 4  # threshold 0.0, NULL dropped


def test_sample_exact_takes_the_first_by_key(spark):
    df = _ids(spark, 300)
    want = sorted(r.id for r in df.orderBy(P.seeded_key(3, "id"), "id").limit(120).collect())
    assert sorted(r.id for r in P.sample_exact(df, 120, 3, "id").collect()) == want


def test_library_keeps_a_key_once(spark):
    lib = spark.createDataFrame([("a", 5.0), ("a", 4.0)], "key string, score double")
    cands = spark.createDataFrame([("c", 7.0), ("c", 9.0), ("c", 9.0), ("e", 8.0)], "key string, score double")
    out = [(r.key, r.score) for r in P.library_update(lib, cands, "key", "score", 10).collect()]
    assert out == [("c", 9.0), ("e", 8.0), ("a", 5.0)]


def test_dedupe_keeps_row_contents_without_an_order(spark):
    df = spark.createDataFrame([("k", None, "x"), ("m", 2, "y"), ("m", None, "z")], "key string, pos int, val string")
    assert {(r.key, r.pos, r.val) for r in P.dedupe_keep_first(df, ["key"], "pos").collect()} == {("k", None, "x"), ("m", 2, "y")}


def test_canonical_falls_back_on_damaged_text(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "A\x01 b!"), (4, "ab"), (5, " \x02 ")], "id int, text string")
    out = {r.id: r.canonical for r in P.dedupe_canonical(df, "text", "id").collect()}
    assert out == {1: "a b", 3: "ab"}


def test_pending_inputs_by_substring(spark):
    names = spark.createDataFrame([("a/src1-x",), ("a/src1-y",), ("b/src2",), ("c/other",)], "name string")
    done = spark.createDataFrame([("src1-x",), ("zzz-very-long-name-that-is-longer",)], "done string")
    assert [r.name for r in P.pending_inputs(names, "name", ["src1", "src2"], done, "done").collect()] == ["b/src2", "a/src1-y"]
    assert P.pending_inputs(names, "name", ["src"], done.limit(0), "done").count() == 3


def test_best_per_group_with_string_tiebreak(spark):
    from embedframe.operators import candidates as C

    df = spark.createDataFrame([(1, 2.0, "b"), (1, 2.0, "a"), (1, None, "0"), (2, None, "q")], "g int, s double, name string")
    assert sorted((r.g, r.name) for r in C.best_per_group(df, ["g"], "s", ["name"]).collect()) == [(1, "a"), (2, "q")]


def test_int8_quantisation_matches_formula(spark):
    import numpy as np

    from embedframe.operators.quantize import quantize_int8

    rng = np.random.default_rng(2)
    m = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, v array<double>")
    lo, step = m.min(0), (m.max(0) - m.min(0)) / 255
    got = {r.id: list(r.v) for r in quantize_int8(df, "v", signed=True).collect()}
    want = np.trunc((m - lo) / step - 128).astype(int)
    assert all(got[i] == want[i].tolist() for i in range(40))
    got_u = {r.id: list(r.v) for r in quantize_int8(df, "v", signed=False).collect()}
    assert all(got_u[i] == np.trunc((m[i] - lo) / step).astype(int).tolist() for i in range(40))


def test_split_union_rejects_repeated_dataset(spark):
    a, b = _ids(spark, 3), _ids(spark, 2)
    out = P.split_union([("train", "x", a), ("train", "y", b), ("val", "x", b)])
    assert out.count() == 7 and set(out.columns) == {"id", "dataset", "split"}
    with pytest.raises(ValueError, match="duplicate"):
        P.split_union([("train", "x", a), ("val", "y", b), ("train", "x", b)])


@pytest.mark.parametrize("extension", ["csv", "json", "parquet"])
def test_scan_by_extension_gives_back_whole_texts(spark, tmp_path, extension):
    texts = [None, "", "  spaces kept  ", 'quote " and "" two', "comma, tab\t, back\\slash\\", "line\nbreak\n", "ünï", "x" * 50_000]
    df = spark.createDataFrame([(i, t, None if i % 2 else i / 4) for i, t in enumerate(texts)], "id long, text string, x double")
    path = str(tmp_path / f"t.{extension}")
    io.sink_by_extension(df, path)
    back = io.scan_by_extension(spark, path, schema=df.schema, multiline=True)
    want = [(i, None if extension == "csv" and t == "" else t, x) for i, t, x in map(tuple, df.collect())]
    assert sorted(map(tuple, back.collect())) == sorted(want)
    none = str(tmp_path / f"none.{extension}")
    io.sink_by_extension(df.limit(0), none)
    assert io.scan_by_extension(spark, none, ["x", "id"], df.schema).collect() == []


def test_csv_header_must_name_the_schema(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    io.sink_by_extension(spark.createDataFrame([(1, "a")], "id long, text string"), path)
    with pytest.raises(Exception, match="(?i)header"):
        io.scan_by_extension(spark, path, schema="text string, id long").collect()


def test_fragment_library_rounds(spark):
    schema = "text string, score double"
    lib = spark.createDataFrame([("old one", 2.0), ("old two", 4.0)], "fragment string, score double")
    none = spark.createDataFrame([], schema)
    offered = spark.createDataFrame([("new a. new b", 5.0), ("new a. new b", 3.0), ("weak", 2.0), ("old one. new c", 3.0), (None, 9.0), ("x", None)], schema)
    lib1, rec1 = C.fragment_library_update(lib, none, offered, "text", "score", 4)
    assert [tuple(r) for r in lib1.orderBy(F.desc("score"), "fragment").collect()] == [
        ("new a", 5.0), ("new b", 5.0), ("old two", 4.0), ("new c", 3.0)]
    assert sorted(tuple(r) for r in rec1.collect()) == [("new a. new b", 5.0), ("old one. new c", 3.0)]
    # a second round: the threshold rose to 3, whole records seen before are refused whatever their score
    again = spark.createDataFrame([("new a. new b", 50.0), ("late", 3.0), ("new b. later", 6.0)], schema)
    lib2, rec2 = C.fragment_library_update(lib1, rec1, again, "text", "score", 4)
    assert sorted(tuple(r) for r in lib2.collect()) == [("later", 6.0), ("new a", 5.0), ("new b", 6.0), ("old two", 4.0)]
    assert rec2.count() == 3
    empty, kept = C.fragment_library_update(lib.limit(0), none, spark.createDataFrame([("a", 0.0), ("b", 0.5)], schema), "text", "score", 4)
    assert [tuple(r) for r in empty.collect()] == [("b", 0.5)] and kept.count() == 1


def test_sample_exact_by_digits_of_the_key(spark, monkeypatch):
    monkeypatch.setattr(P, "BIN_DIGITS", 1)  # sixteen bins: several steps on a small table
    df = spark.range(700).select((F.col("id") % 400).alias("id"), F.col("id").alias("row")).repartition(3)
    order = sorted(range(400), key=lambda i: __import__("hashlib").md5(f"5:{i}".encode()).hexdigest())
    ids = [i for i in order for _ in range(2 if i < 300 else 1)]  # ids below 300 occur twice
    for n in (1, 2, 7, 33, 350, 699, 700):
        assert sorted(r.id for r in P.sample_exact(df, n, 5, "id").collect()) == sorted(ids[:n])
    assert P.sample_exact(df, 0, 5, "id").count() == 0
    one = spark.range(60).select(F.lit(9).alias("id"))  # one key for all rows
    assert P.sample_exact(one, 41, 5, "id").count() == 41
    none = spark.createDataFrame([(None,), (1,), (None,), (2,)], "id int")
    assert sorted(r.id for r in P.sample_exact(none, 2, 5, "id").collect()) == [1, 2]
    assert P.sample_exact(none, 3, 5, "id").where("id IS NULL").count() == 1
    assert P.sample_exact(none.limit(0), 3, 5, "id", on_short="clip").count() == 0
    assert "Sort" not in P.sample_exact(df, 33, 5, "id")._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]


def test_row_range_reads_only_the_files_it_meets(spark, tmp_path):
    path = str(tmp_path / "rows with space.parquet")
    spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") * 2).write.parquet(path)
    for offset, n in ((0, 10), (100, 500), (140, 5), (990, 50), (2000, 3), (5, 0)):
        got = sorted((r.row_number, r.id) for r in io.scan_row_range(spark, path, offset, n, ["id"]).collect())
        assert got == [(i + 1, i) for i in range(1000)][offset:offset + n]
    spark.range(0, 1000, 1, 7).withColumn("_metadata", F.col("id")).write.parquet(path + "2")  # a column of that name
    assert io.scan_row_range(spark, path + "2", 300, 4).count() == 4
    inside = io.scan_row_range(spark, path, 140, 5, ["id"])
    plan = inside._jdf.queryExecution().executedPlan()
    assert plan.executeCollect() is not None
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 2 and "x" not in scan.requiredSchema().fieldNames()
    with pytest.raises(ValueError):
        io.scan_row_range(spark, path, -1, 5)
