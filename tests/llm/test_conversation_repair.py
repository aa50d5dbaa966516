import itertools
import random

import duckdb
import pytest

from embedframe.llm import conversation_repair as cr
from embedframe.llm import queries

from ..conftest import SF001

CODES = "suaoSUAOx"
SCHEMA = "conv_id long, turn long, role string, text string, cost long, _k string, here2 boolean"


def all_spans(codes):
    """CYK over every span and every split."""
    n = len(codes)
    chart = {(i, i + 1): cr.leaf(c) for i, c in enumerate(codes)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            best = {}
            for k in range(i + 1, i + size):
                for key, v in cr.combine(chart[i, k], chart[k, i + size]).items():
                    best[key] = min(best.get(key, v), v)
            chart[i, i + size] = best
    return chart[0, n] if n else cr.INSERTIONS


def all_edits(codes, insertions=3):
    """(cost, audit) over every edit sequence with up to so many insertions."""
    import re

    found = []
    for edits in itertools.product("KuaD", repeat=len(codes)):
        if any(c == "x" and e != "D" for c, e in zip(codes, edits, strict=True)):
            continue
        cost = sum({"K": 0, "u": 1, "a": 1, "D": 2}[e] + (5 if c.isupper() and e != "D" else 0) for c, e in zip(codes, edits, strict=True))
        for m in range(insertions + 1):
            for at in itertools.combinations_with_replacement(range(len(codes) + 1), m):
                for roles in itertools.product("ua", repeat=m):
                    audit, initials = "", ""
                    for i in range(len(codes) + 1):
                        audit += "I" * at.count(i)
                        initials += "".join(r for a, r in zip(at, roles, strict=True) if a == i)
                        if i < len(codes):
                            audit += "R" if edits[i] in "ua" else edits[i]
                            initials += {"K": codes[i].lower(), "D": ""}.get(edits[i], edits[i])
                    if re.fullmatch("(s?(ua)+)?", initials):
                        found.append((cost + 5 * m, audit))
    return min(found)


def test_parse_against_every_edit_sequence():
    for n in range(3):
        for codes in itertools.product(CODES, repeat=n):
            assert cr.cheapest(cr.parse("".join(codes)))[:2] == all_edits(codes)
    r = random.Random(2)
    for _ in range(40):
        codes = "".join(r.choices(CODES, k=r.choice([3, 4])))
        assert cr.cheapest(cr.parse(codes))[:2] == all_edits(codes, 2)


def test_halves_give_the_cells_of_all_spans():
    r = random.Random(1)
    for n in [*range(12), 17, 33, 40]:
        codes = "".join(r.choices(CODES, k=n))
        assert cr.parse(codes) == all_spans(codes)


def conversation(i, n, seed):
    r = random.Random(seed)
    texts = ["Good.", "Good.", "What? ", "cut off", "", " \n", "Fine!\t", "Ünï."]
    rows = []
    for t in range(n):
        role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent"])
        rows.append((i, r.choice([t, t, t, None]), role, r.choice([*texts, f"line {t}.", None]), 7, "clash", True))
    return rows


def by_hand(rows):
    """The result for one conversation, row by row."""
    import hashlib

    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for _, t, r, x, *_ in rows))
    seen, codes, faults = set(), "", []
    for _, _, r, x in rows:
        c, fault = cr.code(r, x, (r, x) in seen)
        seen.add((r, x))
        codes += c
        faults.append(fault)
    cost, audit, _ = cr.cheapest(all_spans(codes)) if len(codes) < 60 else cr.cheapest(cr.parse(codes))
    turns = {t for known, t, *_ in rows if known}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    sha = hashlib.sha256(cr.lines(cr.replay(audit, [r[2:] for r in rows])).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)


@pytest.mark.parametrize("block_rows", [256, 7])
def test_conversations_of_any_length(spark, block_rows):
    rows = [x for i in range(40) for x in conversation(i, i % 13, i)] + conversation(100, 300, 5) + conversation(None, 9, 6) + conversation(101, 500, 7)
    rows += [rows[-1]] * 40  # a turn that is most of its conversation
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    summary, messages = cr.repair(df, block_rows=block_rows, with_messages=True)
    got = {r[0]: tuple(r)[1:] for r in summary.collect()}
    assert len(got) == summary.count() == len({r[0] for r in rows})
    for i, have in got.items():
        assert have == by_hand([r for r in rows if r[0] == i]), i
    said = {}
    for r in sorted(messages.collect(), key=lambda r: r["block"]):
        said.setdefault(r[0], []).extend((m["role"], m["text"]) for m in r["messages"])
    for i, have in got.items():
        import hashlib
        import re

        assert hashlib.sha256(cr.lines(said[i]).encode()).hexdigest() == have[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said[i]))


def test_rows_that_are_not_there(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0, "", False), (1, 1, "user", "Hi.", 0, "", False), (2, None, "user", "Hi.", 0, "", True),
                                (3, 5, "user", "Hi.", 0, "", None)], SCHEMA)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    got = {r[0]: tuple(r)[1:] for r in cr.repair(df, here=F.col("here2")).collect()}
    assert got[1] == got[3] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[2] == (0, 0, 0, 0, 0, 2, "D", empty)
    assert cr.repair(df.limit(0)).count() == 0


def test_query_with_nulls_against_sql(spark, tmp_path):
    rows = [x for i in range(60) for x in conversation(i, 2 + i % 12, i + 50)] + conversation(None, 8, 3)
    # one text for each place, so that the order within a turn is that of role and text alone
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.sql(queries.ORACLE["op12_conversation_repair"])
    got = queries.op12_conversation_repair(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF001}/conversations.parquet'")
    want = con.sql(queries.ORACLE["op12_conversation_repair"])
    got = queries.op12_conversation_repair(spark, SF001).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
