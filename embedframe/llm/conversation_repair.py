"""Repair of conversation structure by weighted CYK parsing over intervals of rows.

A repaired conversation's role initials spell ``(s?(ua)+)?``.  The grammar in Chomsky normal form has a
nonterminal (p, q) for each pair of places in that pattern (start, after s, after u, after a): it derives
the rows that lead from p to q.  Its rules are (p, q) -> (p, r) (r, q), and for a single row

* Keep (cost 0) if the row's initial fits p and q, Rerole to user or assistant (1), Delete (2, p = q);
  blank and duplicate rows can only go, undeleted truncated rows cost 5 more;
* insertions of empty user or assistant rows (5 each) before and after it: the insertion closure, which
  multiplies a row's cell from both sides by the cheapest insertions that lead from one place to another.

A cell holds, for each nonterminal, the smallest (cost, audit) of its span, where the audit is the
initials of the edits in order and ties go to the ASCII-least.  Two audits of one span and one cost are
never prefixes of one another (the longer one would hold only insertions more, and cost more), so
concatenation keeps their order, and cells combine like numbers.  For the same reason every way to split
a span gives the same cell: nonterminals are pairs of places, and an edit sequence passes some place at
any split.  So spans of length 1, 2, 4, 8... are combined bottom-up, each from two halves, in time linear in
the rows; the tests compare them with all spans and all splits.

A conversation of up to ``block_rows`` rows is parsed in one step of a task.  A longer one is put in order
by a range partitioning, cut into blocks, and its blocks' cells are combined as the rows' are, by spans of
``FAN`` blocks a round; the places at the cuts then tell every block its part of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import global_row_number
from . import common

BLOCK_ROWS = 256
FAN = 64
WHITE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # where a user or assistant row leads
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: (p, q) -> (cost, audit)
Cell = dict[tuple[int, int], tuple[int, str]]

#: The cheapest insertions from one place to another, none included.
INSERTIONS: Cell = {(p, p): (0, "") for p in range(4)}
for _p in range(4):
    _q = TURN[_p]
    INSERTIONS[_p, _q] = (INSERT, "I")
    INSERTIONS.setdefault((_p, TURN[_q]), (2 * INSERT, "II"))


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (ca, xa) in a.items():
        for (r2, q), (cb, xb) in b.items():
            if r == r2:
                known = out.get((p, q))
                if known is None or ca + cb < known[0] or ca + cb == known[0] and xa + xb < known[1]:
                    out[p, q] = (ca + cb, xa + xb)
    return out


@lru_cache(maxsize=64)
def leaf(code: str) -> Cell:
    """The cell of one row: ``x`` must go; ``s``, ``u``, ``a`` and ``o`` (any other) are initials, in upper case
    where the row is truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        edits = [(p, q, REROLE + more, "R") for p, q in TURN.items()]
        edits += [(p, q, KEEP + more, "K") for p, q in AFTER.get(code.lower(), {}).items()]
        for p, q, cost, name in edits:
            cell[p, q] = min(cell.get((p, q), (cost, name)), (cost, name))
    return combine(combine(INSERTIONS, cell), INSERTIONS)


@lru_cache(maxsize=1 << 15)
def _short(codes: str) -> Cell:
    return _spans([leaf(c) for c in codes])


def _spans(cells: list[Cell]) -> Cell:
    while len(cells) > 1:  # spans of 1, 2, 4, 8... ; an odd last one waits
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTIONS


def parse(codes: str) -> Cell:
    """The cell of a sequence of rows (see ``leaf`` for their codes)."""
    return _spans([_short(codes[i:i + 16]) for i in range(0, len(codes), 16)])


def cheapest(cell: Cell) -> tuple[int, str, int]:
    """(cost, audit, last place) of a whole conversation: nothing is left, or an assistant has the last word."""
    return min((*cell[START, q], q) for q in (START, ASSISTANT) if (START, q) in cell)


def code(role: str, text: str, duplicate: bool) -> tuple[str, str]:
    """(code, first fault) of a row."""
    body = text.strip(WHITE)
    if not body:
        return "x", "blank"
    if duplicate:
        return "x", "duplicate"
    initial = role[:1] if role[:1] in AFTER else "o"
    return (initial.upper(), "truncated") if body[-1] not in ".!?" else (initial, "")


def illegal(initials: list[str]) -> int:
    """Neighbours whose initials are none of su, ua and au."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def replay(audit: str, rows: list[tuple[str, str]], place: int = START) -> list[tuple[str, str]]:
    """The (role, text) rows that the edits make of ``rows``."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            place = TURN[place]
            out.append((NAMES[place], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == "R":
            place = TURN[place]
            out.append((NAMES[place], text))
        elif edit == "K":
            place = AFTER[role[:1]][place]
            out.append((role, text))
    return out


def lines(messages: list[tuple[str, str]]) -> str:
    return "\n".join(f"{r}:{t}" for r, t in messages)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "array<struct<role:string,text:string>>"
COUNTS = ["blank", "duplicate", "truncated"]


def _summary(g: pa.RecordBatch) -> list[pa.Array]:
    """A short conversation whole."""
    here = g.column("here").to_pylist()
    turns, roles, texts = ([v for v, h in zip(g.column(c).to_pylist(), here, strict=True) if h] for c in ("turn", "role", "text"))
    rows = list(zip(roles, texts, strict=True))
    seen, codes, faults = set(), [], dict.fromkeys([*COUNTS, ""], 0)
    for row in rows:
        c, fault = code(*row, row in seen)
        seen.add(row)
        codes.append(c)
        faults[fault] += 1
    cost, audit, _ = cheapest(parse("".join(codes)))
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    messages = replay(audit, rows)
    sha = hashlib.sha256(lines(messages).encode("utf-8", "surrogatepass")).hexdigest()
    numbers = [gaps, *(faults[f] for f in COUNTS), illegal([r[:1] for r in roles]), cost]
    return [g.column("_conv")[:1], *(pa.array([n], pa.int64()) for n in numbers), pa.array([audit]), pa.array([sha]), _message_array([messages])]


def _message_array(of_rows: list[list[tuple[str, str]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.array([[{"role": r, "text": t} for r, t in ms] for ms in of_rows], kind)


CELLS = "array<struct<p:int,q:int,cost:long,audit:string,places:string>>"
CELL_TYPE = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("places", pa.string())]))
BLOCK = f"_k string, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, cells {CELLS}"


def _block_array(key: str, block: int, counts: list[int], first: str, last: str, cell: dict) -> list[pa.Array]:
    cells = [{"p": p, "q": q, "cost": c, "audit": a, "places": places} for (p, q), (c, a, places) in cell.items()]
    return [pa.array([key]), pa.array([block], pa.int64()), *(pa.array([n], pa.int64()) for n in counts),
            pa.array([first]), pa.array([last]), pa.array([cells], CELL_TYPE)]


def _block(g: pa.RecordBatch) -> list[pa.Array]:
    """The cell and the counts of a block of a long conversation."""
    roles = g.column("role").to_pylist()
    codes, faults = [], dict.fromkeys([*COUNTS, ""], 0)
    for role, text, dup in zip(roles, g.column("text").to_pylist(), g.column("dup").to_pylist(), strict=True):
        c, fault = code(role, text, dup)
        codes.append(c)
        faults[fault] += 1
    initials = [r[:1] for r in roles]
    cell = {(p, q): (*v, str(q)) for (p, q), v in parse("".join(codes)).items()}
    return _block_array(g.column("_k")[0].as_py(), g.column("block")[0].as_py(), [*(faults[f] for f in COUNTS), illegal(initials)],
                        initials[0], initials[-1], cell)


def _merge_blocks(g: pa.RecordBatch) -> list[pa.Array]:
    """Up to ``FAN`` neighbouring blocks as one: ``places`` has the place after each block."""
    firsts, lasts = g.column("first").to_pylist(), g.column("last").to_pylist()
    total = None
    for cells in g.column("cells").to_pylist():
        cell = {(c["p"], c["q"]): (c["cost"], c["audit"], c["places"]) for c in cells}
        if total is None:
            total = cell
            continue
        both = combine({k: v[:2] for k, v in total.items()}, {k: v[:2] for k, v in cell.items()})
        places = {}
        for (p, r), (ca, xa, ya) in total.items():
            for (r2, q), (cb, xb, yb) in cell.items():
                if r == r2 and (p, q) not in places and both[p, q] == (ca + cb, xa + xb):
                    places[p, q] = ya + yb
        total = {k: (*v, places[k]) for k, v in both.items()}
    counts = [sum(g.column(c).to_pylist()) for c in [*COUNTS, "illegal"]]
    counts[-1] += sum(a + b not in ("su", "ua", "au") for a, b in zip(lasts, firsts[1:]))
    return _block_array(g.column("_k")[0].as_py(), g.column("up")[0].as_py(), counts, firsts[0], lasts[-1], total)


def _best(g: pa.RecordBatch) -> list[pa.Array]:
    """(key, counts, cost, audit, places) from the one block that is left of a conversation."""
    cell = {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in g.column("cells")[0].as_py()}
    cost, audit, last = cheapest(cell)
    places = next(c["places"] for c in g.column("cells")[0].as_py() if (c["p"], c["q"]) == (START, last))
    return [g.column("_k"), *(g.column(c) for c in [*COUNTS, "illegal"]), pa.array([cost], pa.int64()), pa.array([audit]), pa.array([places])]


def _block_messages(g: pa.RecordBatch) -> list[pa.Array]:
    """A block's repaired rows: its first row carries its part of the audit, and the place before it."""
    roles, texts = g.column("role").to_pylist(), g.column("text").to_pylist()
    messages = replay(texts[0], list(zip(roles[1:], texts[1:], strict=True)), int(roles[0]))
    return [g.column("_k")[:1], g.column("block")[:1], _message_array([messages])]


def _digests(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation; its blocks come in order and are not held."""
    key, sha, begun = None, None, False
    for b in blocks:
        keys, found = [], []
        for k, messages in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(sha.hexdigest())
                key, sha, begun = k, hashlib.sha256(), False
            if messages:
                sha.update((("\n" if begun else "") + lines([(m["role"], m["text"]) for m in messages])).encode("utf-8", "surrogatepass"))
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["_k", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], ["_k", "repaired_sha256"])


def _long_conversations(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(summary, messages by block) of conversations of more than ``block_rows`` rows."""
    salted = common.written(rows.withColumn("_salt", F.monotonically_increasing_id()), "repair-rows")  # equal rows spread over the ranges
    placed = global_row_number(salted, ["turn", "role", "text", "_salt"], ["_k"], "pos").withColumn("block", F.floor((F.col("pos") - 1) / block_rows))
    placed = common.written(placed.select("_k", "turn", "role", "text", "pos", "block"), "repair-placed")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy("_k", same.alias("_same")).agg(F.min("pos").alias("pos")).select("_k", "pos", F.lit(True).alias("_first"))
    marked = placed.join(firsts, ["_k", "pos"], "left").withColumn("dup", F.col("_first").isNull()).drop("_first", "turn")
    blocks = common.written(common.by_group(marked, ["_k", "block"], ["pos"], BLOCK, _block), "repair-blocks")
    level, n = blocks, blocks.agg(F.max("block")).first()[0]
    while n:
        up = level.withColumn("up", F.floor(F.col("block") / FAN))
        level = common.written(common.by_group(up, ["_k", "up"], ["block"], BLOCK, _merge_blocks), "repair-spans")
        n = n // FAN
    best = common.written(common.by_group(level, ["_k"], [], "_k string, blank long, duplicate long, truncated long, illegal long, cost long, "
                                          "audit string, places string", _best), "repair-best")
    # the place before each block, and its edits from there to the place after it
    ends = best.select("_k", F.posexplode(F.split(F.concat(F.lit("0"), "places"), "")).alias("block", "p"), "places").where("p <> ''")
    parts = ends.select("_k", F.col("block").cast("long"), "p", F.substring("places", F.col("block") + 1, F.lit(1)).alias("q")).where("q <> ''")
    parts = parts.join(blocks.select("_k", "block", F.explode("cells").alias("c")), ["_k", "block"]).where("c.p = int(p) and c.q = int(q)")
    edits = parts.select("_k", "block", F.lit(0).cast("long").alias("pos"), F.col("p").alias("role"), F.col("c.audit").alias("text"))
    both = placed.select("_k", "block", "pos", "role", "text").unionByName(edits)
    messages = common.written(common.by_group(both, ["_k", "block"], ["pos"], f"_k string, block long, messages {MESSAGES}", _block_messages), "repair-messages")
    digests = messages.repartition("_k").sortWithinPartitions("_k", "block").mapInArrow(_digests, "_k string, repaired_sha256 string")
    span = placed.groupBy("_k").agg((F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.countDistinct("turn")).alias("gaps"))
    return best.drop("places").join(span, "_k").join(digests, "_k"), messages


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           here: Column | None = None, block_rows: int = BLOCK_ROWS, with_messages: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for
    each conversation; with ``with_messages`` also (conversation, block, messages), the repaired rows in
    order of their blocks.

    Rows where ``here`` is false only name their conversation.  NULL roles and texts are one space, a NULL
    conversation is one of its own, rows without turn come first.  Rows of one turn are ordered by role and
    text; equal rows are duplicates of the first.  An empty role fits nowhere.  A conversation without rows
    has zeros, an empty audit and the digest of the empty string.  Other columns are ignored; an empty
    table gives an empty result.  A digest is made row by row in order, so a long conversation's rows
    pass through one task for it, in blocks that are not held."""
    conv = F.col(f"`{conv_col}`")
    common.small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("_k"), conv.alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"),
        F.coalesce(F.lit(True) if here is None else here, F.lit(False)).alias("here"))
    present = rows.where("here")
    long = common.written(present.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.first("_conv").alias("_conv")).where(F.col("_n") > block_rows)
                          .drop("_n"), "repair-long")
    some_long = not long.isEmpty()
    # conversations that may have no rows: one row each stands for them
    ghosts = rows.where("not here").select("_k", "_conv", "here").distinct()
    short = present.unionByName(ghosts, allowMissingColumns=True)
    if some_long:
        short = short.join(long.select("_k"), "_k", "left_anti")
    schema = T._parse_datatype_string(f"{SUMMARY}, messages {MESSAGES}")
    schema = T.StructType([T.StructField("_conv", conversations.schema[conv_col].dataType), *schema.fields])
    whole = common.by_group(short, ["_k"], ["here", "turn", "role", "text"], schema, _summary)
    whole = common.written(whole, "repair-short") if with_messages else whole
    summary = whole.drop("messages")
    messages = whole.select("_conv", F.lit(0).cast("long").alias("block"), "messages")
    if some_long:
        more, blocks = _long_conversations(present.join(long.select("_k"), "_k", "left_semi").drop("here", "_conv"), block_rows)
        summary = summary.unionByName(more.join(long, "_k").select(summary.columns))
        messages = messages.unionByName(blocks.join(long, "_k").select(messages.columns))
    summary = summary.withColumnRenamed("_conv", conv_col)
    return (summary, messages.withColumnRenamed("_conv", conv_col)) if with_messages else summary
