"""Repairs against all edits tried, whole conversations against pieces of them, and the query against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from freshet.llm import conversation_repair as cr

SMALL = "/root/testdata/sf0.001"
CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
GOOD = re.compile("(s?(ua)+)?")


def all_edits(rows, inserts=4):
    """Least (cost, audit, outcome) by trying every sequence of edits."""
    best = None

    def go(i, cost, audit, out, left):
        nonlocal best
        if i == len(rows) and GOOD.fullmatch("".join(cr._mark(r[:1]) for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, out
        if best and cost > best[0]:
            return
        if left:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (role, "")], left - 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, cost + 3, audit + "D", out, left)
        if fault not in (cr.BLANK, cr.DUPLICATE):
            more = fault == cr.CUT
            go(i + 1, cost + more, audit + "K", [*out, (role, text)], left)
            for other in ("user", "assistant"):
                go(i + 1, cost + 2 + more, audit + "R", [*out, (other, text)], left)

    go(0, 0, "", [], inserts)
    return best


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(cr.WHITE)
        fault = cr.BLANK if not body else cr.DUPLICATE if (role, text) in seen else cr.CUT if body[-1] not in ".!?" else cr.SOUND
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def whole(rows):
    """The contract's row for one conversation of (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    found = faults([r[1:] for r in rows])
    initials = [r[0][:1] for r in found]
    count = [f for _, _, f in found].count
    front = cr.parse(tuple((cr._mark(i), f) for i, (_, _, f) in zip(initials, found)))
    cost, audit = min(v for k, v in front.items() if k in cr.AUTOMATON.accepts)
    ops, _ = cr.edits("".join(map(cr._mark, initials)), audit, "")
    lines = []
    for (role, text, _), edit in zip(found, ops):
        for e in edit:
            if e in "uaUAK":
                lines.append(f"{ {'u': 'user', 'a': 'assistant'}[e.lower()] if e != 'K' else role}:{'' if e in 'ua' else text}")
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count(cr.BLANK), count(cr.DUPLICATE), count(cr.CUT),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    """The whole query in Python."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        if case:
            kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return sorted(repr((c, *whole(r))) for c, r in out.items())


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLS).collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]),
                          st.sampled_from(["A.", "B.", "cut", " ", ""])), max_size=4))
def test_least_edits(rows):
    found = faults(rows)
    cost, audit, out = all_edits(found)
    front = cr.parse(tuple((cr._mark(r[:1]), f) for r, _, f in found))
    assert min(v for k, v in front.items() if k in cr.AUTOMATON.accepts) == (cost, audit)
    if rows:
        ops, _ = cr.edits("".join(cr._mark(r[:1]) for r, _ in rows), audit, "")
        made = []
        for (role, text, _), edit in zip(found, ops):
            for e in edit:
                if e != "D":
                    made.append((role if e == "K" else cr.ROLES[e.lower()], "" if e in "ua" else text))
        assert made == out


def test_automaton():
    a = cr.AUTOMATON
    assert a.terminals == ["a", "s", "u"] and len(a.cells) < 20
    def ends(word):
        tops = {0}
        for x in word:
            tops = {t for c in tops for t in a.moves[c, x]}
        return bool(tops & a.accepts)
    from itertools import product
    for n in range(7):
        for word in map("".join, product("sua", repeat=n)):
            assert ends(word) == bool(GOOD.fullmatch(word)), word
    with pytest.raises(ValueError):
        cr.Automaton([("A", "xAy"), ("A", "")])


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, "", "União"]),
             rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, "é.", "tail.\x0b ", "x. "]))
            for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (100, None, "user", "A."), (100, None, "user", "A."),
             (100, None, "assistant", "B."), (101, 3, "user", "A."), (101, 9, "assistant", "B."), (101, 3, "assistant", "B.")]
    # one conversation with most of the rows, many alike
    return rows + [(200, t // 3, rng.choice(["user", "assistant"]), f"Row {rng.randrange(400)}.") for t in range(1000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, CONV).selectExpr("*", "1 as place", "2 as gaps", "'x' as `_key`", "3 as audit")


def query_of(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    return cr.query(spark, str(tmp_path))


def test_query_against_plain_python(spark, tmp_path, conversations):
    assert got(query_of(spark, tmp_path, conversations)) == plain(conversations)


def test_empty_table(spark, tmp_path):
    found = query_of(spark, tmp_path, [])
    assert found.dtypes == [(c, "string" if c in COLS[-2:] else "bigint") for c in COLS] and got(found) == []


def test_dropped_conversations_stay(spark, tmp_path):
    gone = [(c, 0, "user", "A.") for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    assert got(query_of(spark, tmp_path, gone)) == sorted(
        repr((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c, *_ in gone)


def sequences(rows):
    """Rows of each conversation in order; an inserted row may stand by either neighbour."""
    by = defaultdict(list)
    for r in rows.collect():
        by[r.conv_id].append((r.place, r.part, r.role, r.text))
    return {c: [r[2:] for r in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize("chunk", [1, 4, 64])
def test_pieces_give_the_same(spark, conversations, chunk):
    rows = frame(spark, conversations)
    one, many = cr.repair(rows), cr.repair(rows, chunk=chunk)
    assert sorted(map(repr, one.conversations.collect())) == sorted(map(repr, many.conversations.collect()))
    assert sequences(one.rows) == sequences(many.rows)


def test_repaired_rows_follow_the_grammar(spark, conversations):
    found = sequences(cr.repair(frame(spark, conversations)).rows)
    assert all(GOOD.fullmatch("".join(role[:1] for role, _ in rows)) for rows in found.values())


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    rows = db.execute(f"SELECT {', '.join(COLS)} FROM ({cr.SQL})").fetchall()
    assert got(cr.query(spark, SMALL)) == sorted(map(repr, rows)) and rows
