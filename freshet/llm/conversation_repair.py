"""Conversation structure repair: generalised LR repair over the role grammar.

``repair(rows)`` takes (conv_id, turn, role, text) and gives a ``Repaired``: one summary row per conversation,
and the repaired rows.  The roles' initials of a repaired conversation follow ``RULES``: nothing, or an optional system row
and then pairs of user and assistant.

Rows are edited one by one, at a cost: keep 0, rerole to user or assistant 2, delete 3, insert an empty user or
assistant row 2.  Blank and duplicate rows must go, a truncated row that stays costs 1 more.  The parser holds
a graph-structured stack: cells of LR states that share what lies below them.  Every edit leads to other
stacks, equal stacks are merged by the least (cost, audit), so what is kept for a conversation is one
(cost, audit) for each of the grammar's few stacks, however long it is.  ``audit`` has the
initials of the cheapest edits in order, the ASCII-least of equal cost.

Rows of a conversation come by turn (NULL first), then role, then text; NULL role and text count as one
space; an empty role has no place in the grammar.  The first fault of a row counts: blank (no character but white
space), duplicate (role and text seen earlier), truncated (the last character that is not white space is
no ``.!?``).  ``illegal`` counts neighbours whose initials are not su, ua or au; ``gaps`` is the greatest
turn less the least plus one less the number of distinct turns, without NULL.  A NULL conv_id is a conversation like any other.
Repeated rows are duplicates.  An empty table gives empty results; other columns are not looked at.

A conversation may be a third of the table: rows are ordered by range partitions that may cut a conversation,
and cut again every ``CHUNK`` rows.  Each piece is parsed by itself from every stack it may start with; the pieces'
tables are then put together in order.  Duplicates are found by the least place of each (role, text),
combined before the shuffle.  Only these tables, and the digest of a repaired conversation, pass
through one task per conversation, as streams.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, only, small_batches, stage

#: the role grammar: initials are terminals, the first left side is the start
RULES = [("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua")]
#: roles that may be inserted or put in place of another, by initial
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = "\t\n\x0b\x0c\r "
#: rows of one piece, a power of two
CHUNK = 1 << 12
#: more stacks than this, and the grammar nests without bound
STACKS = 1000


class Automaton:
    """LR automaton of a grammar, and the graph of all stacks it can hold.

    ``cells[i]`` is (state, cell below); a stack is its top cell.  ``moves[i, x]`` are the stacks that cell i may
    become by shifting x, after any reductions; ``accepts`` are the stacks that may end.
    """

    def __init__(self, rules):
        self.rules = [("", rules[0][0]), *rules]
        self.heads = {left for left, _ in self.rules}
        self.terminals = sorted({x for _, right in rules for x in right} - self.heads)
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.cells = [(0, None)]
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}
        self.accepts = set()
        at = 0
        while at < len(self.cells):
            for x in self.terminals:
                found = [self._cell(self._goto(self.cells[c][0], x), c) for c in self._reduced(at, x)
                         if self._goto(self.cells[c][0], x) is not None]
                self.moves[at, x] = tuple(found)
            if any(self._ended(c) for c in self._reduced(at, "$")):
                self.accepts.add(at)
            at += 1
            if len(self.cells) > STACKS:
                raise ValueError("the grammar's stacks have no bound")

    def _closure(self, items) -> frozenset:
        items, new = set(items), list(items)
        while new:
            rule, dot = new.pop()
            right = self.rules[rule][1]
            if dot < len(right):
                more = {(i, 0) for i, (left, _) in enumerate(self.rules) if left == right[dot]} - items
                items |= more
                new += more
        return frozenset(items)

    def _goto(self, state: int, x: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.states[state] if self.rules[r][1][d:d + 1] == x}
        if not moved:
            return None
        closed = self._closure(moved)
        if closed not in self.states:
            self.states.append(closed)
        return self.states.index(closed)

    def _follow(self) -> dict[str, set[str]]:
        empty, first, follow = set(), {h: set() for h in self.heads}, {h: set() for h in self.heads}
        follow[""].add("$")
        size = -1
        while size != (size := len(empty) + sum(map(len, [*first.values(), *follow.values()]))):
            for left, right in self.rules:
                for i, x in enumerate(right):
                    if all(y in empty for y in right[:i]):
                        first[left] |= first.get(x, {x})
                    if x not in self.heads:
                        continue
                    for y in right[i + 1:]:
                        follow[x] |= first.get(y, {y})
                        if y not in empty:
                            break
                    else:
                        follow[x] |= follow[left]
                if all(y in empty for y in right):
                    empty.add(left)
        return follow

    def _cell(self, state: int, below: int) -> int:
        cell = (state, below)
        if cell not in self.cells:
            self.cells.append(cell)
        return self.cells.index(cell)

    def _reduced(self, cell: int, ahead: str) -> list[int]:
        """The stack itself and all stacks that reductions make of it before ``ahead``."""
        found, new = [cell], [cell]
        while new:
            top = new.pop()
            for rule, dot in sorted(self.states[self.cells[top][0]]):
                left, right = self.rules[rule]
                if rule and dot == len(right) and ahead in self.follow[left]:
                    below = top
                    for _ in right:
                        below = self.cells[below][1]
                    made = self._cell(self._goto(self.cells[below][0], left), below)
                    if made not in found:
                        found.append(made)
                        new.append(made)
        return found

    def _ended(self, cell: int) -> bool:
        return (0, 1) in self.states[self.cells[cell][0]]


AUTOMATON = Automaton(RULES)

#: faults of a row
SOUND, CUT, BLANK, DUPLICATE = 0, 1, 2, 3


def _better(front: dict, stack: int, cost: int, audit: str) -> bool:
    """Merge into the stacks at one place."""
    if stack in front and front[stack] <= (cost, audit):
        return False
    front[stack] = (cost, audit)
    return True


def _inserted(front: dict) -> dict:
    """Also the stacks that inserted rows lead to."""
    new = list(front)
    while new:
        stack = new.pop()
        cost, audit = front[stack]
        for x in ROLES:
            for to in AUTOMATON.moves[stack, x]:
                if _better(front, to, cost + INSERT, audit + "I"):
                    new.append(to)
    return front


@lru_cache(maxsize=1 << 14)
def parse(rows: tuple, start: int = 0) -> dict[int, tuple[int, str]]:
    """Stack -> least (cost, audit) after ``rows`` of (initial, fault), from the stack ``start``."""
    front = _inserted({start: (0, "")})
    for initial, fault in rows:
        new: dict[int, tuple[int, str]] = {}
        for stack, (cost, audit) in front.items():
            _better(new, stack, cost + DELETE, audit + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            stays = cost + (TRUNCATED if fault == CUT else 0)
            for to in AUTOMATON.moves.get((stack, initial), ()):
                _better(new, to, stays, audit + "K")
            for x in ROLES:
                for to in AUTOMATON.moves[stack, x]:
                    _better(new, to, stays + REROLE, audit + "R")
        front = _inserted(new)
    return front


def edits(initials: str, audit: str, before: str) -> tuple[list[str], str]:
    """Per row what becomes of it, and the last initial; ``before`` is the last initial of what precedes.

    One letter for each row that comes out: K kept, U and A reroled, u and a inserted; D for the row that goes.
    """
    out, held, i = [], "", 0
    for e in audit:
        if e == "I" or e == "R":
            before = "a" if before == "u" else "u"
        if e == "I":
            held += before
            continue
        if e == "K":
            before = initials[i]
        out.append(held + (before.upper() if e == "R" else e))
        held, i = "", i + 1
    if held:
        out[-1] += held
    return out, before


# --- pieces -----------------------------------------------------------------------
_PIECE = ("_key string, chunk long, begin long, blank long, duplicate long, truncated long, illegal long, initials string, "
          "starts array<int>, stops array<int>, costs array<long>, audits array<string>")
_LEGAL = ("su", "ua", "au")


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _grouped(rows, out, make, at_once: int = 1000):
    held = []
    for key, group in rows:
        held += make(key, group)
        if len(held) >= at_once:
            yield arrow_batch(out, list(zip(*held)))
            held = []
    if held:
        yield arrow_batch(out, list(zip(*held)))


def _mark(initial: str) -> str:
    """An initial as one character; a role without one is a mark of its own."""
    return initial or "\0"


def _pieces(batches, chunk: int, out):
    only()

    def make(key, group):
        group = list(group)
        rows = tuple((_mark(r[3]), BLANK if r[4] else DUPLICATE if not r[6] else CUT if r[5] else SOUND) for r in group)
        initials = "".join(r[0] for r in rows)
        # only the first rows of a piece of a partition can go on with a conversation
        starts = range(len(AUTOMATON.cells)) if group[0][2] % chunk == 0 else [0]
        found = [(s, stop, *best) for s in starts for stop, best in sorted(parse(rows, s).items())]
        faults = [f for _, f in rows]
        return [(*key, group[0][2], faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
                 _illegal(initials), initials, *map(list, zip(*found)))]

    yield from _grouped(groupby(_rows(batches), key=lambda r: r[:2]), out, make)
    parse.cache_clear()


def _illegal(initials: str) -> int:
    return sum(initials[i:i + 2] not in _LEGAL for i in range(len(initials) - 1))


_SUMMARY = ("_key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
            "begins array<long>, edits array<array<string>>")


def _summaries(batches, out):
    """Pieces of a conversation, in order, put together."""
    only()

    def make(key, group):
        counts, before = [0, 0, 0, 0], ""
        front: dict = {0: (0, "", None)}
        for _, _, begin, *faults, initials, starts, stops, costs, audits in group:
            faults[3] += _illegal(before + initials[0])
            counts = [a + b for a, b in zip(counts, faults)]
            before = initials[-1]
            new: dict = {}
            for start, stop, cost, audit in zip(starts, stops, costs, audits):
                if start in front:
                    had, text, path = front[start]
                    made = (had + cost, text + audit)
                    if stop not in new or made < new[stop][:2]:
                        new[stop] = (*made, (path, begin, initials, audit))
            front = new
        cost, audit, path = min((v for k, v in front.items() if k in AUTOMATON.accepts), key=lambda v: v[:2])
        steps = []
        while path:
            path, *step = path
            steps.append(step)
        begins, made, last = [], [], ""
        for begin, initials, piece in reversed(steps):
            out, last = edits(initials, piece, last)
            begins.append(begin)
            made.append(out)
        return [(key, *counts, cost, audit, begins, made)]

    yield from _grouped(groupby(_rows(batches), key=lambda r: r[0]), out, make)


# --- the operator -------------------------------------------------------------------
class Repaired(NamedTuple):
    """conversations   conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; one row each
    rows               conv_id, place, part, role, text; in order by (place, part)
    """

    conversations: DataFrame
    rows: DataFrame


def _key(conv_id: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with their place: ascending through each conversation, and gapless within a partition."""
    space = F.lit(" ")
    rows = rows.select(_key().alias("_key"), "conv_id", "turn", F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"))
    turn = F.asc_nulls_first("turn")
    # a prefix of the text is enough to cut by, and keeps the sampled bounds small
    rows = (rows.repartitionByRange("_key", turn, "role", F.substring("text", 1, 64))
            .sortWithinPartitions("_key", turn, "role", "text"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    return stage(rows.withColumn("place", F.monotonically_increasing_id()).withColumns({
        "initial": F.substring("role", 1, 1),
        "same": F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256),
        "blank": last == "", "cut": ~last.isin(".", "!", "?")}), "turns")


def repair(rows: DataFrame, *, chunk: int = CHUNK) -> Repaired:
    small_batches(rows.sparkSession)
    ordered = _ordered(rows)
    firsts = ordered.groupBy("_key", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    light = ordered.join(firsts, "place", "left").select(
        "_key", F.expr(f"place div {chunk}").alias("chunk"), "place", "initial", "blank", "cut",
        F.coalesce("first", F.lit(False)).alias("first"))
    pieces = (light.repartition("_key", "chunk").sortWithinPartitions("_key", "chunk", "place")
              .mapInArrow(partial(_pieces, chunk=chunk, out=arrow_schema(_PIECE)), _PIECE))
    summary = stage(pieces.repartition("_key").sortWithinPartitions("_key", "chunk").mapInArrow(partial(_summaries, out=arrow_schema(_SUMMARY)), _SUMMARY), "repairs")

    turns = ordered.groupBy("_key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    conversations = turns.join(summary.drop("begins", "edits"), "_key").drop("_key")

    # every row's edits, by its place
    step = summary.select(F.explode(F.arrays_zip("begins", "edits")).alias("p")).select(
        F.col("p.begins").alias("begin"), F.posexplode("p.edits").alias("i", "edit")).select(
        (F.col("begin") + F.col("i")).alias("place"), "edit")
    op = F.col("op")
    out = (ordered.join(step, "place").select("conv_id", "place", "role", "text", F.posexplode(F.split("edit", "")).alias("part", "op"))
           .where(op.isin("K", "U", "A", "u", "a"))
           .select("conv_id", "place", "part",
                   F.when(op == "K", F.col("role")).when(F.lower("op") == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"),
                   F.when(op.isin("u", "a"), "").otherwise(F.col("text")).alias("text")))
    return Repaired(conversations, out)


def digests(rows: DataFrame) -> DataFrame:
    """(_key, repaired_sha256) of the rows ``role:text`` joined by line feeds, as a stream of each conversation."""
    schema = "_key string, repaired_sha256 string"
    out = arrow_schema(schema)
    lines = rows.select(_key().alias("_key"), F.concat_ws(":", "role", "text").alias("line"), "place", "part")

    def run(batches):
        only()

        def make(key, group):
            digest, gap = hashlib.sha256(), b""
            for r in group:
                digest.update(gap + r[1].encode())
                gap = b"\n"
            return [(key, digest.hexdigest())]

        yield from _grouped(groupby(_rows(batches), key=lambda r: r[0]), out, make)

    return lines.repartition("_key").sortWithinPartitions("_key", "place", "part").mapInArrow(run, schema)


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by a hash of conversation and turn; NULLs count as one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       (F.crc32(name.cast("binary")) % 20).alias("_case"))
    case = F.col("_case")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(case != 0).select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
                                        text.alias("text"), copies.alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every conversation, damaged and repaired."""
    small_batches(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    done = repair(damage(rows))
    zero = F.lit(0).cast("long")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (rows.select("conv_id", _key().alias("_key")).distinct()
            .join(done.conversations.withColumn("_key", _key()).drop("conv_id"), "_key", "left")
            .join(digests(done.rows), "_key", "left")
            .select("conv_id", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))


# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, coalesce('=' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
bits AS (SELECT n, list_reduce([n] || range(8), lambda c, i:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS step FROM (SELECT unnest(range(256)) AS n)),
crc_table AS (SELECT list(step ORDER BY n) AS t FROM bits),
names AS (SELECT DISTINCT name FROM given),
hashed AS (
  SELECT name, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
    lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) % 20 AS c FROM names, crc_table),
damaged AS (
  SELECT k, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE c WHEN 3 THEN 2 ELSE 1 END)) FROM given JOIN hashed USING (name) WHERE c <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i,
    right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS last FROM damaged),
rows AS (
  SELECT k, turn, i, role, text, left(role, 1) AS x, CASE WHEN last = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) AS pair FROM placed),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(i) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY k),
shifts(st, x, nxt) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(st, nxt, edits, price, lines) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
  (0, 2, 'I', 2, chr(10) || 'user:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 2, 'I', 2, chr(10) || 'user:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 3, 'I', 2, chr(10) || 'assistant:'), (3, 2, 'I', 2, chr(10) || 'user:')),
kinds(edit) AS (VALUES ('K'), ('R'), ('D')),
parsed AS (
  SELECT k, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS lines FROM counts
  UNION ALL
  SELECT k, i, st, cost, audit, lines FROM (
    SELECT p.k, r.i, coalesce(s.nxt, n.nxt) AS st, p.cost + n.price + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END
        + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      p.audit || n.edits || edit AS audit,
      p.lines || n.lines || CASE edit WHEN 'D' THEN '' ELSE chr(10) || CASE WHEN edit = 'K' THEN role
        WHEN s.x = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS lines
    FROM parsed p JOIN rows r ON r.k = p.k AND r.i = p.i + 1 JOIN inserts n ON n.st = p.st CROSS JOIN kinds
    LEFT JOIN shifts s ON s.st = n.nxt AND edit <> 'D' AND (edit = 'R' AND s.x <> 's' OR edit = 'K' AND s.x = r.x)
    WHERE edit = 'D' OR (s.nxt IS NOT NULL AND fault NOT IN ('blank', 'duplicate')))
  QUALIFY row_number() OVER (PARTITION BY k, st ORDER BY cost, audit) = 1),
ended AS (
  SELECT p.k, p.cost + n.price AS cost, p.audit || n.edits AS audit, p.lines || n.lines AS lines
  FROM parsed p JOIN counts c ON c.k = p.k AND c.n = p.i JOIN inserts n ON n.st = p.st AND n.nxt IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY p.k ORDER BY p.cost + n.price, p.audit || n.edits) = 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM given) LEFT JOIN counts USING (k) LEFT JOIN ended USING (k)
"""
