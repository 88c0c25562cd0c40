"""N-gram Jaccard self-join by prefix trees, with the components its links make.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold.

1. Documents with the same set form a class, of which one document stands for all.
2. Shingles get one global order, rare ones first.  A shingle is at most as frequent as its counter and as
   the counter of its rarest word; the less of the two ranks it.  Each kind has a table of 2^SLOT_BITS counters
   over all documents: the order only has to be the same everywhere, so counters may be shared; their
   size is fixed, and they are all that is broadcast.  Where shingles are so many that their counters
   say little, those of the words still tell, as words are far fewer.
3. Sets of n shingles that link share one of the first n - ceil(threshold * n) + 1 of each.  Classes that meet
   on such a shingle are candidates; the components of "meets" are the cells.  Every link lies within a
   cell, and a class belongs to one cell at most, so its set is sent once.  Of those that share a
   shingle only neighbours by size meet, and only where their sizes allow a link: runs of sizes
   in which each is at least the threshold's share of the next.  A task joins its own classes to runs and
   sends one class and the range of sizes for each, packed in sorted arrays by ranges of the hash, so
   that a hot shingle is a few entries per task.
4. Unlike sets that meet by chance may join cells into one that holds most of the corpus.  Cells are
   therefore sifted: a set has a sketch, the parities of its members by bits of their hashes, and two sketches differ
   in no more bits than the sets in members.  Of a cell stay the components of what the sketches allow to link.
5. A cell's sets are stored in a trie in global order, frequent shingles first so that copies share their
   paths.  Each set walks the trie once: the overlap with a path is carried down to all sets
   below it, and a subtree is left as soon as what remains of the set and of the subtree's
   sets cannot reach the overlap their lengths call for.  Each pair is met from one end only.
6. Cells of more than ``BLOCK`` classes are cut by size bands (only neighbouring ones can link) and within them
   by hash; every pair of blocks gets a task, so each pair of classes meets exactly once.
7. A task gives each class its number of links and a root of its local component, not its pairs; the
   components of these are those of the links.

Defined results: no text, an empty text or one without words has no shingle, links with nothing and is
its own component.  Fewer words than the width make one shingle.  Repeated rows are copies.  A
NULL id has a set but no component, and links nothing.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._clusters import components
from ._common import (
    arrow_batch, arrow_schema, deltas, documents, hash_words, only, opener, packed, presser, runs, shingles, small_batches, stage,
    unpacked, words,
)

SLOT_BITS, CHUNK_BITS, FAN_IN = 22, 18, 64
BLOCK = 600
#: keys that a task gathers before it sends them, and keys of a range, roughly
HELD_KEYS, RANGE_KEYS = 1_500_000, 2_000_000
#: sketches of a block, and classes that are sifted together, roughly
SIFTED, BUCKET = 8_000, 5_000


# --- passes over the texts ------------------------------------------------------
def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _profile(rows: DataFrame, width: int, num: int, both: int) -> DataFrame:
    """Per document: size, digest and sketch of its set.  Per task: counters of its shingles and words, in chunks."""
    ddl = "doc_id long, n long, digest binary, sketch binary, mark long, task int, chunk int, counts binary"
    schema = arrow_schema(ddl)

    def run(batches):
        only("words")
        import xxhash

        counts = np.zeros((2, 1 << SLOT_BITS), np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes = [hash_words(words(t)) for t in texts]
            sets = [np.unique(runs(h, width)) for h in hashes]
            for kind, each in enumerate((sets, hashes)):
                if each:
                    counts[kind] += np.bincount(_slots(np.concatenate(each)), minlength=1 << SLOT_BITS).astype(np.uint32)
            n = len(ids)
            yield arrow_batch(schema, [ids, [len(s) for s in sets],
                                       [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                                       [sketch(s, num, both) for s in sets],
                                       batch.column(2), [None] * n, [None] * n, [None] * n])
        task, press = TaskContext.get().partitionId(), presser()
        for c, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)):
            if part.any():
                yield arrow_batch(schema, [[None]] * 5 + [[task], [c], [press(packed(part))]])

    return rows.mapInArrow(run, ddl)


def _rarity(profile: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up in a tree: 2^SLOT_BITS numbers for shingles, and as many for words."""
    ddl = "task int, chunk int, counts binary"
    schema = arrow_schema(ddl)

    def add(table):
        total, unpress = np.zeros(1 << CHUNK_BITS, np.uint64), opener()
        for part in table.column("counts"):
            total += unpacked(unpress(part.as_py()), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pa.Table.from_batches([arrow_batch(schema, [
            [table.column("task")[0].as_py()], [table.column("chunk")[0].as_py()], [presser()(packed(total))]])],
            schema=schema)

    counts = profile.where("counts is not null").select("task", "chunk", "counts")
    tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        counts = counts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")) \
            .groupBy("task", "chunk").applyInArrow(add, ddl)
        tasks = -(-tasks // FAN_IN)
        if tasks == 1:
            break
        counts = stage(counts, "counts")
    out = np.zeros((2 << SLOT_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    unpress = opener()
    for r in counts.collect():  # one row a chunk
        out[r["chunk"]] = unpacked(unpress(r["counts"]), np.uint32)
    return out.reshape(2, -1)


def _rarest_first(hashes: np.ndarray, width: int, rarity: np.ndarray) -> np.ndarray:
    """The distinct shingles of a text by its words' hashes."""
    every = runs(hashes, width)
    word, rare = rarity[1][_slots(hashes)], rarity[0][_slots(every)]
    for i in range(min(width, len(hashes))):
        np.minimum(rare, word[i:i + len(every)], out=rare)
    every = every[np.lexsort((every, rare))]
    return every[np.append(True, every[1:] != every[:-1])]


# --- the sketches ---------------------------------------------------------------
def sketch(own: np.ndarray, num: int, both: int) -> bytes:
    """Parities of the number of members by the low bits of their hashes.

    As many bits, in powers of two, as make four of each member in which sets of this size that link may differ: sets
    without a common member differ in half of the bits, give or take.
    """
    bits = max(64, 1 << (-(-8 * len(own) * (both - 2 * num) // both) - 1).bit_length())
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _folded(data: bytes, length: int) -> np.ndarray:
    """The sketch of the same set in so many bytes."""
    out = np.frombuffer(data, np.uint64)
    while 8 * len(out) > length:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def sift(sizes: np.ndarray, sketches: list[bytes], num: int, both: int) -> np.ndarray:
    """For every set the first of its component, where those meet whose sketches allow a link; sizes ascend.

    A set taken into a component is compared once with those that are in none yet.
    """
    den, total = both - num, len(sizes)
    lengths = np.array([len(s) for s in sketches])
    # a sketch's length grows with the size: for each length the sets that have it and the larger ones they may meet
    firsts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1]))
    tables = []
    for a, b in zip(firsts, np.append(firsts[1:], total)):
        end = int(np.searchsorted(sizes * num, sizes[b - 1] * den, "right"))
        tables.append((int(a), int(b), np.stack([_folded(s, lengths[a]) for s in sketches[a:end]], 1)))
    low, high = np.searchsorted(sizes * den, sizes * num, "left"), np.searchsorted(sizes * num, sizes * den, "right")
    level = np.searchsorted(firsts, np.arange(total), "right") - 1
    root, free = np.full(total, -1), np.ones(total, bool)
    for seed in range(total):
        todo = [seed] if free[seed] else []
        free[todo] = False
        while todo:
            i = todo.pop()
            root[i] = seed
            for k in range(int(level[low[i]]), int(level[i]) + 1):
                a, b, table = tables[k]
                x, y = max(a, int(low[i])), int(high[i]) if k == level[i] else b
                if not free[x:y].any():
                    continue
                apart = np.bitwise_count(table[:, x - a:y - a] ^ table[:, i - a:i - a + 1]).sum(0, dtype=np.int64)
                near = x + np.flatnonzero(free[x:y] & (apart * both <= (den - num) * (sizes[x:y] + sizes[i])))
                free[near] = False
                todo += near.tolist()
    return root


# --- the trie -------------------------------------------------------------------
class Trie:
    """Sets of ascending ranks as a compressed trie."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sizes = [len(s) for s in sets]
        # a node: [tokens from its parent down, children, sets ending here, least size, largest size, depth, first place]
        self.root = [np.empty(0, np.uint32), [], [], 0, 0, 0, 0]
        self.places = [0] * len(sets)
        path, before = [self.root], None
        for place, i in enumerate(order):
            self.places[i] = place
            own = sets[i]
            shared = 0
            if before is not None:
                m = min(len(before), len(own))
                differ = np.flatnonzero(before[:m] != own[:m])
                shared = int(differ[0]) if len(differ) else m
            while path[-1][5] > shared:
                low = path.pop()
                if path[-1][5] < shared:  # cut the edge
                    keep = shared - path[-1][5]
                    upper = [low[0][:keep], [low], [], 0, 0, shared, low[6]]
                    low[0] = low[0][keep:]
                    path[-1][1][-1] = upper
                    path.append(upper)
            if len(own) > shared:
                leaf = [own[shared:], [], [i], 0, 0, len(own), place]
                path[-1][1].append(leaf)
                path.append(leaf)
            else:
                path[-1][2].append(i)
            before = own
        self._sizes()

    def _sizes(self):
        todo, seen = [self.root], []
        while todo:
            node = todo.pop()
            seen.append(node)
            todo += node[1]
        for node in reversed(seen):
            below = [self.sizes[i] for i in node[2]]
            lows = below + [c[3] for c in node[1]]
            highs = below + [c[4] for c in node[1]]
            node[3], node[4] = min(lows, default=0), max(highs, default=0)

    def reach(self, probe: np.ndarray, mark: np.ndarray, num: int, both: int, before: int | None = None) -> list[int]:
        """Sets whose similarity with ``probe`` is num / (both - num) or more; mark[t]: t is in the probe.

        A pair needs an overlap of num / both of the sum of its sizes.  With ``before`` only sets at
        earlier places in the trie's order count, and subtrees behind are not entered.
        """
        n, found = len(probe), []
        least, most = -(-n * num // (both - num)), n * (both - num) // num
        todo = [(c, 0) for c in self.root[1]]
        while todo:
            node, overlap = todo.pop()
            tokens, children, ends, low, high, depth, place = node
            if high < least or low > most or before is not None and place >= before:
                continue
            need = -(-num * (n + max(low, least)) // both)
            above = depth - len(tokens)
            if overlap + min(n - overlap, high - above) < need:
                continue
            overlap += int(np.count_nonzero(mark[tokens]))
            # what the probe has behind the path's last token, what the longest set has below
            if overlap + min(n - int(np.searchsorted(probe, tokens[-1], "right")), high - depth) < need:
                continue
            for i in ends:
                if both * overlap >= num * (n + self.sizes[i]) and (before is None or self.places[i] < before):
                    found.append(i)
            for c in children:
                todo.append((c, overlap))
        return found


def pairs(sets: list[np.ndarray], num: int, both: int, sides: list[int] | None = None):
    """For every set the sets it links with, each pair from one of its ends only.

    sides   0 (or None): all pairs among these; the sets of sides 0 and 1 make the trie, those of side 2 walk it
    """
    every, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.uint32)
    rank[np.lexsort((every, -counts))] = np.arange(len(every), dtype=np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets])
    ranked = [np.sort(rank[inverse[a:b]]) for a, b in zip(at, at[1:])]
    sides = sides or [0] * len(sets)
    held = [i for i, side in enumerate(sides) if side < 2]
    trie, mark = Trie([ranked[i] for i in held]), np.zeros(len(every), bool)
    place = dict(zip(held, trie.places))
    for i, own in enumerate(ranked):
        if sides[i] != 1:
            mark[own] = True
            yield i, [held[j] for j in trie.reach(own, mark, num, both, place[i] if sides[i] == 0 else None)]
            mark[own] = False


def links(sets: list[np.ndarray], num: int, both: int):
    """For every set the sets it links with, itself left out."""
    out: list[list[int]] = [[] for _ in sets]
    for i, others in pairs(sets, num, both):
        out[i] += others
        for j in others:
            out[j].append(i)
    return enumerate(out)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


# --- on Spark -------------------------------------------------------------------
SENT_DDL = "range int, keys binary, owner binary, low binary, more binary, nodes binary, ties binary"


def _runs(keys: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int):
    """Join what shares a key in runs of sizes that can link: (first of each run, its largest size, ties).

    Entries are ranges of sizes; the ties name entries that are in one run.
    """
    order = np.lexsort((nodes, low, keys))
    keys, low, high = keys[order], low[order], high[order]
    same = keys[1:] == keys[:-1]
    # largest size so far within the key: sizes stay below 2^40
    group = np.concatenate([[0], np.cumsum(~same)])
    reach = np.maximum.accumulate(high + (group << 40)) - (group << 40)
    new = np.ones(len(keys), bool)
    new[1:] = ~same | (reach[:-1] * den < low[1:] * num)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1
    return order[first], reach[last], np.stack([order[~new], order[first[run[~new]]]], 1)


def _sent(keys: np.ndarray, owner: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, ranges: int,
          num: int, den: int) -> list[tuple]:
    """Rows of one task: runs of its nodes by key, and ties of the nodes in them."""
    own = sizes[owner]
    first, most, tied = _runs(keys, nodes[owner], own, own, num, den)
    ties = np.unique(np.stack([nodes[owner[tied[:, 0]]], nodes[owner[tied[:, 1]]]], 1), axis=0)
    keys, owner, low = keys[first], owner[first], own[first]
    width = (1 << 64) // ranges + 1
    bounds = np.append(np.searchsorted(keys, np.array(
        [min(i * width, (1 << 64) - 1) for i in range(ranges)], np.uint64)), len(keys))
    out = []
    for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b > a:
            there, at = np.unique(owner[a:b], return_inverse=True)
            out.append((r, packed(deltas(keys[a:b])), packed(at.astype(np.uint32)), packed(low[a:b].astype(np.uint32)),
                        packed((most[a:b] - low[a:b]).astype(np.uint32)), nodes[there].tobytes(), None))
    if len(ties):
        out.append((int(ties[0, 0] % np.uint64(ranges)), *[None] * 5, ties.tobytes()))
    return out


def _met(table: pa.Table, num: int, den: int) -> pa.Table:
    """Ties of the nodes that meet on a key of this range, and those that the tasks found."""
    ties, keys, nodes, low, high = [np.empty((0, 2), np.uint64)], [], [], [], []
    for row in table.to_pylist():
        if row["ties"] is not None:
            ties.append(np.frombuffer(row["ties"], np.uint64).reshape(-1, 2))
        else:
            keys.append(np.cumsum(unpacked(row["keys"], np.uint64), dtype=np.uint64))
            nodes.append(np.frombuffer(row["nodes"], np.uint64)[unpacked(row["owner"], np.uint32)])
            low.append(unpacked(row["low"], np.uint32).astype(np.int64))
            high.append(low[-1] + unpacked(row["more"], np.uint32))
    if keys:
        node = np.concatenate(nodes)
        tied = _runs(np.concatenate(keys), node, np.concatenate(low), np.concatenate(high), num, den)[2]
        ties.append(np.stack([node[tied[:, 0]], node[tied[:, 1]]], 1))
    found = np.unique(np.concatenate(ties), axis=0).view(np.int64)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _cells(rows: DataFrame, firsts, ranges: int, num: int, den: int) -> DataFrame:
    """(node, cell) of the nodes that meet another; ``firsts`` gives (keys of all texts, counts, nodes, sizes)."""
    schema = arrow_schema(SENT_DDL)

    def run(batches):
        only("words")
        held, owners, nodes, sizes, size = [], [], [], [], 0
        for batch in batches:
            keys, counts, own, n = firsts(batch.column(1).to_pylist())
            sizes.append(n)
            owners.append(np.repeat(np.arange(len(own)) + sum(map(len, nodes)), counts))
            held.append(keys)
            nodes.append(own)
            size += len(keys)
            if size > HELD_KEYS:
                yield from sent(held, owners, nodes, sizes)
                held, owners, nodes, sizes, size = [], [], [], [], 0
        if size:
            yield from sent(held, owners, nodes, sizes)

    def sent(*parts):
        for row in _sent(*map(np.concatenate, parts), ranges, num, den):
            yield arrow_batch(schema, [[v] for v in row])

    ties = rows.mapInArrow(run, SENT_DDL).groupBy("range").applyInArrow(lambda t: _met(t, num, den), "a long, b long")
    return components(ties).select("node", F.col("component").alias("cell"))


def _blocks(members: DataFrame, limit: float, block: int, carried: list[str]) -> DataFrame:
    """Rows (rep, cell, n, ``carried``) once per task they go to, with ``task`` and ``side``, cells beyond ``block`` in parts.

    side   0 and 1: the trie's sets, 0 also to be compared among themselves; 2: only compared with the trie.
           A block meets itself where it meets the next one, not in a task of its own
    """
    band = F.floor(F.log("n") / float(np.log(1 / limit))).cast("int")
    sized = members.withColumn("band", band)
    cells = sized.groupBy("cell", "band").agg(F.count("*").alias("m"))
    whole = cells.groupBy("cell").agg(F.sum("m").alias("all"))
    small = sized.join(whole.where(F.col("all") <= block).select("cell"), "cell") \
        .select(*carried, F.concat_ws(":", "cell").alias("task"), F.lit(0).alias("side"))
    cuts = cells.join(whole.where(F.col("all") > block).select("cell"), "cell") \
        .withColumn("cuts", F.ceil(F.col("m") / block).cast("int"))
    near = cuts.select("cell", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    under = cuts.select("cell", (F.col("band") + 1).alias("band"), F.col("cuts").alias("below"))
    large = sized.join(cuts.select("cell", "band", "cuts"), ["cell", "band"]) \
        .join(near, ["cell", "band"], "left").join(under, ["cell", "band"], "left") \
        .withColumn("cut", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))

    above, below, last = (F.coalesce(c, F.lit(0)) for c in (F.col("above"), F.col("below"), F.col("cuts") - 1))

    def to(count, first_band, mine_first):
        """Tasks against every block of a band."""
        return F.transform(
            F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
            lambda j: F.struct(
                F.concat_ws(":", F.col("cell").cast("string"), first_band.cast("string"), F.lit("n"),
                            *((F.col("cut").cast("string"), j.cast("string")) if mine_first
                              else (j.cast("string"), F.col("cut").cast("string")))).alias("task"),
                (F.when(j == F.pmod("cut", F.greatest(above, F.lit(1))), 0).otherwise(1) if mine_first else F.lit(2)).alias("side")))

    # within the band: with each other block from the lower number's side; with itself only where none is to follow
    alone = (above == 0) & (F.col("cut") == last)
    inside = F.transform(F.filter(F.sequence(F.lit(0), last), lambda j: (j != F.col("cut")) | alone), lambda j: F.struct(
        F.concat_ws(":", F.col("cell").cast("string"), F.col("band").cast("string"), F.lit("i"),
                    F.least(j, F.col("cut")).cast("string"), F.greatest(j, F.col("cut")).cast("string")).alias("task"),
        F.when((j == F.col("cut")) | (above == 0) & (j == F.col("cut") + 1), 0)
        .when(F.col("cut") < j, 1).otherwise(2).alias("side")))
    tasks = F.concat(inside, to(above, F.col("band"), True), to(below, F.col("band") - 1, False))
    cut = large.select(*carried, F.explode(tasks).alias("t")).select(*carried, "t.task", "t.side")
    return small.union(cut)


def _sifted(members: DataFrame, num: int, both: int) -> DataFrame:
    """(rep, cell) of the members that may link with another by their sketches."""
    ddl = "rep long, root long"
    schema = arrow_schema(ddl)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("n", "ascending"), ("rep", "ascending")])
        reps, sizes = table.column("rep").to_numpy(), table.column("n").to_numpy()
        sketches, tasks = table.column("sketch").to_pylist(), table.column("task").to_pylist()
        roots, a = [], 0
        for b in range(1, len(tasks) + 1):
            if b == len(tasks) or tasks[b] != tasks[a]:
                roots.append(a + sift(sizes[a:b], sketches[a:b], num, both))
                a = b
        roots = np.concatenate(roots)
        return pa.Table.from_batches([arrow_batch(schema, [reps, reps[roots]])], schema=schema)

    buckets = max(16, -(-members.count() // BUCKET))
    tasks = _blocks(members.select("rep", "cell", "n", "sketch"), num / (both - num), SIFTED, ["rep", "n", "sketch"]) \
        .withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(buckets)))
    ties = tasks.groupBy("bucket").applyInArrow(join, ddl)
    return components(ties.select(F.col("rep").alias("a"), F.col("root").alias("b"))) \
        .select(F.col("node").alias("rep"), F.col("component").alias("cell"))


def cluster(docs: DataFrame, *, width: int, threshold: str | float, id_column: str = "doc_id",
            text: str = "text", keys=None, keys_per_set: int = 0, mark=None) -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id) of every row of ``docs``.

    class_id   least id with the same set; n_links: rows that link with this one, copies included
    keys       (set, text) -> 64-bit keys on which sets that link meet; None takes the prefixes
    keys_per_set  how many these are
    mark       an expression over ``docs`` (a long) to carry along as column ``mark``
    """
    small_batches(docs.sparkSession)
    limit = Fraction(str(threshold))
    num, den = limit.numerator, limit.denominator
    both = num + den
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       (F.lit(None) if mark is None else mark).cast("long").alias("mark"))
    profile = stage(_profile(rows, width, num, both), "profile")
    sized = profile.where("digest is not null").select("doc_id", "n", "digest", "mark")
    rows = rows.drop("mark")
    classes = profile.where("n > 0 and doc_id is not null").groupBy("digest") \
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"),
             F.first("sketch").alias("sketch"))
    # a number of its own, as an id may stand on several texts; written, so it stays the same
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rarity = None if keys else docs.sparkSession.sparkContext.broadcast(_rarity(profile))

    def firsts(texts):
        import xxhash

        met, nodes, sizes = [], [], []
        for t in texts:
            hashes = hash_words(words(t))
            own = np.unique(runs(hashes, width))
            nodes.append(int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "big"))
            n = len(own)
            sizes.append(n)
            if n and keys:
                own = keys(own, t)
            elif n:
                own = _rarest_first(hashes, width, rarity.value)[:n - -(-n * num // (both - num)) + 1]
            met.append(own)
        return np.concatenate(met), [len(k) for k in met], np.array(nodes, np.uint64), np.array(sizes, np.int64)

    per_set = F.lit(keys_per_set) if keys else F.col("n") - F.ceil(F.col("n") * num / (both - num)) + 1
    total = sized.where("n > 0").agg(F.sum(per_set)).first()[0] or 0
    # classes that share the first half of a digest are one node: that can only widen a cell
    node = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
    cells = _cells(rows, firsts, max(16, -(-int(total) // RANGE_KEYS)), num, den)
    met = stage(classes.withColumn("node", node).join(cells, "node"), "met")
    members = stage(met.drop("cell", "node", "sketch").join(_sifted(met, num, both), "rep"), "members")
    linked = _linked(rows, members, width, num, both)
    top = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = stage(classes.join(counted, "rep", "left")
                  .join(top.select(F.col("node").alias("rep"), "component"), "rep", "left")
                  .select("digest", F.col("least").alias("class_id"), F.coalesce("component", "rep").alias("component"),
                          (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    ids = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(ids, "component").drop("component")
    known = F.col("n") > 0
    joined = sized.join(named, (sized["digest"] == named["digest"]) & known & F.col("doc_id").isNotNull(), "left")
    return joined.select(
        F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"), *(["mark"] if mark is not None else []))


def _pressed(rows: DataFrame) -> DataFrame:
    """(doc_id, body) of the rows that have a text, compressed as they are sent twice."""
    ddl = "doc_id long, body binary"
    schema = arrow_schema(ddl)

    def run(batches):
        press = presser()
        for batch in batches:
            bodies = batch.column(1).cast(pa.large_binary())
            yield arrow_batch(schema, [batch.column(0), [press(b.as_buffer()) for b in bodies]])

    return rows.where("text <> ''").select("doc_id", "text").mapInArrow(run, ddl)


def _linked(rows: DataFrame, members: DataFrame, width: int, num: int, both: int) -> DataFrame:
    """(rep, links, root) from every task a class takes part in."""
    tasks = _blocks(members.select("rep", "cell", "copies", "n"), num / (both - num), BLOCK, ["rep", "copies", "n"]) \
        .groupBy("rep").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    wanted = members.join(tasks, "rep").select(F.col("least").alias("doc_id"), "rep", "copies", "digest", "tasks")
    # texts are half the size of their sets; those of one id that are not the class's own are told by the digest
    sent = _pressed(rows).join(wanted, "doc_id").select("rep", "copies", "digest", "body", F.explode("tasks").alias("t")) \
        .select("rep", "copies", "digest", "body", "t.side", "t.task")
    ddl = "rep long, links long, root long"
    schema = arrow_schema(ddl)

    def join(table):
        import xxhash

        only("words")
        reps, sides, copies, found = [], [], [], []
        unpress = opener()
        for row in table.to_pylist():
            own = shingles(words(unpress(row["body"]).decode()), width)
            if row["rep"] not in reps[-1:] and xxhash.xxh3_128_digest(own.tobytes()) == row["digest"]:
                reps.append(row["rep"])
                sides.append(row["side"])
                copies.append(row["copies"])
                found.append(own)
        parent, total = list(range(len(reps))), [0] * len(reps)
        for i, others in pairs(found, num, both, sides):
            for j in others:
                total[i] += copies[j]
                total[j] += copies[i]
                a, b = _root(parent, i), _root(parent, j)
                parent[max(a, b)] = min(a, b)
        roots = [reps[_root(parent, i)] for i in range(len(reps))]
        return pa.Table.from_batches([arrow_batch(schema, [reps, total, roots])], schema=schema)

    return stage(sent.groupBy("task").applyInArrow(lambda t: join(t.sort_by("rep")), ddl), "linked")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: three-word shingles, similarity 0.9."""
    return cluster(documents(spark, sf_dir), width=3, threshold="0.9")
