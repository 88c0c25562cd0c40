"""Bigram language model as a weighted backoff automaton, met block by block.

States are the empty history and every history with a count (a word, or the beginning of a text).  An arc
(history, word) stands for a bigram of the training texts; every state but the empty one has a
failure arc to it.  With c the counts of the training texts, N their tokens and V their distinct tokens,

    P(w)     = (c(w) + 1) / (N + V + 1)                             arcs of the empty history
    P(w | h) = (c(h w) + STRENGTH * P(w)) / (c(h) + STRENGTH)       arc (h, w)
    failure of h:  STRENGTH / (c(h) + STRENGTH)

that is, Dirichlet smoothing, in which P(. | h) sums to 1 over V tokens and one unknown.  A text is read once
from left to right: the present state's arc for the next token is taken, or its failure and then the
empty history's arc; the log10 of the weights add up, and the token's state is the next one.

The model grows with the corpus and is never brought to one place.  Texts are cut into blocks
of documents (``BLOCK_TOKENS`` tokens, more only for a single longer document), and each block is scored
with the part of the automaton that its own bigrams can reach:

1. every block is tokenised and written, with its distinct words' hashes and local numbers;
2. it sends its distinct unigrams and bigrams, as sorted 64-bit hashes with its own training counts, to
   cells of the hash range, where the counts of all blocks are added: a hot n-gram is one entry per block;
3. the cell answers with the sums that differ from what the block knows;
4. each block builds its automaton and reads its documents.

N-grams are told apart by their 64-bit hashes: among 10^9 of them, 1 in 10^10 is expected to share one.

Defined results: a NULL or empty text is its end alone.  Repeated rows count and score as often as they come.
A NULL id has the fold of the text ``null``.  No training texts: N = V = 0, every token has weight 1, score 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ._common import arrow_batch, arrow_schema, crc_of_id, deltas, documents, hash_words, mix, only, packed, small_batches, stage, unpacked, words

BLOCK_TOKENS = 500_000
#: entries of a cell, roughly
CELL_ENTRIES = 3_000_000
STRENGTH = 500.0
FOLDS, HELD_OUT = 7, 2
#: no word holds a space
START, END = (int(h) for h in hash_words([b" start", b" end"]))
_UNI, _BI = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- blocks ---------------------------------------------------------------------
BLOCK_DDL = ("block long, ids array<long>, held array<boolean>, lengths array<int>, hashes binary, tokens binary, "
             "n_tokens long, n_train long, train_docs long")


def _block(number: int, ids: list, held: list, hashed: list[np.ndarray]) -> list:
    every, tokens, counts = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # small numbers for frequent words
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    lengths = [len(h) for h in hashed]
    return [number, ids, held, lengths, every[order].tobytes(), place[tokens].tobytes(), sum(lengths),
            sum(n for n, h in zip(lengths, held) if not h), sum(not h for h in held)]


def _blocks(rows: DataFrame) -> DataFrame:
    schema = arrow_schema(BLOCK_DDL)

    def run(batches):
        only("words")
        number = TaskContext.get().partitionId() << 32
        ids, held, hashed, size = [], [], [], 0
        for batch in batches:
            for key, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.append(hash_words(words(text)), np.uint64(END))
                if hashed and size + len(own) > BLOCK_TOKENS:
                    yield arrow_batch(schema, [[v] for v in _block(number, ids, held, hashed)])
                    number, ids, held, hashed, size = number + 1, [], [], [], 0
                ids.append(key)
                held.append(out)
                hashed.append(own)
                size += len(own)
        if hashed:
            yield arrow_batch(schema, [[v] for v in _block(number, ids, held, hashed)])

    path = f"{shared_dir(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    rows.mapInArrow(run, BLOCK_DDL).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(BLOCK_DDL).parquet(path)


class Grams:
    """Distinct unigrams and bigrams of a block: sorted keys, own training counts, and which they are."""

    def __init__(self, row: dict):
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.tokens = np.frombuffer(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        train = np.repeat(~np.array(row["held"], bool), self.lengths)
        n = len(self.hashes)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        self.first = np.cumsum(self.lengths) - self.lengths
        before[self.first] = n  # the beginning
        self.pairs, at = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        histories = np.append(self.hashes, np.uint64(START))
        keys = np.concatenate([
            mix(self.hashes + _UNI),
            mix(mix(histories[self.pairs // (n + 1)] + _BI) ^ self.hashes[self.pairs % (n + 1)])])
        counts = np.concatenate([np.bincount(self.tokens[train], minlength=n),
                                 np.bincount(at[train], minlength=len(self.pairs))])
        self.order = np.argsort(keys)
        self.keys, self.counts = keys[self.order], counts[self.order].astype(np.uint32)
        self.unigram = self.order < n

    def cells(self, cells: int) -> np.ndarray:
        """First key of each cell, and the end."""
        width = (1 << 64) // cells + 1
        bounds = np.array([min(i * width, (1 << 64) - 1) for i in range(cells)], np.uint64)
        return np.append(np.searchsorted(self.keys, bounds), len(self.keys))


# --- counting -------------------------------------------------------------------
ASK_DDL = "cell int, block long, keys binary, counts binary, unigram binary"
ANSWER_DDL = "block long, cell int, at binary, counts binary, distinct long"


def _asked(blocks: DataFrame, cells: int) -> DataFrame:
    schema = arrow_schema(ASK_DDL)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row)
                bounds = g.cells(cells)
                out = [(c, row["block"], packed(deltas(g.keys[a:b])), packed(g.counts[a:b]),
                        np.packbits(g.unigram[a:b]).tobytes())
                       for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
                yield arrow_batch(schema, list(map(list, zip(*out))))

    return blocks.select("block", "held", "lengths", "hashes", "tokens").mapInArrow(run, ASK_DDL)


def _answer(table: pa.Table) -> pa.Table:
    """Add a cell's counts up; tell each block what it does not know, and the number of distinct tokens."""
    blocks = table.column("block").to_pylist()
    keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = [unpacked(c, np.uint32) for c in table.column("counts").to_pylist()]
    unigram = np.concatenate([np.unpackbits(np.frombuffer(u, np.uint8), count=len(k)).astype(bool)
                              for u, k in zip(table.column("unigram").to_pylist(), keys)])
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    new = np.ones(len(joined), bool)
    new[1:] = joined[order[1:]] != joined[order[:-1]]
    group = np.cumsum(new) - 1
    total = np.bincount(group, np.concatenate(counts)[order])
    distinct = int(np.count_nonzero((total > 0) & unigram[order[new]]))
    sums = np.empty(len(joined))
    sums[order] = total[group]
    out, at = [], 0
    cell = table.column("cell")[0].as_py()
    for block, own in zip(blocks, counts):
        mine = sums[at:at + len(own)].astype(np.int64)
        at += len(own)
        other = np.flatnonzero(mine != own)
        out.append((block, cell, packed(deltas(other.astype(np.uint32))), packed(mine[other].astype(np.uint64)), 0))
    out[0] = (*out[0][:4], distinct)
    schema = arrow_schema_answer
    return pa.Table.from_batches([arrow_batch(schema, list(map(list, zip(*out))))], schema=schema)


arrow_schema_answer = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("at", pa.binary()),
                                 ("counts", pa.binary()), ("distinct", pa.int64())])


# --- the automaton --------------------------------------------------------------
class Automaton:
    """States: 0 the empty history, 1 the beginning, w + 2 the word w of the block."""

    def __init__(self, unigrams: np.ndarray, pairs: np.ndarray, bigrams: np.ndarray, n_train: int, distinct: int,
                 train_docs: int, strength: float = STRENGTH):
        n = len(unigrams)
        self.words = n
        p = (unigrams + 1) / (n_train + distinct + 1)
        self.base = np.log10(p)
        history = np.append(unigrams, train_docs)  # counts as histories, the beginning last
        seen = bigrams > 0
        h, w = pairs[seen] // (n + 1), pairs[seen] % (n + 1)
        weight = np.log10((bigrams[seen] + strength * p[w]) / (history[h] + strength))
        state = np.where(h == n, 1, h + 2)
        self.arcs = dict(zip((state * n + w).tolist(), weight.tolist()))
        fail = np.log10(strength / (history + strength))
        self.fail = [0.0, float(fail[n]), *fail[:n].tolist()]
        self.root = self.base.tolist()
        self.known = [i + 2 if c else 0 for i, c in enumerate(unigrams.tolist())]  # the state behind a word

    def read(self, tokens: list[int]) -> float:
        arcs, fail, root, known, n = self.arcs, self.fail, self.root, self.known, self.words
        state, total = 1, 0.0
        for w in tokens:
            weight = arcs.get(state * n + w)
            total += fail[state] + root[w] if weight is None else weight
            state = known[w]
        return total


def _scored(row: dict, answers: list[dict], cells: int, n_train: int, distinct: int, train_docs: int) -> list[list]:
    g = Grams(row)
    counts = g.counts.astype(np.int64)
    bounds = g.cells(cells)
    for a in answers:
        at = np.cumsum(unpacked(a["at"], np.uint32), dtype=np.int64)
        counts[bounds[a["cell"]] + at] = unpacked(a["counts"], np.uint64).astype(np.int64)
    by_gram = np.empty_like(counts)
    by_gram[g.order] = counts
    n = len(g.hashes)
    automaton = Automaton(by_gram[:n], g.pairs, by_gram[n:], n_train, distinct, train_docs)
    known = (by_gram[:n] > 0)[g.tokens]
    base = automaton.base[g.tokens]
    out = []
    for i, (a, length) in enumerate(zip(g.first.tolist(), g.lengths.tolist())):
        own = slice(a, a + length)
        out.append((row["ids"][i], row["held"][i], length, int(known[own].sum()), n_train, float(base[own].sum()),
                    automaton.read(g.tokens[own].tolist())))
    return list(map(list, zip(*out)))


def score(docs: DataFrame, held_out, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    held_out   condition; its rows are scored and not learned from
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held"), F.col(text).alias("text"))
    blocks = _blocks(rows)
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("train_docs")).first()
    n_tokens, n_train, train_docs = (v or 0 for v in sums)
    cells = max(16, -(-2 * n_tokens // CELL_ENTRIES))
    answers = stage(_asked(blocks, cells).groupBy("cell").applyInArrow(_answer, ANSWER_DDL), "answers")
    distinct = answers.agg(F.sum("distinct")).first()[0] or 0
    ddl = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
    schema = arrow_schema(ddl)

    def read(own, found):
        out = []
        for row in own.to_pylist():
            out.append(arrow_batch(schema, _scored(row, found.to_pylist(), cells, n_train, distinct, train_docs)))
        return pa.Table.from_batches(out, schema=schema)

    return blocks.drop("n_tokens", "n_train", "train_docs").groupBy("block") \
        .cogroup(answers.drop("distinct").groupBy("block")).applyInArrow(read, ddl) \
        .withColumnRenamed("doc_id", id_column)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: scores of all documents by the model of six sevenths of them."""
    return score(documents(spark, sf_dir), F.pmod(crc_of_id("doc_id"), F.lit(FOLDS)) == HELD_OUT)
