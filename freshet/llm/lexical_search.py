"""Ranked lexical search: all item terms in one Aho-Corasick automaton that is run over the documents.

``search(docs, items)`` gives every item its ``TOP`` best documents: (item_id, rank, doc_id, score).
There is no index of the documents.  The automaton of the items' terms goes to every task; each term
stands in it between two boundary marks, and every character of a text that belongs to no term is a
boundary, so a match is a whole term.  One traversal of a text counts all terms in it.  The counts are
written, document frequencies are counted from them, and a second pass adds up the scores: each term
is an output of the automaton that leads to the items holding it.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
case.  With N documents that hold a term at all, L terms in them, n terms in the document, df documents
with the term, tf occurrences:  m = 50 + 50 n N div L,  w = floor(1000 ln((2N+2)/(2df+1))),  score =
sum of w * (10^9 tf div (1000 tf + 20 m)) over the item's terms, once each.

NULL and empty texts and texts without a term count nowhere.  Every row is a document of its own, so
repeated rows are ranked one after the other; equal scores go by ascending doc_id, NULL last.  Rows of one
item_id (NULL is one, too) are one item with the terms of all.  Items without a term, or whose terms
occur nowhere, have no rows.  Texts may be of any length; ids of documents are whole numbers.

Items are taken in blocks whose terms have ``BLOCK_BYTES`` together, so the automaton is bounded however
many items there are; each block is one pass over the documents.  An item is never cut.  A task keeps
the best documents of each item only; the last selection is a window over these.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, documents, map_texts, only, small_batches, stage

TOP = 50
#: bytes of the terms of one block of items
BLOCK_BYTES = 2 << 20
#: sums of (document, item) held at once while scoring
CELLS = 1 << 21

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: of UTF-8 bytes: separators to spaces, A-Z to a-z, all else stays
_GUARD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def guarded(text: str) -> bytes:
    """Terms in order, each between spaces."""
    return b" " + text.encode().translate(_GUARD) + b" "


def automaton(terms: list[str]):
    """Automaton over the bytes of guarded texts; the value of a term is its place in ``terms``."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        built.add_word(f" {term} ".encode().decode("latin-1"), i)
    built.make_automaton()
    return built


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term; ids are places in ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    built: list = []

    def scan(ids, texts):
        if not built:
            built.append(automaton(shared.value))
        out = []
        for i, text in zip(ids, texts):
            line = guarded(text or "")
            n = len(line.split())
            if n:
                found = Counter(map(itemgetter(1), built[0].iter(line.decode("latin-1"))))
                out.append((i, n, list(found.keys()), list(found.values())))
        return list(zip(*out)) or [[], [], [], []]

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), scan,
                     "doc_id long, n long, ids array<int>, tfs array<int>", ())


def weights(hits: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each term."""
    docs, total = hits.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(n_terms, np.int64)
    for term, n in hits.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count("*")).collect():
        df[term] = n
    return docs, total or 0, np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()],
                                      np.int64)


class _Best:
    """The ``top`` best documents of each item, from any number of batches."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)  # a score below this cannot enter any more
        self.kept = [np.empty(0, np.int64)] * 4
        self.fresh: list = []
        self.waiting = 0

    def add(self, item, score, doc, null) -> None:
        self.fresh.append((item, score, doc, null))
        self.waiting += len(item)
        if self.waiting > max(8 * self.top * len(self.least), 1 << 16):
            self.prune()

    def prune(self) -> None:
        item, score, doc, null = (np.concatenate(c) for c in zip(self.kept, *self.fresh))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(starts, np.diff(starts, append=len(item)))
        order = order[rank < self.top]
        self.kept = [item[rank < self.top], score[order], doc[order], null[order]]
        last = rank == self.top - 1
        full = item[last]
        self.least[full] = np.maximum(self.least[full], self.kept[1][rank[rank < self.top] == self.top - 1])
        self.fresh, self.waiting = [], 0


def score_items(hits: DataFrame, items: list, item_type: str, places: list[list[int]], total: tuple[int, int],
                weight: np.ndarray, top: int) -> DataFrame:
    """Best documents of each item and task: (item_id, doc_id, score)."""
    n_docs, n_all = total
    # outputs of the automaton: items of term t are out[start[t]:start[t + 1]]
    flat = np.array([(t, i) for i, p in enumerate(places) for t in p], np.int64).reshape(-1, 2)
    flat = flat[np.argsort(flat[:, 0], kind="stable")]
    start = np.searchsorted(flat[:, 0], np.arange(len(weight) + 1))
    schema = f"item_id {item_type}, doc_id long, score long"
    out = arrow_schema(schema)
    shared = hits.sparkSession.sparkContext.broadcast((items, flat[:, 1].copy(), start, weight))
    small_batches(hits.sparkSession)

    def run(batches):
        only()
        items, leads, start, weight = shared.value
        best = _Best(len(items), top)
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.where(null == 1, 0, np.nan_to_num(doc)).astype(np.int64) if null.any() else doc.astype(np.int64)
            n = b.column(1).to_numpy()
            m = 50 + 50 * n * n_docs // n_all
            term = b.column(2).flatten().to_numpy().astype(np.int64)
            tf = b.column(3).flatten().to_numpy().astype(np.int64)
            sizes = b.column(2).value_lengths().to_numpy()
            row = np.repeat(np.arange(len(doc)), sizes)
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            fan = start[term + 1] - start[term]
            work = np.concatenate([[0], np.cumsum(np.bincount(row, fan, len(doc)).astype(np.int64) + len(items))])
            first = 0
            while first < len(doc):  # as many documents as fit, one at least
                last = max(first + 1, int(np.searchsorted(work, work[first] + CELLS, "right")) - 1)
                at = slice(*np.searchsorted(row, [first, last]))
                each = fan[at]
                stop = np.cumsum(each)
                lead = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start[term[at]] - (stop - each), each)
                sums = np.zeros((last - first) * len(items), np.int64)
                np.add.at(sums, np.repeat((row[at] - first) * len(items), each) + leads[lead], np.repeat(part[at], each))
                r, i = np.nonzero(sums.reshape(last - first, -1) >= best.least)
                if len(r):
                    best.add(i, sums[r * len(items) + i], doc[first + r], null[first + r])
                first = last
        if best.fresh:
            best.prune()
        item, score, doc, null = best.kept
        ids = [None if x else d for d, x in zip(doc.tolist(), null.tolist())]
        yield arrow_batch(out, [[items[i] for i in item.tolist()], ids, score])

    return hits.mapInArrow(run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    lower = F.translate("text", _UPPER, _LOWER)
    return items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item.

    docs   doc_id, text        items   item_id, text
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = stage(item_terms(items), "terms")
    item_type = dict(terms.dtypes)["item_id"]
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = spark.createDataFrame([], f"item_id {item_type}, doc_id long, score long")
    for block in range(blocks):
        held = (terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id")
                .agg(F.sort_array(F.collect_set("term")).alias("terms")).collect())
        if not held:
            continue
        names = sorted({t for r in held for t in r.terms})
        at = {t: i for i, t in enumerate(names)}
        hits = stage(count_terms(docs, names), "hits")
        n_docs, n_all, weight = weights(hits, len(names))
        if n_docs:
            found = found.union(score_items(hits, [r.item_id for r in held], item_type,
                                            [[at[t] for t in r.terms] for r in held], (n_docs, n_all), weight, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the 50 best documents of every benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT doc_id, r, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS all_terms FROM held),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total GROUP BY term, docs),
part AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // all_terms))) AS part
  FROM tf JOIN weight USING (term) JOIN held USING (r), total),
scores AS (
  SELECT item_id, r, sum(part)::BIGINT AS score FROM part JOIN wanted USING (term) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
  FROM scores JOIN held USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
