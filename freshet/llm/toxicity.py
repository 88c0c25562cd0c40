"""Toxicity by non-negative positive-unlabelled learning.

Known are some toxic documents (P) and documents at large (U), which hold toxic ones too in a share
``prior``.  The classifiers minimise the non-negative estimate of the risk

    prior * E_P[loss(+z)]  +  max(0, E_U[loss(-z)] - prior * E_P[loss(-z)])

with the logistic loss: what P would add to U's negative part is taken out again, and where that turns
it negative (over-fitting) the step goes the other way.  Two stages learn so, one after the other:

1. words: a linear classifier over hashed words and word starts (4, 5 and 6 bytes), a document
   being the mean of its distinct words' features;
2. documents: a linear classifier over how high a document's words score: the highest, and the mean of the
   three highest (of what is above 0).

A few words thus decide whatever the length of the text around them.

Training uses a bounded sample (``MAX_TOXIC`` confirmed, ``MAX_UNLABELLED`` at large, by a hash of the id);
its ids and the weights (of features the sample has) are all that is broadcast.  Every document is scored, over
its whole text, and only its text counts.

Defined results: NULL and empty texts score as a text without known words does.  Repeated rows get
repeated scores, a NULL id stays (its fold is that of the text ``null``).  Labels with NULL count
as absent, repeated labels by their highest.  No documents: no rows.  Without any toxic label nothing can be
learned, and every score is the prior, 0.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, crc_of_id, documents, map_texts, only, remembers, small_batches, words

MAX_TOXIC, MAX_UNLABELLED = 2_500, 3_500
#: documents that a feature must come from
LEAST = 3
FOLDS = 5
STARTS = (4, 5, 6)
#: words a worker remembers
KEPT = 150_000
TOP = 3
#: gradients below this share of the largest are not brought up to its step length
DAMPED = 0.3


# --- features -------------------------------------------------------------------
_memory: dict[bytes, tuple[int, ...]] = {}
remembers("toxicity", _memory.clear)


def _features(word: bytes) -> tuple[int, ...]:
    """64-bit hashes of the word and of its starts, wide enough that no clean word meets a toxic one."""
    found = _memory.get(word)
    if found is None:
        import xxhash

        bare = word.strip(b".,;:!?\"'()[]*#%&-") or word
        keys = [bare, *(b"%d:" % n + bare[:n] for n in STARTS if len(bare) >= n)]
        found = tuple(map(xxhash.xxh3_64_intdigest, keys))
        if len(_memory) >= KEPT:
            _memory.clear()
        if len(word) <= 64:
            _memory[word] = found
    return found


def _table(texts: list[str | None]):
    """(features of all documents' distinct words, words' first feature, documents' first word)."""
    features = array("Q")
    words_at, docs_at = array("q"), []
    for text in texts:
        docs_at.append(len(words_at))
        for w in dict.fromkeys(words(text)):
            words_at.append(len(features))
            features.extend(_features(w))
    return np.frombuffer(features, np.uint64), np.frombuffer(words_at, np.int64), np.array(docs_at, np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at ``at``, which are not empty."""
    return np.add.reduceat(values, at) if len(at) else np.empty(0)


def _places(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Index of every feature among the ascending keys, their number where it is not one."""
    if not len(keys):
        return np.zeros(len(features), np.int64)
    at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    at[keys[at] != features] = len(keys)
    return at


def pooled(keys: np.ndarray, weights: np.ndarray, table) -> np.ndarray:
    """Documents' rows for the second stage."""
    features, words_at, docs_at = table
    score = _sums(np.append(weights, 0.0)[_places(keys, features)], words_at)
    ends = np.append(docs_at[1:], len(words_at))
    out = np.zeros((len(docs_at), 2))
    for i, (a, b) in enumerate(zip(docs_at, ends)):
        if b > a:
            own = score[a:b]
            top = np.partition(own, b - a - TOP)[-TOP:] if b - a > TOP else own
            top = np.maximum(top, 0)
            out[i] = top.max(), top.sum() / TOP
    return out


# --- learning -------------------------------------------------------------------
def _sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def risk_gradient(z: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Derivative by the logits of the non-negative risk; toxic marks P, the others are U."""
    p, u = toxic, ~toxic
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    s = _sigmoid(z)
    negative = np.logaddexp(0, z)  # loss(-z)
    rest = negative[u].sum() / n_u - prior * negative[p].sum() / n_p
    grad = np.zeros_like(z)
    if rest >= 0:
        grad[p] = prior * (s[p] - 1) / n_p - prior * s[p] / n_p
        grad[u] = s[u] / n_u
    else:  # undo the over-fitted part
        grad[p] = prior * s[p] / n_p
        grad[u] = -s[u] / n_u
    return grad


def _adam(size: int, steps: int, rate: float, gradient, decay: float = 0.0) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    floor = DAMPED * np.abs(gradient(w)).max() + 1e-12  # rare features move little
    for t in range(1, steps + 1):
        g = gradient(w) + decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + floor)
    return w


def train(texts: list[str | None], toxic: np.ndarray, prior: float) -> tuple:
    """(feature hashes ascending, their weights, weights of the pooled row and the constant)."""
    table = _table(texts)
    features, words_at, docs_at = table
    counts = np.diff(np.append(docs_at, len(words_at)))
    per_word = np.diff(np.append(words_at, len(features)))
    doc = np.repeat(np.repeat(np.arange(len(texts), dtype=np.int32), counts), per_word)
    # features of one or two documents teach nothing that carries over
    bounds = np.append(words_at, len(features))[np.append(docs_at, len(words_at))]
    own = [np.unique(features[a:b]) for a, b in zip(bounds, bounds[1:])]
    joined = np.concatenate(own)
    del own
    joined.sort()
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))
    keys = joined[first[np.diff(np.append(first, len(joined))) >= LEAST]]
    del joined, first
    at = _places(keys, features)
    keep = at < len(keys)
    cols, rows = at[keep].astype(np.int32), doc[keep]
    del at, keep, doc
    values = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)[rows]
    size = len(keys)

    def words_gradient(w):
        z = np.bincount(rows, w[cols] * values, minlength=len(texts)) + w[size]
        g = risk_gradient(z, toxic, prior)
        return np.append(np.bincount(cols, g[rows] * values, minlength=size), g.sum())

    w = _adam(size + 1, 60, 0.1, words_gradient, 1e-6)[:size]
    x = pooled(keys, w, table)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    top = _adam(3, 400, 0.1, lambda v: x.T @ risk_gradient(x @ v, toxic, prior))
    slope = top[:2] / spread
    return keys, w, np.append(slope, top[2] - slope @ centre)


def logits(model: tuple, texts: list[str | None]) -> np.ndarray:
    keys, weights, top = model
    return pooled(keys, weights, _table(texts)) @ top[:2] + top[2]


# --- on Spark -------------------------------------------------------------------
def classifier(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text",
               prior: float | None = None, max_toxic: int = MAX_TOXIC,
               max_unlabelled: int = MAX_UNLABELLED) -> tuple | None:
    """Train, in one task, on a sample of the rows given; held-out ones are the caller's to leave out.

    prior   share of toxic documents at large; None takes the share among the labels
    """
    small_batches(docs.sparkSession)
    marked = labels.where("toxic is not null and doc_id is not null") \
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    if prior is None:
        prior = float(marked.agg(F.avg("_toxic")).first()[0] or 0.0)
    if not prior:
        return None
    order = F.xxhash64(F.lit(7), "_id"), "_id"
    confirmed = marked.where("_toxic = 1").select("_id").orderBy(*order).limit(max_toxic)
    at_large = docs.select(F.col(id_column).alias("_id")).where("_id is not null").distinct() \
        .orderBy(*order).limit(max_unlabelled)
    # at most as many ids as the two bounds
    wanted = confirmed.withColumn("_p", F.lit(True)).union(at_large.withColumn("_p", F.lit(False)))
    sample = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")) \
        .join(F.broadcast(wanted), "_id").dropDuplicates(["_id", "_p"])
    schema = arrow_schema("keys binary, weights binary, top binary")

    def fit(table):
        only("toxicity")
        table = table.sort_by([("_id", "ascending"), ("_p", "ascending")])
        toxic = np.array(table.column("_p").to_pylist(), bool)
        model = train(table.column("_text").to_pylist(), toxic, prior)
        return pa.Table.from_batches([arrow_batch(schema, [[a.tobytes()] for a in model])], schema=schema)

    row = sample.groupBy(F.lit(0).alias("_all")).applyInArrow(fit, "keys binary, weights binary, top binary").first()
    return row and (np.frombuffer(row[0], np.uint64), np.frombuffer(row[1]), np.frombuffer(row[2]))


def score(docs: DataFrame, model: tuple | None, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def fn(ids, texts):
        if sent.value is None:
            return [ids, [0.0] * len(ids), [0] * len(ids)]
        p = _sigmoid(logits(sent.value, texts))
        return [ids, p.tolist(), (p >= 0.5).astype(int).tolist()]

    kind = dict(rows.dtypes)["doc_id"]
    return map_texts(rows, fn, f"doc_id {kind}, score double, predicted int", ("toxicity",)) \
        .withColumnRenamed("doc_id", id_column)


def keep_clean(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not call toxic."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        only("toxicity")
        for batch in batches:
            if sent.value is not None and batch.num_rows:
                batch = batch.filter(pa.array(logits(sent.value, batch.column(at).to_pylist()) < 0))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.pmod(crc_of_id(column), F.lit(FOLDS)) == 0


def fitted(docs: DataFrame, labels: DataFrame):
    return classifier(docs.where(~held_out()), labels.where(~held_out()))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: scores of all documents, learned outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fitted(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
