"""MinHash fingerprints of documents, near neighbours by bands, exact Jaccard verification.

A text's shingles are its distinct runs of five words.  Permutation i of 128 maps a shingle's 64-bit hash x to the
high 32 bits of a[i] * x + b[i], a random function from a universal family; the least value over
the shingles is entry i of the signature.  The share of equal entries of two signatures
estimates the Jaccard similarity of the two texts, with a standard error of at most 0.045.
The fingerprint writes the low 16 bits of every entry as four hexadecimal digits.

``near_duplicates`` cuts signatures into ``BANDS`` bands of four entries.  Texts of equal signature and
set form a class; classes that share a band's values meet, and the cells of classes that meet are
compared exactly by the tries of ``jaccard``, hot cells in blocks.  A pair at similarity
0.8 meets with probability 1 - (1 - 0.8^4)^32 > 0.9999999.

``with_edited`` also fingerprints every document's edited text, which needs the next document in
descending id order: rows go to range parts of ids, and the highest rows of every part go to
the part before as well (the very highest to the last).  One shuffle of the texts, no global sort.

Defined results: NULL and empty texts have no shingle; their signature is of all ones, so they are alike to
each other and to nothing else.  Fewer than five words make one shingle.  Rows that repeat an id
follow each other in the order of their texts.  A row with a NULL id has no place in
the order: its edited columns are NULL.  A single document is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, documents, map_texts, only, shingles, small_batches, words

ENTRIES, WIDTH, BANDS = 128, 5, 32
#: shingles hashed at a time
CHUNK = 2048
#: bytes of text of a range part, roughly
PART_BYTES = 8 << 20

_random = np.random.default_rng(20240501)
_A = _random.integers(0, 1 << 63, (ENTRIES, 1), np.uint64) << np.uint64(1) | np.uint64(1)
_B = _random.integers(0, 1 << 63, (ENTRIES, 1), np.uint64)


def signature(text: str | None) -> np.ndarray:
    own = shingles(words(text), WIDTH)
    least = np.full(ENTRIES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(own), CHUNK):
        np.minimum(least, (_A * own[i:i + CHUNK] + _B).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def written(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal fingerprint entries."""
    return float(np.mean(a.astype(np.uint16) == b.astype(np.uint16)))


def edited(text: str, following: str) -> str:
    """The text with its last third given up for as much of the beginning of the following one."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, signature) of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def fn(ids, texts):
        sigs = [signature(t) for t in texts]
        return [ids, [len(t or "") for t in texts], list(map(written, sigs)), [s.tobytes() for s in sigs]]

    kind = dict(rows.dtypes)["doc_id"]
    return map_texts(rows, fn, f"doc_id {kind}, n_chars long, fingerprint string, signature binary") \
        .withColumnRenamed("doc_id", id_column)


def near_duplicates(docs: DataFrame, threshold: str | float = "0.8", id_column: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id), as ``jaccard.cluster`` gives them."""
    from .jaccard import cluster

    rows = ENTRIES // BANDS

    def bands(own: np.ndarray, body: str | None) -> np.ndarray:
        sig = signature(body).reshape(BANDS, rows)
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), seed=i) for i, b in enumerate(sig)], np.uint64)

    return cluster(docs, width=WIDTH, threshold=threshold, id_column=id_column, text=text, keys=bands,
                   keys_per_set=BANDS)


def with_edited(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, top = rows.where("doc_id is not null").agg(F.sum(F.octet_length("text")), F.max("doc_id")).first()
    cuts: list[int] = []
    if top is not None:
        parts = max(1, -(-size // PART_BYTES))
        shares = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx("doc_id", shares, 10 * parts + 1000)).first()[0] if shares else []
        cuts = sorted({top, *found})  # the highest id of every part
    last = len(cuts)
    highest = np.array(cuts, np.int64)
    ddl = "part int, extra int, doc_id long, text string"
    routed = arrow_schema(ddl)

    def route(batches):
        """Part 1 has the lowest ids; extras are the heads of the next lower part, or of all."""
        for batch in batches:
            ids = batch.column(0)
            keys = np.array(ids.fill_null(0), np.int64)
            null = np.array(ids.is_null(), bool)
            part = np.where(null, 0, np.searchsorted(highest, keys, "left") + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.zeros(len(keys)), pa.int32()), *batch.columns], schema=routed)
            head = np.flatnonzero(~null & (highest[np.minimum(part, last) - 1] == keys)) if last else []
            if len(head):
                to = np.where(part[head] == last, 1, part[head] + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(np.ones(len(head)), pa.int32()),
                     *(c.take(pa.array(head)) for c in batch.columns)], schema=routed)

    out_ddl = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
    schema = arrow_schema(out_ddl)

    def compare(batches):
        only("words")
        waiting = None  # (part, id, text, signature) of a row whose next has not come yet
        done: list[tuple] = []
        for batch in batches:
            for part, extra, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                sig = signature(body)
                if part == 0:
                    done.append((key, len(body), None, written(sig), None, None, None))
                    continue
                if waiting and waiting[0] == part:
                    _, own_key, own, own_sig = waiting
                    changed = edited(own, body)
                    changed_sig = signature(changed)
                    done.append((own_key, len(own), hashlib.sha256(changed.encode()).hexdigest(), written(own_sig),
                                 written(changed_sig), likeness(own_sig, changed_sig), likeness(own_sig, sig)))
                # only the first of the extras follows a row, and no row follows it
                waiting = None if extra else (part, key, body, sig)
            if done:
                yield arrow_batch(schema, list(map(list, zip(*done))))
                done = []

    order = "part", "extra", F.desc("doc_id"), "text"
    return rows.mapInArrow(route, ddl).repartition(4 * (last + 1), "part").sortWithinPartitions(*order) \
        .mapInArrow(compare, out_ddl).withColumnRenamed("doc_id", id_column)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprints of all documents and of their edited texts."""
    return with_edited(documents(spark, sf_dir))
