"""Token ids in shards, with a minimal perfect hash index for keyed access.

``write(docs, path, ...)`` range-partitions the documents by key, encodes them in ascending key
order and writes the store through Spark, so that task commits decide which files count and any file
system Spark can write to will do.  One row of the store is a shard of up to ``SHARD_IDS`` ids
(more only where one document alone has more):

    part, shard      range partition and number within it: ascending order of all keys
    first_key, last_key, n_keys, n_null, n_ids
    payload          raw ids, little-endian unsigned, ``id_bytes`` each, documents back to back
    offsets          where each document starts in the payload, one more than documents, uint64
    keys             the keys in order, int64, to list the store and to tell where the run of a key ends
    levels, ranks    the minimal perfect hash: bit arrays by level, and set bits before each word
    slots            slot -> document number, uint32
    prints           slot -> 32-bit fingerprint of the key, which tells keys that are not in the store

The hash is built level by level: every key of a level is hashed to twice as many bits as keys; keys
that are alone on their bit own it, the others go on to the next level with another seed.  The
rank of a key's bit among all set bits is its slot, so n keys have the slots 0 to n-1.

A look-up hashes the key (an expected 1.6 levels), compares the fingerprint, and slices the payload:
constant time.  Which shard to ask is told by the range directory (``first_key``, ``last_key``).

Defined results: a NULL or empty text has its end id alone.  Rows with the same key are
stored next to each other, ordered by text; the index gives the first of them and the run goes on
while the key stays the same.  Rows with a NULL key come first and are found by listing only.  An
empty table makes an empty store.
"""

from __future__ import annotations

import uuid

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from ._common import arrow_batch, arrow_schema, crc32, documents, map_texts, mix, small_batches
from .pieces import encoder

SHARD_IDS = 2_000_000
#: bytes of text of a range partition, roughly
PART_BYTES = 16 << 20
SCHEMA = ("part long, shard long, first_key long, last_key long, n_keys long, n_null long, n_ids long, "
          "id_bytes int, payload binary, offsets binary, keys binary, levels array<binary>, "
          "ranks array<binary>, slots binary, prints binary")


# --- minimal perfect hash -------------------------------------------------------
def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_seeded(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(levels of 64-bit words, ranks of each word, slot of every key) for distinct keys."""
    levels, ranks, slots = [], [], np.zeros(len(keys), np.uint32)
    left, before = np.arange(len(keys)), 0
    while len(left):
        bits = max(64, 2 * len(left) + 63 & ~63)
        at = (_seeded(keys[left], len(levels)) % np.uint64(bits)).astype(np.int64)
        alone = np.bincount(at, minlength=bits) == 1
        words = np.packbits(alone, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        rank = before + np.concatenate([[0], np.cumsum(counts)[:-1]])
        own = alone[at]
        order = before + np.cumsum(alone) - 1
        slots[left[own]] = order[at[own]]
        levels.append(words)
        ranks.append(rank.astype(np.uint32))
        before += int(counts.sum())
        left = left[~own]
    return levels, ranks, slots


def look_up(keys: np.ndarray, levels: list[np.ndarray], ranks: list[np.ndarray],
            prints: np.ndarray) -> np.ndarray:
    """Slot of every key, -1 where the fingerprint tells that it is not there."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for level, (words, rank) in enumerate(zip(levels, ranks)):
        at = _seeded(keys[left], level) % np.uint64(64 * len(words))
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        hit = (words[word] >> bit & np.uint64(1)).astype(bool)
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        slot = rank[word].astype(np.int64) + np.bitwise_count(below)
        out[left[hit]] = slot[hit]
        left = left[~hit]
        if not len(left):
            break
    found = out >= 0
    out[found] = np.where(prints[out[found]] == fingerprint(keys[found]), out[found], -1)
    return out


# --- writing --------------------------------------------------------------------
def _shard(part: int, number: int, keys: list, ids: list[np.ndarray]) -> list:
    nulls = sum(k is None for k in keys)
    own = np.array(keys[nulls:], np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    distinct = own[first]
    levels, ranks, slots = build(distinct)
    docs, prints = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
    docs[slots], prints[slots] = first + nulls, fingerprint(distinct)
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype("<u8")
    payload = np.concatenate(ids)
    b = lambda a: np.ascontiguousarray(a).tobytes()
    return [part, number, int(own[0]) if len(own) else None, int(own[-1]) if len(own) else None,
            len(keys), nulls, int(offsets[-1]), payload.dtype.itemsize, b(payload), b(offsets), b(own),
            [b(x) for x in levels], [b(x) for x in ranks], b(docs), b(prints)]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, *,
          id_column: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Write the store of ``docs`` to the folder ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = arrow_schema(SCHEMA)
    rows = docs.select(F.col(id_column).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def encode(batches):
        part, number, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        tokens = encoder(tokenizer)
        for batch in batches:
            found = tokens.encode(batch.column(1).to_pylist())
            for key, own in zip(batch.column(0).to_pylist(), found):
                own = np.append(own, tokens.dtype.type(end_id))
                if held and held + len(own) > shard_ids and key != keys[-1]:
                    yield arrow_batch(schema, [[v] for v in _shard(part, number, keys, ids)])
                    number, keys, ids, held = number + 1, [], [], 0
                keys.append(key)
                ids.append(own)
                held += len(own)
        if keys:
            yield arrow_batch(schema, [[v] for v in _shard(part, number, keys, ids)])

    (rows.repartitionByRange(parts, F.col("key").asc_nulls_first())
         .sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
         .mapInArrow(encode, SCHEMA).write.mode("errorifexists").parquet(path))


# --- reading --------------------------------------------------------------------
def _arrays(row: dict):
    return ([np.frombuffer(x, "<u8") for x in row["levels"]], [np.frombuffer(x, "<u4") for x in row["ranks"]],
            np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["slots"], "<u4"),
            np.frombuffer(row["offsets"], "<u8"), np.frombuffer(row["payload"], f"<u{row['id_bytes']}"))


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get(store: DataFrame, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids of the wanted keys, (key, ids array<long>), a row for every document of the key; keys that are not
    there give no row.

    The range directory sends a key to its shard by a join on ranges of shards; every
    shard then answers all its keys from its index.
    """
    wanted = keys.select(F.col(id_column).cast("long").alias("key")).where("key is not null").distinct()
    ranges = store.select("part", "shard", "first_key", "last_key").where("first_key is not null")
    # the directory has one row a shard, millions of ids each
    asked = (wanted.join(F.broadcast(ranges), F.col("key").between(F.col("first_key"), F.col("last_key")))
             .groupBy("part", "shard").agg(F.collect_list("key").alias("wanted")))
    columns = ["levels", "ranks", "prints", "slots", "offsets", "payload", "id_bytes", "keys", "n_null"]
    schema = arrow_schema("key long, ids array<long>")

    def answer(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels, ranks, prints, slots, offsets, payload = _arrays(row)
                asked_keys = np.array(row["wanted"], np.int64)
                slot = look_up(asked_keys, levels, ranks, prints)
                own, nulls = np.frombuffer(row["keys"], "<i8"), row["n_null"]
                found = []
                for key, d in zip(asked_keys[slot >= 0].tolist(), slots[slot[slot >= 0]].tolist()):
                    while d - nulls < len(own) and own[d - nulls] == key:  # the run of the key
                        found.append((key, payload[int(offsets[d]):int(offsets[d + 1])].tolist()))
                        d += 1
                yield arrow_batch(schema, [[k for k, _ in found], [i for _, i in found]])

    return asked.join(store.select("part", "shard", *columns), ["part", "shard"]) \
        .select("wanted", *columns).mapInArrow(answer, "key long, ids array<long>")


def listing(store: DataFrame) -> DataFrame:
    """Every document of the store: (doc_id, start, n_tokens, ids_crc32), read through the index.

    start: ids of all documents before it.  Shards tell where they start by sums over
    the shards of their part and over the parts, both far fewer than documents.
    """
    schema = arrow_schema("doc_id long, part long, shard long, inside long, n_tokens long, ids_crc32 long")

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels, ranks, prints, slots, offsets, payload = _arrays(row)
                keys, nulls = np.frombuffer(row["keys"], "<i8"), row["n_null"]
                slot = look_up(keys, levels, ranks, prints)
                if (slot < 0).any():
                    raise ValueError("a stored key is missing from the index")
                first = slots[slot].astype(np.int64)  # of its run of equal keys
                place = np.arange(len(keys))
                new = np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)]
                again = place - np.maximum.accumulate(np.where(new, place, 0))
                doc = np.concatenate([np.arange(nulls), first + again])
                n = len(doc)
                spans = [(int(offsets[d]), int(offsets[d + 1])) for d in doc]
                yield arrow_batch(schema, [
                    [None] * nulls + keys.tolist(), [row["part"]] * n, [row["shard"]] * n,
                    [a for a, _ in spans], [b - a for a, b in spans],
                    [crc32(payload[a:b]) for a, b in spans]])

    found = store.mapInArrow(rows, "doc_id long, part long, shard long, inside long, n_tokens long, ids_crc32 long")
    sizes = store.select("part", "shard", "n_ids")
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids")) \
        .select("part", F.coalesce(F.sum("ids").over(in_order), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))) \
        .join(parts, "part").select("part", "shard", (F.col("_part") + F.col("_shard")).alias("_start"))
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: write all documents, read the files back."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return listing(open_store(spark, path))
