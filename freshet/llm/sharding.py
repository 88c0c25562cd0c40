"""Shards of nearly equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A group (documents of equal text) must not be divided.  Differencing keeps partial partitions, each
a vector of one load per shard, and again and again takes the two with the largest spread (largest
less smallest load) and joins them oppositely ordered: the heaviest part of one with the
lightest of the other.  What is left in the end is one vector of nearly equal loads.

On Spark this is done as a tree.  Groups are hashed to buckets of about ``BUCKET_GROUPS``; each bucket is
differenced by a task of its own and gives one vector and its groups' places in it.  The
vectors of ``FAN_IN`` buckets are then differenced by a task, and so on until one is left; every
step only permutes the shards of what is below, so a bucket's place table goes
through one permutation per level.  No task holds more than a bucket, whatever the input.

``law`` is "bytes": loads are sums of UTF-8 bytes plus one per document.  Slots number a
shard's documents without gaps, in the order of hash buckets of the id and then of the id: buckets
are counted first, so no task sorts a shard.

Defined results: a NULL text weighs 1 and NULL texts form one group, apart from the
empty texts.  Repeated rows get slots of their own; among rows alike in all but the slot any order is
right.  A NULL id is placed like any other.  No rows: no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, documents, small_batches, stage

BUCKET_GROUPS, FAN_IN = 20_000, 512
#: documents of a slot bucket, roughly
SLOT_ROWS = 50_000


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over vectors of loads (n x shards).

    Returns the loads of the joined partition and an n x shards table: place of every vector's every
    part in it.
    """
    n, k = vectors.shape
    # a node: its loads in ascending order; parts of its children go to its places
    heap = []
    loads: list[np.ndarray] = []
    places: list[tuple] = []  # (left, its order, right, its order) or a leaf's order
    for i, v in enumerate(vectors):
        order = np.argsort(v, kind="stable")
        loads.append(v[order])
        places.append(order)
        heap.append((-(int(v[order[-1]]) - int(v[order[0]])), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = loads[a] + loads[b][::-1]
        order = np.argsort(joined, kind="stable")
        loads[a] = loads[b] = None
        loads.append(joined[order])
        places.append((a, b, order))
        node = loads[-1]
        heapq.heappush(heap, (-(int(node[-1]) - int(node[0])), len(loads) - 1))
    out = np.empty((n, k), np.int64)
    root = heap[0][1]
    todo = [(root, np.arange(k))]  # place of each of the node's ascending positions
    while todo:
        at, where = todo.pop()
        if at < n:
            out[at, places[at]] = where
        else:
            a, b, order = places[at]
            # position p of the joined vector before ordering holds a's p and b's k-1-p
            mine = np.empty(k, np.int64)
            mine[order] = where
            todo.append((a, mine))
            todo.append((b, mine[::-1]))
    return loads[root], out


def balance(groups: DataFrame, shards: int) -> DataFrame:
    """(group, load) -> (group, shard); ``groups`` has one row a group."""
    spark = groups.sparkSession
    small_batches(spark)
    groups = stage(groups.select("group", "load"), "groups")
    buckets = max(1, -(-groups.count() // BUCKET_GROUPS))
    node = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    places_ddl = "group binary, bucket long, place int, loads array<long>"
    schema = arrow_schema(places_ddl)

    def lowest(table):
        import pyarrow as pa

        table = table.sort_by([("load", "descending"), ("group", "ascending")])
        loads = np.zeros((table.num_rows, shards), np.int64)
        loads[:, 0] = table.column("load").to_numpy()
        total, out = difference(loads)
        n = table.num_rows
        return pa.Table.from_batches([arrow_batch(schema, [
            table.column("group").to_pylist(), table.column("bucket").to_pylist(), out[:, 0].tolist(),
            [total.tolist()] + [None] * (n - 1)])], schema=schema)

    placed = stage(node.groupBy("bucket").applyInArrow(lowest, places_ddl), "places")
    # the joined vector is in ascending order, and so are the places
    vectors = placed.where("loads is not null").select("bucket", F.col("bucket").alias("node"), "loads")
    tree_ddl = "node long, child long, places array<int>, loads array<long>"
    tree_schema = arrow_schema(tree_ddl)

    def upper(table):
        import pyarrow as pa

        table = table.sort_by("node")
        children = table.column("node").to_pylist()
        total, out = difference(np.array(table.column("loads").to_pylist(), np.int64))
        n = len(children)
        return pa.Table.from_batches([arrow_batch(tree_schema, [
            [children[0] // FAN_IN] * n, children, out.tolist(), [total.tolist()] + [None] * (n - 1)])],
            schema=tree_schema)

    vectors = vectors.select("node", "loads")
    result = placed.select("group", F.col("bucket").alias("node"), "place")
    level = buckets
    while level > 1:
        tree = stage(vectors.withColumn("parent", F.floor(F.col("node") / FAN_IN))
                     .groupBy("parent").applyInArrow(_without("parent", upper), tree_ddl), "tree")
        result = result.join(tree.select(F.col("child").alias("node"), F.col("node").alias("_up"), "places"), "node") \
            .select("group", F.col("_up").alias("node"), F.get("places", F.col("place")).alias("place"))
        vectors = tree.where("loads is not null").select("node", "loads")
        level = -(-level // FAN_IN)
    return result.select("group", F.col("place").alias("shard"))


def _without(name, fn):
    return lambda table: fn(table.drop_columns([name]))


def assign(docs: DataFrame, shards: int, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``."""
    spark = docs.sparkSession
    body = F.col(text)
    rows = stage(docs.select(
        F.col(id_column).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        # NULL texts are a group of their own
        F.unhex(F.coalesce(F.sha2(body, 256), F.lit(""))).alias("group")), "sizes")
    groups = rows.groupBy("group").agg(F.sum("size").alias("load"))
    placed = rows.join(balance(groups, shards), "group")
    slots = max(1, -(-rows.count() // SLOT_ROWS))
    placed = stage(placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots))),
                   "placed")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_part").count() \
        .select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32")
    return placed.join(starts, ["shard", "_part"]).select(
        F.col("doc_id").alias(id_column), "size", "text_crc32", "shard",
        (F.col("_start") + F.row_number().over(inside) - 1).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents in 16 shards of nearly equal bytes."""
    return assign(documents(spark, sf_dir), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
