"""Bounded-space online packing of token documents into sequences.

Every task streams its documents through a ``Packer`` holding ``OPEN`` windows.  A document that
fills whole sequences gives those first; what is left goes to the open window it fits best (the one
with the least room to spare).  When none has room, the fullest window is filled with
the head of the piece and emitted, and the tail is placed again.  So a document is cut only where it
would otherwise cause padding, and memory is ``OPEN`` windows whatever the input.

What the tasks leave open (``OPEN`` windows each at most) carries its ids to a second
round, in which groups of ``FAN_IN`` tasks are packed in the same way, and so on until one group
is left.  Its last windows are filled up one after the other, and the last of all is cut
into sequences of powers of two, which need no padding.

One task's packing depends on its input rows and their order alone.  The first round is written to
the shared folder before the second reads it, so a lost executor cannot mix two packings.

Defined results: a NULL or empty text is a document of its end id alone.  Repeated rows
are packed as often as they come, a NULL id stays NULL.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batch, arrow_schema, crc32, documents, small_batches, stage
from .pieces import encoder

#: open windows of a task, tasks of a merging group
OPEN, FAN_IN = 16, 32
#: rows of an output batch
OUT_ROWS = 2000

FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Window:
    __slots__ = ("used", "pieces")

    def __init__(self):
        self.used, self.pieces = 0, []


class Packer:
    """Open windows of ``size`` ids.  ``base`` starts the sequence ids."""

    def __init__(self, size: int, base: int, windows: int = OPEN):
        self.size, self.next_id = size, base
        self.open = [Window() for _ in range(windows)]
        #: finished pieces: (doc, start, ids, doc_tokens, sequence, offset)
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray, start: int, total: int) -> None:
        while len(ids) >= self.size:
            self.emit([(doc, start, ids[:self.size], total)])
            ids, start = ids[self.size:], start + self.size
        while len(ids):
            fits = [w for w in self.open if w.used + len(ids) <= self.size]
            window = max(fits or self.open, key=lambda w: w.used)
            room = self.size - window.used
            head, ids = ids[:room], ids[room:]
            window.pieces.append((doc, start, head, total))
            window.used += len(head)
            start += len(head)
            if window.used == self.size:
                self.emit(window.pieces)
                window.used, window.pieces = 0, []

    def left(self) -> Iterator[tuple]:
        """Pieces of the open windows, as finished ones but not final."""
        self.done = []
        for window in self.open:
            if window.pieces:
                self.emit(window.pieces)
        return self.done

    def finish(self) -> None:
        """Fill the open windows up, fullest first; cut the last into powers of two."""
        rest = [p for w in sorted(self.open, key=lambda w: -w.used) for p in w.pieces]
        total = sum(len(p[2]) for p in rest)
        at = 0
        while rest:
            want = self.size if total - at >= self.size else 1 << (total - at).bit_length() - 1
            want, room, taken = min(want, self.size), min(want, self.size), []
            while room:
                doc, start, ids, n = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], n))
                    ids = ids[:room]
                taken.append((doc, start, ids, n))
                room -= len(ids)
            self.emit(taken)
            at += want


def _base(level: int, task: int) -> int:
    """First sequence id of a task of a round; rounds and tasks have 2^32 ids each."""
    return (level << 24 | task) << 32


def _columns(done: list[tuple], task: int, keep_ids: bool) -> list[list]:
    docs, starts, ids, totals, sequences, offsets = map(list, zip(*done))
    return [docs, starts, [len(i) for i in ids], [crc32(i) for i in ids], totals, sequences, offsets,
            [task] * len(docs), [i.astype("<u4").tobytes() if keep_ids else None for i in ids]]


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, size: int = 2048,
         id_column: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, {FIELDS}, task long, ids binary, open boolean"
    schema = arrow_schema(ddl)

    def out(done, task, is_open):
        for i in range(0, len(done), OUT_ROWS):
            part = done[i:i + OUT_ROWS]
            yield arrow_batch(schema, [*_columns(part, task, keep_ids or is_open), [is_open] * len(part)])

    def first(batches):
        task = TaskContext.get().partitionId()
        packer, tokens = Packer(size, _base(0, task)), encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, found in zip(ids, tokens.encode(texts)):
                full = np.append(found.astype(np.uint32), np.uint32(end_id))
                packer.add(doc, full, 0, len(full))
            yield from out(packer.done, task, False)
            packer.done = []
        yield from out(packer.left(), task, True)

    def merge(level: int, last: bool):
        def run(table):
            import pyarrow as pa

            table = table.sort_by([("task", "ascending"), ("sequence_id", "ascending"),
                                   ("offset", "ascending")])
            task = (table.column("task")[0].as_py()) // FAN_IN
            packer = Packer(size, _base(level, task))
            for r in table.to_pylist():
                packer.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["start"], r["doc_tokens"])
            if last:
                packer.finish()
            final = list(out(packer.done, task, False))
            return pa.Table.from_batches(
                final + ([] if last else list(out(packer.left(), task, True))), schema=schema)
        return run

    done, level = [], 0
    packed = stage(rows.mapInArrow(first, ddl), "packed")
    tasks = packed.where("open").agg(F.max("task")).first()[0]
    while tasks is not None:
        level += 1
        done.append(packed.where(~F.col("open")))
        again = packed.where("open").withColumn("_group", F.floor(F.col("task") / FAN_IN))
        last = tasks < FAN_IN
        packed = stage(again.groupBy("_group").applyInArrow(
            _without_group(merge(level, last)), ddl), "packed")
        tasks = None if last else tasks // FAN_IN
    for part in done:
        packed = packed.unionByName(part)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return packed.select(*names, *["ids"] * keep_ids).withColumnRenamed("doc_id", id_column)


def _without_group(run):
    return lambda table: run(table.drop_columns(["_group"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents in sequences of 2048."""
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)
