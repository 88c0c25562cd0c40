"""Helpers shared by the operators: Arrow passes over texts, hashing, tokens, staging."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.running import stage
from ..session import tune

#: rows of an Arrow batch; texts can be long, so far fewer than Spark's default
BATCH_ROWS = 1000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: distinct words a worker remembers before it starts anew
WORDS_KEPT = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that left Spark's row count in place."""
    tune(spark)
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def arrow_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


def map_texts(df: DataFrame, fn: Callable[..., list], schema: str, memory: tuple[str, ...] = ("words",)) -> DataFrame:
    """Run ``fn(*columns as Python lists) -> output columns`` over every Arrow batch of ``df``.

    memory   names of what ``fn`` remembers between batches and tasks
    """
    small_batches(df.sparkSession)
    out = arrow_schema(schema)

    def run(batches):
        only(*memory)
        for batch in batches:
            if batch.num_rows:
                yield arrow_batch(out, fn(*(c.to_pylist() for c in batch.columns)))

    return df.mapInArrow(run, schema)


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, as UTF-8.

    On bytes, ``lower`` changes A-Z alone and ``split`` cuts at exactly those characters.
    """
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit; it is invertible."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


class _Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_words = _Words()


#: what a worker remembers, by name: functions that forget it
_forget: dict[str, Callable[[], None]] = {"words": _words.clear}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _forget[name] = forget


def only(*names: str) -> None:
    """Forget what other operators left in this worker: workers serve many stages, one after the other."""
    for name, forget in _forget.items():
        if name not in names:
            forget()


def hash_words(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    return np.fromiter(map(_words.__getitem__, tokens), np.uint64, len(tokens))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that high bytes of zero cost nothing once compressed."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def presser() -> Callable[[bytes], bytes]:
    """A compressor for what is shuffled, one for each task."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress


def opener() -> Callable[[bytes], bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, in order; fewer words make one run.

    No words: no run.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = max(1, len(hashes) - width + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(min(width, len(hashes))):
        out = mix(out * np.uint64(0x100000001B3) + hashes[i:i + n])
    if len(hashes) < width:  # a short text is no run of a longer one
        out = mix(out + np.uint64(len(hashes)))
    return out


def shingles(tokens: list[bytes], width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, ascending; no words: no shingle."""
    return np.unique(runs(hash_words(tokens), width))


def crc_of_id(column: str):
    """crc32 of the id as text; a NULL id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary"))
