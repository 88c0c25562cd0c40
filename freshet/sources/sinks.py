"""Sinks for result tables and for the large daily input."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest"


def write_csv(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    """CSV folder with a header.  ``one_file`` is for report matrices only, whose
    rows are bounded by the sites."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("simulation", "Year")) -> None:
    """Parquet partitioned for pruning.

    The rebalance hint lets Spark split a partition value that holds much of the
    data over several tasks and files, and merge small ones.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def publish(df: DataFrame, path: str, version: str) -> bool:
    """Write ``df`` as ``version`` of a table and make it visible in one step; False if it is there already.

    The data goes to a folder of its own.  Only when all of it is written, an entry that names the
    folder appears under its final name, by one rename.  A job that fails before leaves nothing a reader
    looks at, and doing it again is safe: a version counts once, whoever repeats it.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    if any(e["version"] == version for e in _entries(spark, root)):
        return False
    data = f"data-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{root}/{data}")
    fs, at = _files(spark, root)
    waiting = at(f"{root}/{MANIFEST}/.{data}")
    out = fs.create(waiting, False)
    out.write(bytearray(json.dumps({"version": version, "data": data, "schema": df.schema.jsonValue()}).encode()))
    out.close()
    while True:
        entries = _entries(spark, root)
        if any(e["version"] == version for e in entries):  # another job was faster
            fs.delete(waiting, False)
            return False
        name = at(f"{root}/{MANIFEST}/{len(entries) + 1:08d}")
        if not fs.exists(name) and fs.rename(waiting, name):
            return True


def last_entry(spark: SparkSession, path: str) -> dict | None:
    entries = _entries(spark, path.rstrip("/"))
    return entries[-1] if entries else None


def _files(spark: SparkSession, root: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _entries(spark: SparkSession, root: str) -> list[dict]:
    """Manifest entries in order: a small file for each version ever published."""
    fs, at = _files(spark, root)
    folder = at(f"{root}/{MANIFEST}")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))
    read = spark._jvm.org.apache.hadoop.io.IOUtils
    out = []
    for name in names:
        stream = fs.open(at(f"{root}/{MANIFEST}/{name}"))
        try:
            out.append(json.loads(bytes(read.readFullyToByteArray(stream)).decode()))
        finally:
            stream.close()
    return out
