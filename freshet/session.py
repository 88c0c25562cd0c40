"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Container

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # day-of-year arithmetic must not depend on the host's time zone
    "spark.sql.session.timeZone": "UTC",
    # run-time sizes decide broadcast joins, partition counts and skew splits
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where the aggregate above then needs its own exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Bytes of a task where the session does not say.  Sorted shuffle data are small; in the sorts and hash maps of a join
#: with an aggregate above it they take 20 to 30 times as much, so Spark's 64 MB ask a task for gigabytes, as do its 128 MB
#: of a compressed file whose rows are all different groups.
TASK_BYTES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITIONS_PER_CORE = 4

_fallback_dirs: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def build_session(app: str = "freshet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate(), keep=conf)


def tune(spark: SparkSession, keep: Container[str] = ()) -> SparkSession:
    """Apply the run-time settings, apart from ``keep``, to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if key not in keep and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in TASK_BYTES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if not is_local(spark) and spark.conf.get(INITIAL_PARTITIONS, None) is None:
        # The default of 200 is far too few at scale; AQE merges what is too many.
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set(INITIAL_PARTITIONS, str(max(
            PARTITIONS_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, one sub-folder per application.

    The cluster names it in ``spark.checkpoint.dir``.  A machine-local folder is
    used only where that is unset and the master is local, as in tests.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if app not in _fallback_dirs:
            _fallback_dirs[app] = tempfile.mkdtemp(prefix="freshet-")
        named = _fallback_dirs[app]
    return f"{named.rstrip('/')}/freshet-{app}"


def written_table(spark: SparkSession, name: str) -> DataFrame:
    """A table just saved under a name of its own; :func:`release` drops it."""
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Delete the written tables of this application, once nobody reads its results any more."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
