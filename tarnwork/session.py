"""Session settings and the shared working folder.

The library never opens its own cluster session: callers pass a
``SparkSession`` in.  ``configure`` sets the few runtime SQL settings on which
results depend (time zone) or on which the plans rely for skew (AQE).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUNTIME_SETTINGS = {
    # Event times are written and read as UTC; see functions/times.py.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Plans below join hot keys against one-row-per-key sides and leave the
    # splitting of the hot side to AQE, also when it costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_LARGE_STATE = {
    # Stream state on disk with incremental snapshots instead of on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession, large_state: bool = False) -> SparkSession:
    """Apply the runtime settings to an existing session and return it.

    ``large_state`` is for stream jobs whose windows or keys do not fit into
    the executors' heap.
    """
    for key, value in {**_RUNTIME_SETTINGS, **(_LARGE_STATE if large_state else {})}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def large_state(spark: SparkSession) -> Iterator[SparkSession]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = {key: spark.conf.get(key, None) for key in _LARGE_STATE}
    try:
        yield configure(spark, large_state=True)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside leave no shuffle files behind, so that the disk holds those of one action at a time.

    For frames whose action is a write or a checkpoint: a frame that is run
    again would have its shuffles made again.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tarnwork") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local-mode session without
    that setting falls back to a temporary folder: on a cluster such a folder
    would be lost with its machine, so there the setting is required.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; every call gives another one."""
    return f"{work_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder below a ``scratch_path`` whose rows have gone into another one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
