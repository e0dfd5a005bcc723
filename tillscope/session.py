"""Spark session and shared work-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillscope",
              driver_memory: str = "16g", event_log_dir: str | None = None) -> SparkSession:
    """Local session for tests and the bench (the cluster supplies its own)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", driver_memory)
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if event_log_dir:
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset and the master is local (tests, the bench) a fresh
    folder is made.  On a cluster an unset folder is an error: a machine-local one would lose data.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tillscope-ckpt-", dir=os.environ.get("TILLSCOPE_SCRATCH", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers (once per application), wherever they run.

    Functions that run in Python workers import their helpers from the package there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tillscope-ship-"), "tillscope.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tillscope", os.path.relpath(full, here)))
    sc.addPyFile(path)   # the driver serves it to every executor
    _SHIPPED.add(sc.applicationId)


#: Rows of a counted table that are sent to all tasks at most; larger tables are joined by a shuffle.
SENT_ROWS = 500_000


def sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for a broadcast join if it has at most ``most`` rows, so that the other side stays where it is; any larger
    table is left to a shuffle.  It is counted, so it should be a stored one."""
    most = SENT_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Settings for reading and writing line tables: a task reads few of their files, which take some ten times as many bytes in
#: memory, and writes its few months side by side instead of sorting its lines first.
LINE_TABLES = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.maxConcurrentOutputFileWriters": "16"}


@contextmanager
def held(spark: SparkSession, conf: dict):
    """The session with ``conf`` set, as it was before afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/work-{name}-{uuid.uuid4().hex[:12]}"
