"""SparkSession construction and the few session-level settings the engine relies on.

Two profiles:

* ``local`` -- tests and the single-node bench (``local[N]``, shuffle partitions = N).
* ``cluster`` -- defaults meant for a large cluster: many shuffle partitions that AQE
  coalesces at run time, 256 MB scan splits, skew-join splitting on.  Values already set
  by the cluster (spark-defaults, ``--conf``) always win: :func:`get_spark` only fills in
  settings that are unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import PySparkAttributeError
from pyspark.sql import DataFrame, SparkSession

# Settings every profile wants.  AQE re-plans joins and coalesces partitions at run time;
# skew-join splits a hot join key (one order id holding a third of all line items) into
# several tasks; the runtime bloom filter lets the filtered orders side prune line items
# before the big shuffle.
COMMON_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

LOCAL_CONF = {
    "spark.driver.memory": "8g",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
}

CLUSTER_CONF = {
    # 100 TB of input: start wide, AQE coalesces small partitions away.
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # Static broadcast only for sides the planner can prove small; AQE may still
    # switch a sort-merge join to broadcast once the real shuffle size is known.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


STATIC_KEYS = ("spark.ui.enabled", "spark.ui.showConsoleProgress", "spark.driver.memory")


def get_spark(
    app_name: str = "orderlens",
    master: str | None = None,
    profile: str = "local",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return a SparkSession configured for the given profile.

    ``local``: ``local[$BENCH_CPUS or 8]`` unless ``master`` is given, every setting applied.
    ``cluster``: the master comes from the launcher; a setting is applied only when the
    cluster configuration (spark-defaults, ``--conf``) does not set it already.
    ``extra_conf`` is always applied.
    """
    if profile == "local":
        cpus = int(os.environ.get("BENCH_CPUS", "8"))
        master = master or f"local[{cpus}]"
        conf = {**COMMON_CONF, **LOCAL_CONF, "spark.sql.shuffle.partitions": str(cpus)}
    elif profile == "cluster":
        conf = {**COMMON_CONF, **CLUSTER_CONF}
    else:
        raise ValueError(f"unknown profile {profile!r}")
    extra = dict(extra_conf or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in extra.items():
        if not key.startswith("spark.sql."):
            builder = builder.config(key, value)
    if profile == "local":
        for key in STATIC_KEYS:
            if key in conf:
                builder = builder.config(key, conf[key])
    spark = builder.getOrCreate()
    explicit = spark.sparkContext.getConf()
    for key, value in conf.items():
        if key in STATIC_KEYS:
            continue
        if profile == "local" or not explicit.contains(key):
            spark.conf.set(key, value)
    for key, value in extra.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def session_key(spark: SparkSession) -> str:
    """A key for per-session caches: the application id (classic or Spark Connect)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect sessions expose no SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.  Only
    when nothing is configured (tests, local runs) a scratch folder is created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the configured folder is available
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="orderlens-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder that nothing uses yet."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Spark's own removal of a query's shuffle files when the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffle_files_removed(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpoint_table(df, name: str):
    """Cut lineage by writing ``df`` as parquet under the session's checkpoint folder and
    reading it back.

    The folder is ``spark.checkpoint.dir`` -- a shared location on a cluster -- so the stored
    result survives lost executors, is computed exactly once, and its rows (including any
    ``spark_partition_id`` taken before the write) never change afterwards.  The shuffle files
    of the write go at its end, as nothing reads them again.
    """
    return _stored(df, name)[1]


def _stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _shuffle_files_removed(spark):
        df.write.parquet(path)
    return path, spark.read.parquet(path)


class StepTables:
    """Stored tables that only the steps of one operator read, deleted when these are done.

    ``with StepTables() as steps: ... steps.store(df, name)``: what the caller needs afterwards
    goes to :func:`checkpoint_table` before the block ends.
    """

    def __init__(self):
        self._stored: list[tuple[SparkSession, str, DataFrame]] = []

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.drop(*[table for _, _, table in self._stored])

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path, table = _stored(df, name)
        self._stored.append((df.sparkSession, path, table))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete stored tables before the block ends."""
        for spark, path, table in [x for x in self._stored if any(x[2] is t for t in tables)]:
            try:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            except (AttributeError, PySparkAttributeError):
                pass  # Spark Connect: left to the clean-up of the checkpoint folder
        self._stored = [x for x in self._stored if not any(x[2] is t for t in tables)]
