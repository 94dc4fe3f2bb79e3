"""Session helpers: one place for the settings every job in the library relies on."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings the library relies on. Session time zone UTC keeps `date_trunc` and timestamp
# literals identical to the naive timestamps stored in the tables; AQE lets Spark turn a
# sort-merge join into a broadcast join only once the measured shuffle size of a side is
# below `spark.sql.adaptive.autoBroadcastJoinThreshold`, and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Sizing for a large cluster (hundreds of TB of exposures). Shuffles start wide and AQE
# coalesces them to ~256 MB partitions, so neither a month-long scan nor a one-day report
# gets a wrong partition count; input splits are 256 MB; a side up to 64 MB may be
# broadcast (AQE checks the measured size); skewed join partitions above 1 GB are split;
# streaming aggregation state lives in RocksDB (spills to local disk, checkpointed to the
# shared checkpoint dir) instead of the JVM heap.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # checkpoint() files (T5 copies its input once) are removed when the data goes out of scope
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# A stateful streaming query keeps the shuffle partition count it first started with (it is
# stored in the checkpoint), AQE does not coalesce its shuffles, and every partition is a state
# store that each micro-batch visits. The monitors therefore start with their own count, sized
# for their state, instead of the batch setting above (20000 tiny tasks every trigger).
STATE_PARTITIONS_KEY = "spark.newsprism.streaming.statePartitions"
CLUSTER_CONF[STATE_PARTITIONS_KEY] = "2000"


def get_session(
    app_name: str = "newsprism",
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
    profile: str = "local",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` and ``shuffle_partitions`` are only meant for local runs and tests;
    ``profile="cluster"`` adds :data:`CLUSTER_CONF`. Settings given to ``spark-submit`` win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder on the shared storage named by ``spark.checkpoint.dir``.

    Lineage cuts, streaming checkpoints and keyed result tables all live below it, so they
    survive the loss of any executor. The URI is kept as it is, scheme included. Without the
    setting, a session whose master is local (tests) gets a fresh scratch folder as its
    checkpoint dir; on a cluster that would be a different folder on every machine, so there
    the missing setting is an error.
    """
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(
                "spark.checkpoint.dir is not set: a cluster needs a folder that the driver and all "
                "executors share"
            )
        base = tempfile.mkdtemp(prefix="newsprism-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return "/".join([base.rstrip("/"), *parts])


def fresh_dir(spark: SparkSession, prefix: str) -> str:
    """A new, unused sub-folder of :func:`shared_dir` (one per run, never reused)."""
    return shared_dir(spark, f"{prefix}-{uuid.uuid4().hex[:12]}")


SCRATCH_HOURS = 6.0


def scratch_dir(spark: SparkSession, prefix: str, *, keep_hours: float = SCRATCH_HOURS) -> str:
    """A new folder for a result that is read again soon (a dashboard section, a timed report).

    The folders of earlier calls with this ``prefix`` that are older than ``keep_hours`` are removed
    first, so a service that writes one for every request holds the last hours' only.
    """
    top = shared_dir(spark, "scratch", prefix)
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    now = time.time()
    if fs.exists(path):
        for status in fs.listStatus(path):
            if status.getModificationTime() / 1000 < now - keep_hours * 3600:
                fs.delete(status.getPath(), True)
    return f"{top}/{uuid.uuid4().hex[:12]}"
