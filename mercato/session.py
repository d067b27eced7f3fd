"""Session helpers: a tuned builder for local runs and the checkpoint folder.

Library code never creates a session on its own; callers pass one in. The
builder here is what tests and ``bench.py`` use. On a cluster the platform's
session is used as it is, except that :func:`checkpoint_dir` reads the shared
``spark.checkpoint.dir`` from it.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for these reports at any scale. AQE re-plans joins into
# broadcasts once the real (post-filter, post-aggregate) size is known, merges
# tiny shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a sort-merge join whose build side is measured under 64 MB per partition runs
    # as a shuffled hash join: no sort of either side, memory bounded per task
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    # checkpointed intermediates are deleted once their DataFrames are collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "mercato",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MERCATO_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster session that names no shared checkpoint folder."""


def cut_lineage(df: DataFrame, checkpoint: bool = True) -> DataFrame:
    """``df`` read back from a checkpoint in the shared folder; ``df`` itself, to be
    computed from its lineage, when not wanted or when a cluster names no folder."""
    if not checkpoint:
        return df
    try:
        checkpoint_dir(df.sparkSession)
    except NoSharedFolder:
        return df
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when none is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only a local-mode session with nothing configured (tests,
    laptops) gets a fresh folder under the system temp dir, because on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context; the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise NoSharedFolder(
            "spark.checkpoint.dir is not set; name a shared folder (HDFS/S3/...) "
            "so checkpointed intermediates survive executor loss"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="mercato-ckpt-"))
    return sc.getCheckpointDir()


#: What the reports hold in one task at most, as Spark settings: the share of a scan, and
#: of a shuffle once AQE has merged its partitions (both compressed; in sorts and hash
#: tables they take some twenty times that).
TASK_CONF = {
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}
#: Bytes of input files for each partition that a shuffle starts with.
PARTITION_BYTES = 4 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def bound_tasks(spark: SparkSession, input_bytes: int) -> None:
    """Keep what a task holds at one size whatever the input: larger inputs get more
    partitions. A setting that the caller has made stays as it is; the number of
    partitions that shuffles start with is only ever raised, AQE merges small ones."""
    for key, value in TASK_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    now = spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")
    wanted = -(-input_bytes // PARTITION_BYTES)
    if wanted > int(now):
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))


#: Bytes of rows that go to a Python worker at once, if the caller has set nothing: by
#: rows alone (10,000) a batch of texts takes 25 MB, several times over in each worker
#: and in the JVM beside it.
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the workers of ``spark``, once for each application, as
    ``--py-files`` would: a driver may have imported it from a folder that they do
    not know. Spark copies the file to them; nothing reads it from the driver's disk."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's workers have what it gives them
        return
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
