"""Session construction, lineage cuts and size checks."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import BROADCAST_BYTES


def build_session(app: str = "marginalia", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win.

    Only semantics (UTC, ANSI off for ``try``-style parsing is *not* assumed) and
    adaptive execution are set here.  Shuffle width stays with the cluster unless
    the caller passes ``spark.sql.shuffle.partitions``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(here)))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names.

    Survives the loss of executors, unlike a cached or locally checkpointed frame.
    A folder is made up only for a local master with none configured.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="marginalia-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back the disk of shuffles and checkpoints that nothing refers to any more.

    Spark drops them when the driver collects its garbage, which a driver with memory to spare seldom does, so a job of
    many steps would hold what all of them wrote.  (Checkpoints go only with ``spark.cleaner.referenceTracking.cleanCheckpoints``.)
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting that the rows fit; otherwise leave the join alone.

    The count stops at the limit, so the check itself never scans more than needed.
    """
    allowed = max(1, limit // max(1, row_bytes))
    seen = df.limit(allowed + 1).count()
    return F.broadcast(df) if seen <= allowed else df


def spread(scan: DataFrame, waves: int = 0) -> DataFrame:
    """Use all cores on a scan that has fewer splits than cores; larger inputs pass unchanged.

    One small file would otherwise run every following row-wise step in a single task.  ``waves`` is for costly rows: so
    many tasks a core, where the file's own splits are fewer.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    if waves and splits < waves * cores:
        return scan.repartition(waves * cores)
    return scan.repartition(cores) if splits * 2 <= cores else scan
