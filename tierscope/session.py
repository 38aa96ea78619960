"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app_name: str = "tierscope",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the UI off.

    On a cluster ``master`` stays None so spark-submit decides; locally it
    is ``local[N]``.  Shuffle partitions default to 2x the local cores;
    on a cluster set ``spark.sql.shuffle.partitions`` to roughly
    input_bytes / 128 MiB and let AQE coalesce.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local["):
            # Driver and executors are one process here; the default is one gigabyte.
            builder = builder.config("spark.driver.memory", "8g")
    cores = os.cpu_count() or 8
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config(*METHOD_LIMIT)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# HotSpot leaves methods above this size uncompiled, so wide rows would be interpreted.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")
# Wide tables of few distinct values are ten times as large in memory as in files.
SCAN_SIZE = ("spark.sql.files.maxPartitionBytes", "16m")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def small_methods(spark: SparkSession):
    """Jobs of the session in here run no generated method that HotSpot doesn't compile; the rows are the same."""
    return _settings(spark, dict([METHOD_LIMIT]))


def small_scans(spark: SparkSession):
    """Jobs of the session in here read a table in many tasks of bounded size, not in one or two a core."""
    return _settings(spark, dict([SCAN_SIZE]))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session, set at most once.

    A cluster names it in ``spark.checkpoint.dir``.  Setting it again would
    give a new folder, so one that is set already is returned as it is.
    Only where driver and executors are one process (``local``) is a scratch
    folder made; on a cluster a missing setting is an error, because other
    machines could not read a local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tierscope-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
