"""Session helpers: building a session for tests/bench, and durable materialisation.

Library code never creates its own session; it takes the one it is given. The only
session-level state we touch is the checkpoint folder, and only when the cluster has
not named one (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job here assumes. AQE re-plans joins/partition counts on
# measured sizes and splits skewed join partitions; all are defaults in Spark 4 but
# are pinned so a cluster profile cannot silently turn them off.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ticketspark") -> SparkSession:
    """Session for tests and the bench (a cluster passes its own session in)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for durable intermediate tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir``. Only when none is
    set, and only on a local master, a fresh temporary folder is created (tests).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder")
    local = tempfile.mkdtemp(prefix="ticketspark-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def materialize(df: DataFrame, name: str = "stage",
                partition_by: list[str] | None = None, file_rows: int = 0) -> DataFrame:
    """Write ``df`` as a Parquet table under the checkpoint folder and read it back.

    Used where a derived table is read several times (e.g. the deduplicated tickets
    feeding the split's histogram, cut and final passes). The written table cuts the
    lineage, survives executor loss, and, being columnar, lets each later pass read
    only the columns it needs. With ``partition_by`` (e.g. the split column) a
    later filter on that column reads only the matching folders. Rows of many megabytes go
    ``file_rows`` to a file, since writer and reader hold some of them at once.
    """
    spark = df.sparkSession
    root = checkpoint_root(spark)
    path = os.path.join(root, f"tables/{name}-{uuid.uuid4().hex}")
    # intermediates are written and read a few times only, so space counts most
    writer = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.parquet(path)
    _saved.append(path)
    return spark.read.parquet(path)


_saved: list[str] = []


def saved_paths() -> list[str]:
    return list(_saved)


def keep_path(path: str) -> str:
    """``path``, which this process wrote under the checkpoint folder, for :func:`release`."""
    _saved.append(path)
    return path


def release(spark: SparkSession, paths: list[str]) -> list[str]:
    """Delete these of the tables this process saved with :func:`materialize`; returns the
    deleted paths.

    Uses the Hadoop FileSystem of each path, so it works for HDFS, object stores and
    local folders alike. DataFrames read from these tables are unusable afterwards.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = []
    for path in [p for p in _saved if p in set(paths)]:
        _saved.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            deleted.append(path)
    return deleted


def release_saved(spark: SparkSession, keep: int = 0) -> list[str]:
    """:func:`release` every table this process saved, but for the first ``keep``, and forget
    the shared intermediates if any were built from them."""
    from ticketspark.plans import shared

    deleted = release(spark, _saved[keep:])
    if not keep:
        shared._memo.clear()
    return deleted
