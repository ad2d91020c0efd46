"""Session and scratch-space helpers.

On a cluster the session is built by the caller and ``spark.checkpoint.dir``
names a shared folder; we only read it.  A private folder is created only when
the setting is missing (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "nearline") -> SparkSession:
    master = master or os.environ.get("NEARLINE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="nearline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/nearline/{name}-{uuid.uuid4().hex}"


# Key columns of the driver tables, for scans that the session asks to split.
TABLE_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "benchmark": "item_id", "conversations": "conv_id",
              "events": "event_id", "pages": "page_id", "labels": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table.  A session that reads files of a single row group (which no
    scan can split) may set ``spark.nearline.scanPartitions``; tables are then
    hash-partitioned on their key into so many parts.  Unset: scanned as stored."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get("spark.nearline.scanPartitions", None)
    return df.repartition(int(parts), TABLE_KEYS[name]) if parts and name in TABLE_KEYS else df


#: Open scopes of stored tables, innermost last: each a list of paths.
_SCOPES: list[list[str]] = []


@contextmanager
def stored_tables(spark: SparkSession):
    """Owner of the tables that ``materialize`` writes inside the block: they are deleted at its end.

    Results that read them must be written or collected before.  Tables written
    outside of any block stay, as their reader may run at any later time.
    """
    mine: list[str] = []
    _SCOPES.append(mine)
    try:
        yield mine
    finally:
        _SCOPES.remove(mine)
        release(spark, mine)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables by path, on whatever file system holds them."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    paths.clear()


#: Spark's setting by which an execution deletes its shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside the block leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (the stored copy survives executor
    loss) while later reads stay columnar, pruned and vectorised.  An open
    ``stored_tables`` block owns the copy.
    """
    path = scratch_path(df.sparkSession, name)
    if _SCOPES:
        _SCOPES[-1].append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
