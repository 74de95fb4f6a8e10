"""Shared scratch space: written tables cut lineage, so a lost executor costs one stage and no more."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark drops a query's shuffle files at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_USED: dict[str, set[str]] = {}
_OPEN: list[list[str]] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one is set only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file://" + root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    path = f"{checkpoint_root(spark)}/skein-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _USED:
        atexit.register(_clear_at_exit, spark)
    _USED.setdefault(app, set()).add(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: a reliable checkpoint in a columnar format."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    # what has been written needs its shuffle files no more
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def recorded():
    """The scratch folders that are made inside, so that their owner can delete them when its result is written."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)


def _clear_at_exit(spark: SparkSession) -> None:
    """What nobody has deleted before goes with the application, if it still runs."""
    try:
        for path in _USED.pop(spark.sparkContext.applicationId, ()):
            delete(spark, path)
    except Exception:  # noqa: BLE001  the application has ended
        pass


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark a written table for broadcast only if its rows and bytes, both counted, stay within the bounds; else Spark shuffles."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= max_bytes else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
