"""Lineage cuts in storage that every executor shares, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimate in bytes (of files, compressed) of a side that `broadcast_if_small` lets be broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the Python path of the workers, for drivers that found it some other way.

    On a cluster the package must be installed, or lie at the same path, on every executor.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (`spark.checkpoint.dir`). Where that is unset, a private folder is used if all work is
    done on this machine; on a cluster it is an error, as each executor would write to a disk of its own."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="glossmill-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by `clear` or when the driver's Python ends."""
    if not _written:
        atexit.register(clear)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once to the shared folder and read it back, so later passes neither recompute nor lose it.

    The table survives the loss of any executor. It stays until `clear` or the end of the driver's Python.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete all intermediate tables so far. Frames that come from them can't be used after it: call it in a long session
    once their results are written."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already; the folder belongs to the cluster then
            pass


def estimate(df: DataFrame) -> int:
    """The optimizer's own estimate of the size of `df` in bytes (of files, compressed)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many partitions as there are cores if it is so small that its scan has fewer; else `df` itself.

    A scan gets a partition for each `openCostInBytes` at least, so only inputs under that much a core are moved, which
    costs little; larger ones, of whatever size, are never shuffled for it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    return df.repartition(cores) if estimate(df) < cores * least else df


def once(df: DataFrame, **columns) -> DataFrame:
    """`df` with new columns, each computed exactly once a row.

    The optimizer moves a filter on a projected column below the projection and so computes the column twice; it can't
    move one below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the optimizer's own estimate of `df` is under `limit` bytes."""
    return F.broadcast(df) if estimate(df) <= limit else df
