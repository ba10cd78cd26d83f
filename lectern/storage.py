"""Where intermediate tables live.

Lineage is cut with Parquet tables in the shared folder that the session names
in ``spark.checkpoint.dir``; only where that setting is unset and Spark is local
(tests, a laptop) a folder of our own is used. On a cluster without it there is
no folder that all executors share, and that is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master or 'this cluster'} share")
        place = os.path.join(tempfile.gettempdir(), "lectern-checkpoints")
    return place.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session ends."""
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The schema is handed to the reader, so an empty result keeps its columns.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Have the driver look for shuffle files that no table needs any more; they stay until it happens to, otherwise."""
    context = getattr(spark, "_sc", None)
    if context is not None:
        context._jvm.System.gc()


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Megabytes of input for each core below which texts are dealt out.
SMALL_MB = 4


def spread(rows: DataFrame, below_mb: int = SMALL_MB) -> DataFrame:
    """``rows``, dealt out to all cores if there are fewer than ``below_mb`` megabytes for each of them.

    Such a file has one row group or two, whatever its splits, and work on long
    texts would wait for the one task that has them. Larger inputs are left as
    they are, so nothing large is ever shuffled for this; 0 deals out nothing.
    Where a session does not tell the size (a remote client), rows stay as they are.
    """
    plan = getattr(rows, "_jdf", None)
    if plan is None or below_mb <= 0:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * (below_mb << 20) else rows
