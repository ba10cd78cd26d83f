"""Tables of the text-preparation operators, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.storage import shared_dir, spread, stored, table

__all__ = ["bounded_batches", "documents", "hash_sample", "shared_dir", "spread", "stored", "table"]


#: Rows and bytes of text that a Python worker gets at a time. Spark's own bounds (10,000 rows, 64 MB) let two
#: workers and the buffers on either side take several hundred megabytes of an executor.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES`` at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def hash_sample(df: DataFrame, bound: int, *columns: str) -> DataFrame:
    """About ``bound`` rows of ``df`` at most, chosen by the hash of some columns.

    Each row is judged alone, at a rate that the row count sets, so no rows meet
    in one task. Rows with equal values in all of ``columns`` stay or go
    together, so these must tell rows apart: the text alone would let a large
    group of copies in as a whole.
    """
    total = df.count()
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
