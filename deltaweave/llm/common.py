"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is empty on a single machine, as in tests, a temporary folder is set and used; on a
    cluster its absence is an error, since executors don't share local folders.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}"))
        return sc.getCheckpointDir()
    return root


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: columnar, compressed, read with pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Python workers get fewer rows at a time, unless the session has its own number: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's default
        spark.conf.set(name, str(rows))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of frames that are no longer held: it acts when the driver's
    garbage is collected, which a long job with a small driver may otherwise not do for hours."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Called at a task's end in Python: freed memory goes back to the machine, since workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def bounded_sample(rows: DataFrame, size: int, *, id_col: str, also: Column | None = None) -> DataFrame:
    """About `size` rows (1.3 times as many are expected), one for each id, chosen by a hash of the id.

    The share that is kept follows from a count, so no task sorts or sends more than its part of the sample, and the
    same rows are chosen however the table is divided. `also` is a costlier condition that the count leaves out.
    """
    n = rows.count()
    share = min(1.0, 1.3 * size / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return (chosen if also is None else chosen.where(also)).dropDuplicates([id_col])
