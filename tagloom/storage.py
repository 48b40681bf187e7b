"""Tables in the shared folder that the session names; they cut the lineage and survive lost executors.

A table is released when its last reader is done. What a lazy result still
reads stays until `release` is called on it or the shared folder is cleared.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_folders: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session, as in tests, may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tagloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts the lineage for good.

    Meanwhile Python gets rows in smaller batches, as a batch of whole texts or of sets is held several times at once by each task."""
    spark = df.sparkSession
    path = scratch(spark)
    usual, usual_bytes = spark.conf.get(BATCH), spark.conf.get(BYTES)
    try:
        spark.conf.set(BATCH, str(min(int(usual), BATCH_ROWS)) if int(usual) > 0 else str(BATCH_ROWS))
        spark.conf.set(BYTES, f"{BATCH_BYTES}b")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, usual)
        spark.conf.set(BYTES, usual_bytes)
    _folders[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def live() -> set[str]:
    """The folders of tables that are not released."""
    return set(_folders)


def drop(folders: set[str]) -> None:
    """Deletes folders of materialize, and lets Spark's cleaner remove the shuffle files that nothing refers to any more."""
    spark = None
    for path in folders:
        spark = _folders.pop(path, None)
        if spark is None or spark.sparkContext._jsc is None:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if spark is not None and spark.sparkContext._jsc is not None:
        spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize gave; nothing may read them afterwards."""
    drop({t.scratch_folder for t in tables})


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else as it is. For rows of fixed size."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
