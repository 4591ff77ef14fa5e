"""Tables kept in the folder that all executors share, and derived tables that are made once for an unchanged input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), the context's checkpoint folder, set to a new one if need be."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpuscle-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_name(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below ``shared_dir`` that nothing else uses."""
    return f"{shared_dir(spark)}/{new_name(label)}"


#: Whether Spark removes what a query has shuffled as soon as it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``, read again: what follows starts at a scan, and lost executors cost none of what went before. Shuffle files
    go when the table is there. ``options`` are those of the writer."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes after which an Arrow batch to Python ends: by Spark's default of 64 MB each of an executor's workers, and the JVM beside them, hold 10,000 texts.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end after BATCH_BYTES, unless it has a bound of its own: plans read it when they run."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def signature(spark: SparkSession, paths: list[str]) -> int:
    """A number that changes when a file below ``paths`` does: names, sizes and times alone are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return listed.agg(F.coalesce(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")), F.lit(0))).first()[0]
