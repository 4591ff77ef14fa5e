"""Reading inputs, and cutting lineage with tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of one Arrow batch that a text function sees at once; a batch is also cut by bytes.
TEXT_ROWS = 512
#: Bytes after which Spark ends an Arrow batch to Python. Its default of 64 MB lets 10,000 texts be one batch, of which executor and worker hold copies.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), the context's checkpoint folder, set to a new one if need be."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpuscle-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path below ``shared_dir`` that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until none of the columns ``taken`` has it, in any case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_SCOPES: list[list[str]] = []


def keep(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lost executors cost no recomputation of it,
    and the plan that follows starts at a scan. Within ``scratch`` the table goes when that ends, unless ``outer``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    scopes = _SCOPES[:-1] if outer else _SCOPES
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the tables kept in it are deleted; what is needed afterwards is kept as ``outer``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end after BATCH_BYTES, unless it has a bound of its own: plans read it when they run."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def small_batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``TEXT_ROWS`` rows, so that Python objects exist for few texts at a time."""
    for start in range(0, max(batch.num_rows, 1), TEXT_ROWS):
        yield batch.slice(start, TEXT_ROWS)


def map_texts(df: DataFrame, schema: str, rows: Callable[[list, list], dict[str, list]]) -> DataFrame:
    """Apply ``rows(doc_ids, texts)`` to slices of ``df``'s columns doc_id and text, wherever they lie: no shuffle.

    ``rows`` returns columns by name, in the order of ``schema`` (a DDL string). Other columns of ``df`` are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                if part.num_rows:
                    made = rows(part.column(0).to_pylist(), part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in target], schema=target)

    return df.select(df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("string").alias("text")).mapInArrow(run, schema)


def map_slices(df: DataFrame, schema: StructType, made: Callable[[pa.RecordBatch], dict[str, pa.Array | list] | pa.RecordBatch]) -> DataFrame:
    """Apply ``made`` to slices of ``df``'s rows, TEXT_ROWS at a time, wherever they lie.

    ``made`` returns columns by name, in the order of ``schema``, or a record batch of the same columns as its slice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                if part.num_rows:
                    found = made(part)
                    if isinstance(found, dict):
                        found = pa.RecordBatch.from_arrays([c if isinstance(c := found[f.name], pa.Array) else pa.array(c, f.type) for f in target], schema=target)
                    yield found

    return df.mapInArrow(run, schema)
