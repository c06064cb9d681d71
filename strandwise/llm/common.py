"""What the operators of this subpackage share: intermediate tables, splitting work, folds."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import strandwise.llm

# Functions go to the executors whole, so that these need not have this package.
cloudpickle.register_pickle_by_value(strandwise.llm)

#: Rows of one Arrow batch; with whole texts in them this bounds a Python worker's memory.
ARROW_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of
    its own; a cluster gets an error, as a folder of one machine would lose rows there."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"strandwise-{os.getpid()}")
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise wrote and that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strandwise/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(x: np.ndarray) -> bytes:
    """Bytes of integers, those of equal weight together, so that the many zeros compress well."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(memoryview(b)[8:], n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows that a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int):
    """The remainder that assigns a row to a fold: crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def boxed(df: DataFrame, *others, without: tuple[str, ...] = ()) -> DataFrame:
    """df's columns as one column, row, so that no name of theirs meets ours, and other columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("row"), *others)
