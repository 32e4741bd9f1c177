"""Shared helpers: Arrow batch sizes, shared checkpoints, Arrow map with extra columns."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch; both bound what a Python worker holds at a time.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is
    unset and Spark runs on one machine, as in tests, a new temporary folder takes its place."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siteloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there. A lost executor
    then costs no recomputation, and iterative plans stay short. row_count() tells how many."""
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    _COUNTS[out] = seen
    return out


_COUNTS: WeakKeyDictionary = WeakKeyDictionary()


def row_count(df: DataFrame) -> int:
    """Rows of what cut() returned, counted as they were written: a task that ran twice may have
    counted twice, so this tells sizes, and whether there are rows at all."""
    return _COUNTS[df].get["n"]


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected what refers to them;
    called where much has been shuffled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that is not read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def widen(df: DataFrame, fields: list[tuple[str, T.DataType]], rows: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append Arrow columns made by rows(batch), one array for each field; drop some inputs.
    Inputs that have a field's name are replaced."""
    small_batches(df.sparkSession)
    made = {n.lower() for n, _ in fields}
    names = [c for c in df.columns if c not in drop and c.lower() not in made]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(kept + rows(batch), names=names + [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def texts(column: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in utf8(column)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


