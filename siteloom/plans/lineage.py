"""Cutting long plans at checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset and Spark runs on one
    machine, as in tests, a temporary folder takes its place."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siteloom-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, which survives lost executors and ends the plan before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes for each core up to which a stored table is dealt out: what one task of a scan reads.
SPREAD_BYTES = 128 << 20


def spread(stored: DataFrame) -> DataFrame:
    """A stored table before work that is heavy for each row: where it has fewer files than there
    are cores (a file may be a single row group, and so a single task), its rows are dealt out. A
    table of more than SPREAD_BYTES a core is read as it is, as its scan has a task for each core
    anyway, so what is shuffled has a bound."""
    spark = stored.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, stored.inputFiles()
    if len(files) >= cores:
        return stored
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return stored.repartition(cores) if size <= cores * SPREAD_BYTES else stored
