"""Tables laid out for keyset pages: the rows after a cursor are found in few files.

lay_out() deals the rows to files by ranges of the order, newest first, sorts each file and writes
an index: a row for each file with what it holds. page() reads from the index which files hold the
rows after a cursor, and from these files, sorted as they are, the row groups that the cursor leaves.
Null is the least value of a column of the order."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_ROWS = 1_000_000


def lay_out(rows: DataFrame, path: str, order: list[str], file_rows: int = FILE_ROWS) -> None:
    """Write the rows in files of about file_rows. The index is written last, so a layout that broke
    off has none; the path must be new."""
    newest = [F.desc(k) for k in order]
    files = max(1, ceil(rows.count() / file_rows))
    rows.repartitionByRange(files, *newest).sortWithinPartitions(*newest).write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows").withColumns({"_file": F.col("_metadata.file_path"), "_key": F.struct(*order)})
    stored.groupBy("_file").agg(F.max("_key").alias("high"), F.min("_key").alias("low"), F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/index")


def files_after(spark: SparkSession, path: str, cursor: tuple | None, most: int) -> list[str]:
    """The files that hold the first rows after a cursor: those in whose range it lies, and as many
    below it as give most rows."""
    index = spark.read.parquet(f"{path}/index")
    if cursor is not None:
        at = _cursor(index, "low", cursor)
        index = index.where(F.col("low") < at).withColumn("whole", F.col("high") < at)
    else:
        index = index.withColumn("whole", F.lit(True))
    out, held = [], 0
    for r in index.orderBy(F.desc("high"), F.desc("low")).select("_file", "whole", "n").take(most + 1):  # no file is empty
        out.append(r["_file"])
        held += r["n"] if r["whole"] else 0
        if held >= most:
            break
    return out


def page(spark: SparkSession, path: str, schema, order: list[str], cursor: tuple | None = None, limit: int = 20) -> DataFrame:
    """The rows after a cursor (a value for each column of the order), newest first: one more than
    limit tells whether there are others."""
    files = files_after(spark, path, cursor, limit + 1)
    if not files:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*files)
    if cursor is not None:
        first = F.lit(cursor[0]).cast(rows.schema[order[0]].dataType)
        if cursor[0] is not None:  # by this row groups are left out
            rows = rows.where((F.col(order[0]) <= first) | F.col(order[0]).isNull())
        key = F.struct(*order)
        rows = rows.withColumn("_key", key).where(F.col("_key") < _cursor(rows.withColumn("_key", key), "_key", cursor)).drop("_key")
    return rows.orderBy(*(F.desc(k) for k in order)).limit(limit + 1)


def _cursor(df: DataFrame, column: str, cursor: tuple):
    kind = df.schema[column].dataType
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cursor, kind.fields)))
