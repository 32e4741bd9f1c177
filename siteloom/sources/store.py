"""Tables that take batches and keyed updates so that a repeated or broken-off write changes nothing.

A table is a folder of Parquet data and a folder of commit files, one JSON line each. Data is
written under a name of its own first; it counts once a commit file, which is created whole or not at
all, names it. A commit holds the batch it took, so a batch that comes again is left out. Two writers
that commit the same version collide on the file's name, and the later one fails.

insert() appends batches. merge() keeps the newest row of each key: rows are dealt to buckets by a
hash of the key, and only buckets with updates are read and written anew, so a merge costs the
touched buckets and not the table. The number of buckets is fixed when the table is made."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "_bucket"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))] if self.fs.exists(self._at(folder)) else []

    # -- commits ------------------------------------------------------------------------------

    def commits(self) -> list[dict]:
        """All commits, oldest first; a file whose line isn't whole, as a writer broke off, is none."""
        names = sorted(n for n in self._names("commits") if n.endswith(".json"))
        if not names:
            return []
        told = {}
        for r in self.spark.read.text([f"{self.path}/commits/{n}" for n in names]).collect():  # a line for each version
            if r["value"].endswith("}"):
                one = json.loads(r["value"])
                told[one["version"]] = one
        return [told[v] for v in sorted(told)]

    def _commit(self, version: int, content: dict) -> None:
        name = self._at(f"commits/{version:012d}.json")
        if self.fs.exists(name) and version not in {c["version"] for c in self.commits()}:
            self.fs.delete(name, False)  # broken off; a whole one makes create() fail
        out = self.fs.create(name, False)
        out.write(bytearray((json.dumps({"version": version, **content}) + "\n").encode()))
        out.close()

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self.commits()[-1]["schema"])

    # -- appended batches -----------------------------------------------------------------------

    def insert(self, rows: DataFrame, batch: str) -> bool:
        """Append a batch; False if it has been taken before."""
        done = self.commits()
        if any(c["batch"] == batch for c in done):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._commit(len(done), {"batch": batch, "folder": folder, "schema": rows.schema.jsonValue()})
        return True

    def insert_stream(self, stream: DataFrame, checkpoint: str):
        """A writer that appends each micro-batch once, however often a batch is repeated after a
        failure; start() begins it."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.insert(rows, f"stream-{number}") and None).option("checkpointLocation", checkpoint)

    def rows(self) -> DataFrame:
        """The committed rows of inserted batches."""
        return self.spark.read.schema(self.schema()).parquet(*(f"{self.path}/{c['folder']}" for c in self.commits()))

    # -- keyed updates --------------------------------------------------------------------------

    def merge(self, updates: DataFrame, keys: list[str], order: str, batch: str, buckets: int = BUCKETS) -> bool:
        """Take updates: of a key's rows the one with the greatest order stays, of equals the
        greatest row. False if the batch has been taken before. Null keys are a key."""
        done = self.commits()
        if any(batch in c["batches"] for c in done[-1:]):
            return False
        last = done[-1] if done else {"where": {}, "batches": [], "buckets": buckets}
        dealt = updates.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(last["buckets"])).cast("int"))
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # at most as many as buckets
        held = self._read({b: last["where"][str(b)] for b in touched if str(b) in last["where"]}, updates.schema)
        every = dealt if held is None else dealt.unionByName(held)
        rest = [c for c in updates.columns if c not in keys and c != order]
        newest = every.groupBy(BUCKET, *keys).agg(F.max(F.struct(order, *rest)).alias("_x")).select(BUCKET, *keys, "_x.*")
        folder = f"data/{uuid.uuid4().hex}"
        self._write(newest.select(*updates.columns, BUCKET), folder)
        where = last["where"] | {str(b): folder for b in touched}
        self._commit(len(done), {"batch": batch, "batches": [*last["batches"], batch], "where": where, "buckets": last["buckets"], "schema": updates.schema.jsonValue()})
        return True

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def _read(self, where: dict, schema: T.StructType) -> DataFrame | None:
        """The rows of buckets, by the folder that holds each."""
        out = None
        for folder in sorted(set(where.values())):
            own = [int(b) for b, f in where.items() if f == folder]
            part = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.path}/{folder}").where(F.col(BUCKET).isin(own))
            out = part if out is None else out.unionByName(part)
        return out

    def state(self) -> DataFrame:
        """The newest row of each key."""
        last, schema = self.commits()[-1], self.schema()
        held = self._read(last["where"], schema)
        return (held if held is not None else self.spark.createDataFrame([], schema)).select(*schema.names)

    def compact(self) -> None:
        """Bring all buckets of a merged table into one folder again, one file each, and delete what
        no longer counts; for when many merges have left many folders and nobody reads old ones."""
        done = self.commits()
        last, schema = done[-1], self.schema()
        held = self._read(last["where"], schema)
        if held is not None and len(set(last["where"].values())) > 1:
            folder = f"data/{uuid.uuid4().hex}"
            self._write(held, folder)
            last = last | {"where": dict.fromkeys(last["where"], folder)}
            self._commit(len(done), {k: v for k, v in last.items() if k != "version"})
        kept = {f.split("/")[1] for f in last["where"].values()}
        for name in self._names("data"):
            if name not in kept:
                self.fs.delete(self._at(f"data/{name}"), True)
