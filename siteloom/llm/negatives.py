"""Operator 12, hard-negative mining by blocked dense products.

Anchors are written once and read back in blocks of at most ANCHOR_ROWS rows and ANCHOR_BYTES
bytes. A block is broadcast, and every candidate batch is multiplied with it in float64, which is
exact as long as no score can reach 2 ** 53 (where the values of a batch would allow that, whole
numbers of any size are multiplied instead). A first pass keeps the best positives of each anchor,
a second the best negatives in the window of each positive. Both keep a running top k in each task;
the tasks' lists are merged in groups of MERGE tasks and then across groups.

mine() takes any rows, anchors, scale, counts and window. Scores are whole numbers; higher ones
come first, ties by smaller id.

Defined results: rows with a null id, label, vector or component, or a component that isn't finite,
take no part. Only vectors of one length are compared. To an anchor, rows of its own id aren't
other rows; several rows of one id are candidates of their own, and several anchor rows of one id
give their rows each. Anchors with fewer positives or negatives have fewer rows, down to none; an
empty table gives no rows. Other columns are not used. A score that no long can hold is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import cut, shared_dir, table

ANCHOR_ROWS, ANCHOR_BYTES, CANDIDATE_ROWS, MERGE = 2048, 32 << 20, 1024, 64
POSITIVES, NEGATIVES, WINDOW, SCALE = 5, 3, (50, 95), 256
#: Stands for no score.
NONE = np.iinfo(np.int64).min


def whole_rows(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the rows of a batch that take part, for each vector length;
    components are floor(scale * x)."""
    lists = batch.column(2)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.ones(len(batch), np.bool_)
    good[owner[~np.isfinite(values)]] = False
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for n in np.unique(length[good]):
        at = np.flatnonzero(good & (length == n))
        with np.errstate(over="ignore"):
            matrix = np.floor(scale * values[start[at][:, None] + np.arange(n)[None, :]])
        yield ids[at], labels[at], matrix


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers. Sums below 2 ** 53 are exact in float64, in any order."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if a.shape[1] * most(a) * most(b) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


class Best:
    """The k best (score, id) of each row, best first; NONE fills up."""

    def __init__(self, rows: int, k: int):
        self.scores, self.ids, self.k = np.full((rows, k), NONE), np.zeros((rows, k), np.int64), k

    def bar(self) -> np.ndarray:
        """What a score has to reach in each row."""
        return np.maximum(self.scores[:, -1], NONE + 1)

    def add(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Merge candidates, which name their row, in any order."""
        if not len(row):
            return
        touched, at = np.unique(row, return_inverse=True)
        old = self.scores[touched] != NONE
        row = np.concatenate([np.nonzero(old)[0], at])
        score, ident = np.concatenate([self.scores[touched][old], score]), np.concatenate([self.ids[touched][old], ident])
        order = np.lexsort((ident, -score, row))
        row, score, ident = row[order], score[order], ident[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.scores[touched], self.ids[touched] = NONE, 0
        self.scores[touched[row[keep]], rank[keep]] = score[keep]
        self.ids[touched[row[keep]], rank[keep]] = ident[keep]


class Block:
    """Anchors of one vector length. lo and hi: the windows of their positives, one column each;
    none in the first pass."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.numbers, self.ids, self.labels, self.matrix = numbers, ids, labels, matrix
        self.lo = self.hi = np.zeros((len(ids), 0), np.int64)

    def positives(self, best: Best, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        fits = (self.labels[:, None] == labels[None, :]) & (self.ids[:, None] != ids[None, :])
        bar = best.bar()
        if scores.shape[1] > best.k and (bar == NONE + 1).any():
            # Below the k-th best of the batch no score counts either.
            bar = np.maximum(bar, np.partition(np.where(fits, scores, NONE), scores.shape[1] - best.k, 1)[:, -best.k])
        row, col = np.nonzero(fits & (scores >= bar[:, None]))
        best.add(row, scores[row, col], ids[col])

    def negatives(self, best: Best, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        slots = self.lo.shape[1]
        bar = np.maximum(self.lo, best.bar().reshape(-1, slots))
        row, col = np.nonzero((scores >= bar.min(1)[:, None]) & (self.labels[:, None] != labels[None, :]) & (scores <= self.hi.max(1)[:, None]))
        score, ident = scores[row, col], ids[col]
        for j in range(slots):
            at = (score >= bar[row, j]) & (score <= self.hi[row, j])
            best.add(row[at] * slots + j, score[at], ident[at])


def _ranges(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges of numbers with at most so many rows each; numbers of a partition count up from
    partition << 33."""
    out, held = [], 0
    for partition, n in sorted(counts):
        base = partition << 33
        for at in range(0, n, most):
            size = min(most, n - at)
            if out and held + size <= most:
                out[-1] = (out[-1][0], base + at + size)
                held += size
            else:
                out.append((base + at, base + at + size))
                held = size
    return out


def _best_of_all(candidates: DataFrame, blocks: list[Block], scale: float, k: int, negative: bool) -> DataFrame:
    """(number, slot, best): the k best of all candidates for each anchor of some blocks and, in
    the second pass, each of its positives; best holds (cost, id) in order, cost the score's negative."""
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        slots = [max(1, b.lo.shape[1]) for b in held]
        best = [Best(len(b.ids) * s, k) for b, s in zip(held, slots)]
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                for ids, labels, matrix in whole_rows(batch.slice(at, CANDIDATE_ROWS), scale):
                    for b, kept in zip(held, best):
                        if b.matrix.shape[1] == matrix.shape[1]:
                            (b.negatives if negative else b.positives)(kept, ids, labels, products(b.matrix, matrix))
        for b, kept, s in zip(held, best, slots):
            for at in range(0, len(kept.scores), 4096):
                yield lists(b.numbers, kept, s, at)

    def lists(numbers: np.ndarray, kept: Best, slots: int, start: int) -> pa.RecordBatch:
        scores, ids = kept.scores[start : start + 4096], kept.ids[start : start + 4096]
        filled = scores != NONE
        at, n = np.flatnonzero(filled[:, 0]), filled.sum(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n[at])]).astype(np.int32))
        pair = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[filled]))
        return pa.RecordBatch.from_arrays([pa.array(numbers[(start + at) // slots]), pa.array(((start + at) % slots).astype(np.int32)), pair(-scores), pair(ids)], names=["number", "slot", "cost", "id"])

    found = candidates.mapInArrow(run, "number long, slot int, cost array<long>, id array<long>")
    found = found.select("number", "slot", F.expr(f"spark_partition_id() div {MERGE}").alias("tasks"), F.arrays_zip("cost", "id").alias("best"))
    first = lambda keys, df: df.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return first(["number", "slot"], first(["number", "slot", "tasks"], found))


def mine(rows: DataFrame, anchor: Column, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """rows: (id long, label, vector). (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for the anchors, which are the rows where anchor holds; window in percent of
    the positive's score. The result is written to the shared store, block by block."""
    spark = rows.sparkSession
    held = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    picked = held.where(anchor).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    candidates = held.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, matrix in whole_rows(batch, scale):
                offsets = pa.array((np.arange(len(ids) + 1) * matrix.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))], names=["id", "label", "vector"])

    anchors = cut(picked.mapInArrow(clean, "id long, label long, vector array<double>").select(F.monotonically_increasing_id().alias("number"), "*"))
    counts = anchors.groupBy(F.expr("number >> 33").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("length")).collect()  # one row for each partition
    longest = max((r["length"] for r in counts), default=1)
    most = max(1, min(ANCHOR_ROWS, ANCHOR_BYTES // (8 * max(1, longest))))
    target = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    written = []
    for i, (lo, hi) in enumerate(_ranges([(r["p"], r["n"]) for r in counts], most)):
        blocks = _blocks(anchors.where((F.col("number") >= lo) & (F.col("number") < hi)).toArrow())
        near = _best_of_all(candidates, blocks, scale, positives, False).toArrow()  # positives of one block
        shown = _windows(blocks, near, positives, window)
        if any(b.lo.size for b in blocks):
            far = _best_of_all(candidates, blocks, scale, negatives, True)
            told = spark.createDataFrame(shown).join(far, ["number", "slot"])  # rows of one block
            ranked = told.select("anchor_id", "positive_id", F.posexplode("best").alias("at", "x"), "positive_score")
            out = ranked.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.cost")).alias("negative_score"))
            written.append(f"{target}/{i}")
            out.write.parquet(written[-1])
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def _blocks(found: pa.Table) -> list[Block]:
    """The anchors of a table, by the length of their vectors."""
    out = []
    found = found.combine_chunks()
    if not found.num_rows:
        return out
    length = pc.list_value_length(found["vector"]).to_numpy()
    for n in np.unique(length):
        part = found.filter(pa.array(length == n))
        column = lambda c: part[c].to_numpy()
        matrix = pc.list_flatten(part["vector"]).to_numpy().reshape(part.num_rows, n)
        out.append(Block(column("number"), column("id"), column("label"), matrix))
    return out


def _windows(blocks: list[Block], near: pa.Table, positives: int, window: tuple[int, int]) -> pa.Table:
    """Sets the windows of a block's positives, and tells (number, slot, anchor_id, positive_id,
    positive_score)."""
    best = {r["number"]: [(-x["cost"], x["id"]) for x in r["best"]] for r in near.to_pylist()}
    rows = []
    for b in blocks:
        b.lo, b.hi = np.full((len(b.ids), positives), np.iinfo(np.int64).max), np.full((len(b.ids), positives), NONE)
        for i, number in enumerate(b.numbers.tolist()):
            for slot, (score, ident) in enumerate(best.get(number, ())):
                b.lo[i, slot], b.hi[i, slot] = -(-score * window[0] // 100), score * window[1] // 100
                rows.append((number, slot, int(b.ids[i]), ident, score))
        if not any(n in best for n in b.numbers.tolist()):
            b.lo = b.hi = np.zeros((len(b.ids), 0), np.int64)
    blocks[:] = [b for b in blocks if b.lo.size]
    kinds = [("number", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % 50 == 0)


ORACLE = """
WITH held AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor, c.id AS other, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM held a JOIN held c ON a.id % 50 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)
), positive AS (
  SELECT anchor, other, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
  n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
