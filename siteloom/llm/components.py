"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round only takes minima by node (aggregated before the shuffle) and joins them back to
the edges (a join whose hot keys Spark can split), so a hub with a large share of all edges
does not gather in one task. Rounds are cut by checkpoints in the shared folder. A graph of at
most SMALL edges is done in one task, as its rounds would be latency only; the result is the
same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import cut, row_count

#: Edges that one task takes (some ten MB in Python).
SMALL = 100_000


def _star(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): links each v, and u, to the least of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    linked = _star(edges)  # u > v in every edge, so the neighbours are the smaller ones
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) by union and find, for about SMALL edges."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        types = None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in batches:
            types = batch.schema.field("u").type
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if types:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, types), pa.array([root(x) for x in nodes], types)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", bound: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge with two different ends; component is the
    least node. Null ends and loops are ignored; repeated edges count once. bound: the number of
    edges, where it is known."""
    one = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src), F.col(dst))
    one = one.where(f"{src} IS NOT NULL AND {dst} IS NOT NULL AND u <> v").select("u", "v")
    if bound is None or bound > SMALL:
        one = cut(one.distinct())
        bound = row_count(one)
    if bound <= SMALL:
        return cut(_in_one_task(one))
    edges, mark = one, _mark(one)
    while mark[0]:
        edges = cut(_small(_large(edges)))
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))
