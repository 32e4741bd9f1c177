"""Operator 10, n-gram Jaccard join by chosen paths.

A document's set holds its shingles of five words (lower-cased; runs of 0-9, a-z and anything
beyond ASCII). Equal sets are one representative with a weight. Run k sends every set to the
bucket of its k-th sampled token: tokens are sampled by the order of a hash, so similar sets
sample the same ones. Buckets of one set end there, small ones are compared by brute force.
The sets of a large bucket are contracted block by block; if it has few blocks, all are then
compared with each other, and if one family is left with a few others, these are compared with
all of it. A bucket that stays mixed (its token is very frequent, as those of a passage that
many documents share) is split on the next sampled tokens of its
sets, until their runs reach the target recall: a set stops after n runs of which b ended in
mixed buckets if so few could hardly be (binomial) were all tokens that it shares with a similar
set frequent. That holds for any distribution of tokens, as each sampled token of a set is
shared with a similar one with a chance of the threshold at least. What is bought by a run is
one row for a set. Sets that are still open after PICKS tokens (most of their tokens are
frequent) are split further inside their buckets, on sampled tokens of their MinHash embeddings
(SKETCH minimum hashes); what is large after MAX_DEPTH rounds is compared in full, block
against block.

Inside a bucket embeddings are compared: two sets may be similar if they agree in as many places
as all pairs at the threshold do but one in a million. Such candidates are contracted to
families as they are found, and a bucket whose sets are of one family already is done: a group
of thousands of near copies is joined by a few comparisons of each member. Then whole token sets
are compared within each family, exactly and block against block, which gives the links of
every document and the classes. Blocks are bounded by rows and by tokens, and no pair is ever a
row.

Result: one row for each document with class_id (the least doc_id of its component) and n_links
(other documents with a Jaccard similarity of the threshold or more; copies count).

Defined results: texts of one to four words are one shingle; texts without words are copies
only if equal. A null text, and a row with a null doc_id, is a class of its own without links
(class_id is its doc_id). Rows that repeat a doc_id, with one text or several, are one class,
and each counts as a document of its own for links. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import cut, release, row_count, small_batches, table, texts
from siteloom.llm.components import connected_components
from siteloom.llm.decontam import words

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
#: Tokens that a set samples at most.
PICKS = 48
#: Rounds of splitting buckets by embeddings, and levels of a round.
MAX_DEPTH, LEVELS = 3, 2
#: Times as many places are sampled on the first level of a round, so that few pairs are lost.
WIDTH = 4
#: Members of a bucket, and of a block; every TOKENS tokens of a set count as one member more.
LIMIT, BLOCK, TOKENS = 256, 1024, 1024
#: Sets with mixed buckets that are broadcast (16 bytes each); more are joined by a shuffle.
FEW = 200_000
#: Blocks of a bucket that is compared in full, after it was contracted block by block.
FULL = 4
#: Minimum hashes of a sketch, and the share of pairs at the threshold that it may miss.
SKETCH, SKETCH_MISS = 32, 1e-6
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 20

_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = words(text.lower().encode("utf-8", "replace")) if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _P + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sampled(tokens: np.ndarray, size: int = PICKS) -> np.ndarray:
    """The tokens of a set with the least hashes, in the order of these."""
    h = _mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    if len(h) > size:
        some = np.argpartition(h, size)[:size]
        tokens, h = tokens[some], h[some]
    return tokens[np.argsort(h)]


def sketch(tokens: np.ndarray) -> bytes:
    """16 bits of the least hash of the set under each of SKETCH hash functions."""
    seeds = _mix(np.arange(1, SKETCH + 1, dtype=np.uint64) + np.uint64(1 << 32))[:, None]
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(tokens), 1 << 14):
        least = np.minimum(least, _mix(tokens[None, at : at + (1 << 14)] ^ seeds).min(axis=1))
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def agreement(threshold: float) -> int:
    """Places of two sketches that agree for all pairs at the threshold but SKETCH_MISS."""
    missed, m = 0.0, 0
    while m < SKETCH:
        missed += math.comb(SKETCH, m) * threshold**m * (1 - threshold) ** (SKETCH - m)
        if missed > SKETCH_MISS:
            break
        m += 1
    return m


def _at_most(b: int, n: int, p: float) -> float:
    """The chance of b or less out of n."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(b + 1))


class Runs:
    """How many runs a set needs for a recall at a threshold."""

    def __init__(self, threshold: float, recall: float):
        self.threshold, budget = threshold, 1 - recall - SKETCH_MISS
        if budget <= 0:
            raise ValueError(f"sketches of {SKETCH} places don't reach a recall of {recall}")
        share = budget / 16  # either set of a pair may be the one that stops, at one of a few places
        #: By runs: the most mixed buckets with which a set stops (-1: it can't).
        self.stop = [max([-1, *(b for b in range(n + 1) if _at_most(b, n, threshold) <= share)]) for n in range(PICKS + 1)]
        able = [n for n in range(PICKS + 1) if self.stop[n] >= 0]
        if not able:
            raise ValueError(f"{PICKS} tokens don't reach a recall of {recall} at {threshold}")
        self.first = able[0]
        #: By mixed buckets among the first runs: runs after which the set should be able to stop.
        self.then = [next((n for n in range(self.first + 1, PICKS) if self.stop[n] >= math.ceil(n * (b + 0.5) / self.first)), PICKS) for b in range(self.first + 1)]
        self.paths = next((n for n in range(1, PICKS) if 2 * self._lost(n) <= budget), PICKS)

    def _lost(self, paths: int) -> float:
        """The chance that a pair at the threshold whose buckets are all split by embeddings is
        never compared."""
        out, least, t = 0.0, agreement(self.threshold), self.threshold
        for m in range(least, SKETCH + 1):
            lost = 0.0  # by a pair of a large bucket whose sketches agree in m places
            for width in [*[1] * (LEVELS - 1), WIDTH] * (MAX_DEPTH - 1):
                lost = (1 - min(1.0, width / (t * SKETCH)) * (1 - lost)) ** m
            out += math.comb(SKETCH, m) * t**m * (1 - t) ** (SKETCH - m) * (1 - t * (1 - lost)) ** paths
        return out

    def missed(self) -> float:
        """The chance that a pair at the threshold is not found, if all tokens that both sets
        share are frequent (the worst case), but for pairs that embeddings split further."""
        t, n0 = self.threshold, self.first
        one = lambda b, n: math.comb(n, b) * t**b * (1 - t) ** (n - b)
        out = _at_most(self.stop[n0], n0, t)
        for b in range(self.stop[n0] + 1, n0 + 1):
            n = self.then[b]
            stopped = _at_most(self.stop[n] - b, n - n0, t) if self.stop[n] >= b else 0.0
            out += one(b, n0) * stopped
        return 2 * (out + _at_most(self.stop[PICKS], PICKS, t)) + SKETCH_MISS


def sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, key of the set, n shingles, sampled tokens, sketch)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, picks, sketches = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingles(text, size)
                counts.append(len(s))
                picks.append(sampled(s).astype(np.int64))
                sketches.append(sketch(s) if len(s) else None)
                if len(s):
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                else:
                    keys.append(None if text is None else xxhash.xxh3_128_digest(b"no words" + text.encode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(picks, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "key", "n", "picks", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, n long, picks array<long>, sketch binary")


def _alike(threshold: float):
    """Links components of members (rep, comp, size, sketch) whose sketches agree."""
    least = agreement(threshold)

    def linked(mine: list[tuple], other: list[tuple] | None) -> list[tuple]:
        x = np.stack([np.frombuffer(r[3], np.uint16) for r in mine])
        y = x if other is None else np.stack([np.frombuffer(r[3], np.uint16) for r in other])
        same = np.zeros((len(x), len(y)), np.int8)
        for k in range(SKETCH):
            same += x[:, k][:, None] == y[:, k][None, :]
        return _forest(mine, other, same >= least)

    return linked


def candidates(rows: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """Edges (src, dst) between components of the rows (rep, node, comp, size, sketch) of a node
    whose sketches agree, as few as join them (a spanning forest). Large nodes are compared in
    blocks: pairs: every block also with every other, else each by itself."""
    groups = _in_blocks(rows, BLOCK if pairs else LIMIT, pairs).select("node", "b1", "b2", "mine", "rep", "comp", "size", "sketch")
    return _grouped(groups, _alike(threshold), ["src", "dst"])


def split(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, node) LEVELS levels down: a node samples places of the embedding, and sets with the
    same token there stay together."""

    def children(node: Column, width: int) -> Column:
        some = int(width * (1 << 20) / (threshold * SKETCH))
        places = F.filter(F.sequence(F.lit(0), F.lit(SKETCH - 1)), lambda i: F.pmod(F.xxhash64(node, i), F.lit(1 << 20)) < some)
        return F.transform(places, lambda i: F.xxhash64(node, i, F.substr("sketch", 2 * i + 1, F.lit(2))))

    nodes = F.array("node")
    for width in [WIDTH, *[1] * (LEVELS - 1)]:
        nodes = F.flatten(F.transform(nodes, lambda node: children(node, width)))  # noqa: B023
    return rows.select("rep", F.explode(nodes).alias("node"))


def _open(rows: DataFrame, comps: DataFrame | None, sketches: DataFrame) -> DataFrame:
    """The rows (rep, node) of nodes with members of two components or more, with comp, the
    node's size and the sketch. The sizes are written first, so that Spark can split the join
    with them at hot nodes."""
    named = rows.select("rep", "node", F.col("rep").alias("comp")) if comps is None else _named(rows.select("rep", "node"), comps)
    sizes = cut(named.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node", "size"))
    return named.join(sizes, "node").join(sketches, "rep").select("rep", "node", "comp", "size", "sketch")


def _with(comps: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """Components found so far stand for the edges that made them."""
    edges = cut(edges)
    n = row_count(edges)
    if not n:
        return comps
    if comps is not None:
        edges = edges.union(comps.select(F.col("component").alias("src"), F.col("node").alias("dst")).where("src <> dst"))
        n += row_count(comps)
    return connected_components(edges, bound=n)


def _in_full(large: DataFrame, threshold: float) -> DataFrame:
    """The edges of nodes of at most FULL blocks, every block against every other: FULL rows for
    a member, fewer than further runs or a split would take."""
    return candidates(large.where(f"size <= {FULL * BLOCK}"), threshold, True)


def _few_others(large: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Large nodes with at most LIMIT members beyond their main component: the edges of these
    with all members. And the nodes with more."""
    counts = large.groupBy("node", "comp").count()
    tops = counts.groupBy("node").agg(F.sum("count").alias("all"), F.max(F.struct("count", "comp")).alias("top"))
    tops = cut(tops.select("node", (F.col("all") - F.col("top.count")).alias("rest"), F.col("top.comp").alias("main"), F.ceil(F.col("top.count") / BLOCK).cast("long").alias("blocks")))
    met = large.join(tops.where(f"rest <= {LIMIT}"), "node")
    in_main, zero = F.col("comp") == F.col("main"), F.lit(0).cast("long")
    met = met.withColumn("mine", F.when(in_main, 1 + F.pmod(F.xxhash64("rep", "node"), "blocks")).otherwise(zero))
    met = met.withColumns({"b1": zero, "b2": F.explode(F.when(in_main, F.array("mine")).otherwise(F.sequence(zero, "blocks")))})
    edges = _grouped(met.select("node", "b1", "b2", "mine", "rep", "comp", "size", "sketch"), _alike(threshold), ["src", "dst"])
    return edges, tops.where(f"rest > {LIMIT}").select("node")


def settle(rows: DataFrame, comps: DataFrame | None, sketches: DataFrame, threshold: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Compares the sets of the rows (rep, pos, node) in their nodes: the components, and the
    rows of mixed nodes, whose sets are not all compared (None: there are no such)."""
    shared = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("node"))
    rows = cut(rows.join(shared, "node").select("rep", "pos", "node"))
    release(rows.sparkSession)
    wide = cut(_open(rows, comps, sketches))
    # Small nodes whole, large ones contracted in blocks.
    comps = _with(comps, candidates(wide, threshold, False))
    release(rows.sparkSession)
    large = cut(_open(wide.where(f"size > {LIMIT}"), comps, sketches).where(f"size > {LIMIT}"))
    if not row_count(large):
        return comps, None
    edges, mixed = _few_others(large.where(f"size > {FULL * BLOCK}"), threshold)
    comps = _with(comps, edges.union(_in_full(large, threshold)))
    mixed = cut(rows.join(mixed, "node", "left_semi").select("rep", "pos", "node"))
    release(rows.sparkSession)
    return comps, mixed if row_count(mixed) else None


def _sampled_rows(reps: DataFrame, low: Column, high: Column) -> DataFrame:
    """(rep, pos, node) for the sampled tokens from low to high."""
    told = reps.where(F.size("picks") > low).select("rep", low.alias("low"), F.posexplode(F.slice("picks", low + 1, high - low)).alias("at", "node"))
    return told.select("rep", (F.col("low") + F.col("at")).alias("pos"), "node")


def families(reps: DataFrame, runs: Runs) -> DataFrame:
    """(rep, comp): the families of two sets or more. reps: (rep, picks, sketch)."""
    threshold, sketches = runs.threshold, reps.select("rep", "sketch")
    rows = cut(_sampled_rows(reps, F.lit(0), F.lit(runs.first)))
    comps, mixed = settle(rows, None, sketches, threshold)
    taken = None  # (rep, n): runs of the sets that took more than the first ones
    for last in (False, True):
        if mixed is None:
            break
        still = _unsettled(reps, mixed, taken, runs).where("size(picks) > n").withColumn("next", F.lit(PICKS) if last else F.element_at(F.array(*map(F.lit, runs.then)), F.least("b", F.lit(runs.first)).cast("int") + 1))
        still = cut(still)
        if not row_count(still):
            break
        known = mixed.select("node").distinct().withColumn("known", F.lit(True))
        new = cut(_sampled_rows(still, F.col("n"), F.col("next")).join(known, "node", "left"))
        fresh = new.where("known IS NULL").select("rep", "pos", "node")
        # Sets that stopped take part in the new buckets of their own tokens.
        others = rows.join(fresh.select("node"), "node", "left_semi").select("rep", "pos", "node")
        comps, more = settle(cut(fresh.union(others)), comps, sketches, threshold)
        mixed = mixed.union(new.where("known").select("rep", "pos", "node"))
        mixed = cut((mixed if more is None else mixed.union(more)).distinct())
        rows = rows.union(new.select("rep", "pos", "node"))
        now = still.select("rep", F.col("next").alias("n"))
        taken = now if taken is None else now.union(taken.join(now, "rep", "left_anti"))
    if mixed is not None:
        still = cut(_unsettled(reps, mixed, taken, runs).select("rep"))
        if row_count(still):
            comps = _embedded(mixed.where(F.col("pos") < runs.paths).join(still, "rep", "left_semi"), comps, sketches, threshold)
    if comps is None:
        return reps.select("rep", F.col("rep").alias("comp")).limit(0)
    return comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))


def _unsettled(reps: DataFrame, mixed: DataFrame, taken: DataFrame | None, runs: Runs) -> DataFrame:
    """(rep, picks, n, b): sets that can't stop after n runs, b of which ended in mixed nodes. A
    set all of whose tokens are sampled stops if fewer are mixed than a similar set shares."""
    counts = mixed.groupBy("rep").agg(F.count(F.lit(1)).alias("b"))
    counts = counts.withColumn("n", F.lit(runs.first)) if taken is None else counts.join(taken, "rep", "left").withColumn("n", F.coalesce("n", F.lit(runs.first)))
    counts = cut(counts)
    if row_count(counts) <= FEW:  # so that the tokens of all other sets stay where they are
        counts = F.broadcast(counts)
    told = reps.select("rep", "picks").join(counts, "rep")
    stop = F.element_at(F.array(*map(F.lit, runs.stop)), F.col("n") + 1)
    whole = (F.size("picks") <= F.col("n")) & (F.col("b") < F.size("picks") * runs.threshold)
    return told.where(~(F.col("b") <= stop) & ~whole).select("rep", "picks", "n", "b")


def _embedded(rows: DataFrame, comps: DataFrame | None, sketches: DataFrame, threshold: float) -> DataFrame | None:
    """The components after the rows' nodes are split on their sets' embeddings."""
    rows = cut(_open(rows, comps, sketches))
    comps = _with(comps, candidates(rows, threshold, False))
    for depth in range(1, MAX_DEPTH + 1):
        large = cut(_open(rows.where(f"size > {LIMIT}"), comps, sketches).where(f"size > {LIMIT}"))
        if not row_count(large):
            break
        if depth == MAX_DEPTH:
            return _with(comps, candidates(large, threshold, True))
        comps = _with(comps, _in_full(large, threshold))
        rows = cut(_open(cut(split(large.where(f"size > {FULL * BLOCK}"), threshold)), comps, sketches))
        comps = _with(comps, candidates(rows, threshold, False))
        release(rows.sparkSession)
    return comps


def token_sets(docs: DataFrame, wanted: DataFrame, size: int = WORDS) -> DataFrame:
    """(rep, tokens) of the documents whose id is among the wanted reps; tokens as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, size).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["rep", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted.hint("shuffle_hash"), "rep", "left_semi")
    return chosen.mapInArrow(run, f"rep {kind}, tokens binary")


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of each row set with each column set (None: the rows), as
    products of 0/1 matrices over the tokens that occur twice, some columns at a time."""
    both = rows if cols is None else rows + cols
    m = len(rows)
    owner = np.repeat(np.arange(len(both)), [len(t) for t in both])
    _, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.cumsum(counts >= 2) - 1
    keep = counts[inverse] >= 2
    at, owner = number[inverse[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((m, m if cols is None else len(cols)))
    columns = int(at[-1]) + 1 if len(at) else 0
    width = min(columns, max(64, (1 << 21) // max(1, len(both))))
    for start in range(0, columns, width or 1):
        a, b = np.searchsorted(at, (start, start + width))
        hit = np.zeros((len(both), width), np.float32)
        hit[owner[a:b], at[a:b] - start] = 1
        out += hit[:m] @ (hit if cols is None else hit[m:]).T
    return out


def similar(rows: list[np.ndarray], cols: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each row set and each column set reach the threshold."""
    a = np.array([len(t) for t in rows], float)
    b = a if cols is None else np.array([len(t) for t in cols], float)
    return overlaps(rows, cols) * (1 + threshold) >= threshold * (a[:, None] + b[None, :]) - 1e-6


def _forest(mine: list[tuple], other: list[tuple] | None, hit: np.ndarray) -> list[tuple]:
    """Pairs that hit, over members (rep, comp, ...), as (component, least component joined with
    it); components are named by one of their reps."""
    right = mine if other is None else other
    code: dict = {}
    a, b = (np.array([code.setdefault(x[1], len(code)) for x in side], np.int64) for side in (mine, right))
    names, parent = list(code), list(range(len(code)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = len(code) - 1
    for i in range(len(mine)):
        if not left:
            break
        for j in np.unique(b[hit[i] & (b != a[i])]):
            x, y = root(a[i]), root(j)
            if x != y:
                parent[x if names[x] > names[y] else y] = y if names[x] > names[y] else x
                left -= 1
    return [(names[x], names[root(x)]) for x in range(len(names)) if root(x) != x]


def _grouped(rows: DataFrame, work, names: list[str]) -> DataFrame:
    """work(members, other members or None) for each (node, b1, b2) of the rows (node, b1, b2,
    mine, rep, comp, ...): its result rows, the first ones reps, the last a number if it is
    named links."""
    spark_kind = rows.schema["rep"].dataType.simpleString()
    kinds = ["long" if n == "links" else spark_kind for n in names]
    columns = rows.columns

    def finish(group: list[tuple]) -> list[tuple]:
        (_, b1, b2) = group[0][0]
        mine = [x[2:] for x in group if x[1] == b1]
        if b1 == b2:
            return work(mine, None) if len(mine) > 1 else []
        other = [x[2:] for x in group if x[1] == b2]
        return work(mine, other) if mine and other else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        group: list[tuple] = []
        out: list[tuple] = []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            arrays = list(zip(*found)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types)], names=names)

        for batch in batches:
            types = [pa.int64() if n == "links" else batch.schema.field("rep").type for n in names]
            for node, b1, b2, *row in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                key = (node, b1, b2)
                if group and group[0][0] != key:
                    out += finish(group)
                    group = []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                group.append((key, *row))
        if group:
            out += finish(group)
        if types:
            yield batch_of(out)

    dealt = rows.repartition("node", "b1", "b2").sortWithinPartitions("node", "b1", "b2")
    return dealt.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def compare(groups: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """groups: (node, b1, b2, mine, rep, comp, weight). Compares the token sets of each (node,
    b1, b2): rows (src, dst, null) for links that join sets (a spanning forest), and (src, null,
    links) with the weight of a set's partners."""

    def work(mine: list[tuple], other: list[tuple] | None) -> list[tuple]:
        held = lambda side: [np.frombuffer(x[3], np.uint64) for x in side]
        hit = similar(held(mine), None if other is None else held(other), threshold)
        weight = lambda side: np.array([x[2] for x in side], float)
        if other is None:
            np.fill_diagonal(hit, False)
        own = (hit @ weight(mine if other is None else other)).astype(np.int64).tolist()
        out = [(x[0], None, n) for x, n in zip(mine, own) if n]
        if other is not None:
            back = (hit.T @ weight(mine)).astype(np.int64).tolist()
            out += [(x[0], None, n) for x, n in zip(other, back) if n]
        alone = lambda side: [(x[0], x[0]) for x in side]
        return out + [(a, b, None) for a, b in _forest(alone(mine), None if other is None else alone(other), hit)]

    met = groups.join(tokens, "rep").select("node", "b1", "b2", "mine", "rep", "comp", "weight", "tokens")
    return _grouped(met, work, ["src", "dst", "links"])


def _in_blocks(rows: DataFrame, limit: int, pairs: bool) -> DataFrame:
    """Deals the members of a node (with its size) to blocks by a hash; pairs: every block also
    meets every other block, else each only itself."""
    blocks = F.greatest(F.ceil(F.col("size") / limit).cast("long"), F.lit(1).cast("long"))
    dealt = rows.withColumn("mine", F.pmod(F.xxhash64("rep", "node"), blocks))
    if not pairs:
        return dealt.withColumns({"b1": F.col("mine"), "b2": F.col("mine")})
    met = dealt.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.withColumns({"b1": F.least("mine", "k"), "b2": F.greatest("mine", "k")})


def _named(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Adds comp, the component of the rep, which is the rep itself while it has no link."""
    comps = comps.select(F.col("node").alias("node_"), "component")
    met = rows.join(comps, rows["rep"] == comps["node_"], "left")
    return met.select(*rows.columns, F.coalesce("component", "rep").alias("comp"))


def _numbered(docs: DataFrame, threshold: float, recall: float, size: int) -> DataFrame:
    """join() for documents that repeat ids: every row gets a number of its own, and classes that
    share a doc_id are united."""
    rows = cut(docs.where("doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = cut(join(rows.select(F.col("row").alias("doc_id"), "text"), threshold, recall, size).withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row"))
    least = cut(found.groupBy("doc_id").agg(F.min("class_id").alias("src"), F.max("class_id").alias("last")).where("src < last").select("doc_id", "src"))
    united = connected_components(found.join(least, "doc_id").select("src", F.col("class_id").alias("dst")))
    named = cut(found.join(united.select(F.col("node").alias("class_id"), "component"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id")))
    ids = cut(named.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    out = named.drop("class_id").join(ids, "component").select("doc_id", "class_id", "n_links", "n_shingles")
    alone = sets(docs.where("doc_id IS NULL"), size).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    return out.unionByName(alone)


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, size: int = WORDS) -> DataFrame:
    """doc_id, class_id, n_links and n_shingles for every row of docs (doc_id, text)."""
    told = cut(sets(docs, size))
    if not told.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _numbered(docs, threshold, recall, size)
    keyed = told.where("doc_id IS NOT NULL AND key IS NOT NULL")
    reps = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("picks").alias("picks"), F.first("sketch").alias("sketch")))
    release(docs.sparkSession)
    family = families(reps.select("rep", "picks", "sketch"), Runs(threshold, recall))
    release(docs.sparkSession)

    members = cut(reps.select("rep", "weight", "n").join(family, "rep").withColumn("node", F.xxhash64("comp")))
    tokens = token_sets(docs, members.select("rep").distinct(), size)
    sizes = members.groupBy("node").agg(F.sum(F.expr(f"1 + n div {TOKENS}")).alias("size"))
    dealt = _in_blocks(members.join(sizes, "node"), BLOCK, True)
    found = cut(compare(dealt.select("node", "b1", "b2", "mine", "rep", "comp", "weight"), tokens, threshold))
    partners = found.where("dst IS NULL").groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    linked = connected_components(found.where("dst IS NOT NULL")).select(F.col("node").alias("rep"), F.col("component").alias("comp"))

    classes = reps.select("key", "rep", "weight").join(linked, "rep", "left").join(partners, "rep", "left")
    classes = classes.select("key", F.coalesce("comp", "rep").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = told.where("doc_id IS NULL OR key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    joined = keyed.select("doc_id", "key", F.col("n").alias("n_shingles")).join(classes, "key")
    return joined.select("doc_id", "class_id", "n_links", "n_shingles").unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
