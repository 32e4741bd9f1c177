"""Similar texts: classes of equal shingle sets, pairs of similar classes, and each text's first
partner. Rows grow with the texts and with the pairs of different sets; copies are never paired.

Texts come as (group, key, shingles), strings or hashes of them: pairs stay within a group, keys are whole numbers, unique in
their group. A class is named by its smallest key."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text
from siteloom.plans.lineage import cut, release

c = F.col
#: Keys of one block; what is sorted in one task at a time.
BLOCK = 4096
#: Sets up to which a shingle in their prefixes is joined at once.
FEW = 32
#: Buckets of shingles' hashes at most, and shingles for each of fewer.
SLOTS, A_SLOT = 1 << 20, 128
#: Shingles that a worker puts in order at a time.
ORDERED = 1 << 20
#: Sets of either side that are compared in one cell.
TOGETHER = 256
#: Buckets of ids, of which a broadcast has as many rows at most.
BUCKETS = 1 << 20


@dataclass(frozen=True)
class Similar:
    """members: (group, key, set); pairs: (group, a, b, similarity) of classes a < b, both by
    their smallest keys; group and key are the names of those columns."""

    members: DataFrame
    pairs: DataFrame
    group: str
    key: str


def similar(docs: DataFrame, threshold: float, group: str = "scan_id", key: str = "seq") -> Similar:
    """All pairs of different sets of a group that reach the threshold, and the class of each
    text. Texts without shingles are in no class. Exact, by prefix filtering: two such sets share
    one of the first n - ceil(threshold * n) + 1 of their shingles in any order, so only these are
    dealt out, those of the least full buckets of hashes. One that at most FEW sets of a group have
    there is joined at once; sets with one of more are joined among themselves in order of rarity.
    Whole sets are fetched for pairs only that may be similar by what they share in their prefixes."""
    # Behind a generator, as a condition on plain expressions would make them once more.
    hashed = docs.select(group, key, F.explode(F.array(F.sort_array(F.transform("shingles", lambda s: F.xxhash64(s))))).alias("s")).where("size(s) > 0")
    marked = cut(hashed.withColumns({"k": F.xxhash64("s"), "k2": F.xxhash64(F.lit(1), "s")}))  # texts are taken apart once
    named = marked.groupBy(group, "k", "k2").agg(F.min(key).alias("set"))
    members = cut(marked.drop("s").join(named, [group, "k", "k2"]).select(group, key, "set"))
    sets, first = marked.select(group, c(key).alias("set"), "s"), members.where(c(key) == c("set")).select(group, "set")
    begun = _begun(sets, threshold).join(first.hint("shuffle_hash"), [group, "set"], "left_semi")
    dealt = begun.select(group, "set", "n", F.posexplode("s").alias("at", "t")).withColumn("at", c("at") + 1)
    shared = cut(dealt.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(group, "t"))).where("held > 1"))
    release(docs.sparkSession)  # what was dealt out
    often = cut(shared.where(c("held") > FEW).select(group, "set").distinct())
    told = shared.where(c("held") <= FEW).drop("held").join(often.withColumn("often", F.lit(True)), [group, "set"], "left")
    # Two sets that share an often held one are both among those, and so are left to the second join.
    able = _meeting(told.withColumn("often", F.coalesce("often", F.lit(False))), threshold, group)
    if not often.isEmpty():
        held = cut(_bucketed(sets, often, group).join(often.hint("shuffle_hash"), [group, "set"], "left_semi"))
        able = able.unionByName(_meeting(_rarest(held, threshold, group).withColumn("often", F.lit(False)), threshold, group))
    able = cut(able)
    pairs = cut(_compared(able, sets, group).where(c("similarity") >= threshold))
    return Similar(members, pairs, group, key)


def _prefix(n: Column, threshold: float) -> Column:
    """The number of first shingles of which two similar sets share one."""
    return (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")


def _begun(sets: DataFrame, threshold: float) -> DataFrame:
    """(.., n, s): sets (.., s) cut to their prefix in the order of how many shingles are in a
    shingle's bucket, which tells frequent ones from others without dealing all of them out."""
    total = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    slots = min(SLOTS, 1 << max(10, (total // A_SLOT).bit_length()))
    tasks = sets.coalesce(sets.sparkSession.sparkContext.defaultParallelism)  # each has a row for each slot
    told = tasks.select(F.explode("s").alias("t")).groupBy(F.col("t").bitwiseAND(slots - 1).alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    full = np.zeros(slots, np.int64)
    full[told["slot"].to_numpy()] = told["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = shared.value
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole["s"]).to_numpy())
            # As many rows at a time as have ORDERED shingles, or one.
            cuts = [0, *(np.flatnonzero(np.diff(ends // ORDERED)) + 1).tolist(), len(ends)]
            for lo, hi in zip(cuts, cuts[1:]):
                batch = whole.slice(lo, hi - lo)
                n, most = pc.list_value_length(batch["s"]).to_numpy(), batch["length"].to_numpy()
                t, row = batch["s"].flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                order = np.lexsort((t, full[t & (len(full) - 1)], row))
                kept = order[np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(most, n)]
                begun = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32)), pa.array(t[kept]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n.astype(np.int32)), begun], names=[*batch.schema.names[:-2], "n", "s"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sets.schema if f.name != "s")
    return sets.select(*(x for x in sets.columns if x != "s"), _prefix(F.size("s"), threshold).alias("length"), "s").mapInArrow(run, f"{rest}, n int, s array<long>")


def _bucketed(sets: DataFrame, ids: DataFrame, group: str) -> DataFrame:
    """The sets (group, set, s) of ids (group, set), and few others: what is broadcast is of a fixed
    size, so that sets which aren't asked for are never shuffled."""
    bucket = F.pmod(F.xxhash64(group, "set"), F.lit(BUCKETS)).alias("bucket")
    return sets.select("*", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def _rarest(sets: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, set, n, at, t): the prefix of each set (group, set, s) in order of rarity."""
    tokens = sets.select(group, "set", F.explode("s").alias("t"))
    rare = tokens.groupBy(group, "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(rare, [group, "t"]).groupBy(group, "set").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    # Shingles of one set only come first in the order and join nothing, so they only use up the prefix.
    sized = ranked.join(sets.select(group, "set", F.size("s").alias("n")), [group, "set"]).withColumn("alone", c("n") - F.size("r"))
    length = _prefix(c("n"), threshold) - c("alone")
    placed = sized.where(length > 0).select(group, "set", "n", "alone", F.posexplode(F.transform(F.slice("r", 1, length), lambda x: x["t"])).alias("at", "t"))
    return cut(placed.select(group, "set", "n", (c("alone") + c("at") + 1).alias("at"), "t"))


def _meeting(prefix: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, a, b): the sets that share some of prefix (group, set, n, at, t, often), at being the
    place in a set's order, and that may be similar by how many and where; not two that are often."""
    side = lambda x: prefix.select(group, "t", c("set").alias(x), c("n").alias(f"n_{x}"), c("at").alias(f"at_{x}"), c("often").alias(f"often_{x}"))
    met = side("a").join(side("b"), [group, "t"]).where("a < b AND NOT (often_a AND often_b)").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)
    held = met.groupBy(group, "a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n"), F.max("at_a").alias("last_a"), F.max("at_b").alias("last_b"))
    most = c("n") + F.least(c("n_a") - c("last_a"), c("n_b") - c("last_b"))  # behind the last one they share in both prefixes
    return held.where(most >= (c("n_a") + c("n_b")) * (threshold / (1 + threshold)) - 1e-9).select(group, "a", "b")


def _compared(able: DataFrame, sets: DataFrame, group: str) -> DataFrame:
    """(group, a, b, similarity) of the pairs able, by their whole sets (group, set, s). Pairs meet in a
    cell of their family, named by a's first neighbour: about TOGETHER sets of either side at most. A
    set goes once to each cell that it is in, not once to each pair."""
    ends = able.select(group, c("a").alias("set"), c("b").alias("other")).unionByName(able.select(group, c("b").alias("set"), c("a").alias("other")))
    family = ends.groupBy(group, "set").agg(F.least("set", F.min("other")).alias("family"))
    dealt = able.join(family.withColumnRenamed("set", "a"), [group, "a"])
    sizes = dealt.groupBy(group, "family").agg(F.count_distinct("a").alias("n_a"), F.count_distinct("b").alias("n_b"))
    part = lambda x: F.pmod(F.xxhash64(x), F.ceil(c(f"n_{x}") / TOGETHER))
    pairs = cut(dealt.join(sizes, [group, "family"]).select(group, F.xxhash64("family", part("a"), part("b")).alias("cell"), "a", "b"))
    needed = pairs.select(group, "cell", c("a").alias("set")).unionByName(pairs.select(group, "cell", c("b").alias("set"))).distinct()
    held = needed.join(_bucketed(sets, needed, group), [group, "set"]).select(group, "cell", c("set").alias("a"), F.lit(None).cast(able.schema["b"].dataType).alias("b"), "s")
    rows = held.unionByName(pairs.withColumn("s", F.lit(None).cast("array<bigint>"))).repartition(group, "cell").sortWithinPartitions(group, "cell", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole = None, {}
        for batch in batches:
            at, found = [], []
            s = batch["s"]
            for i, (g, cell, x, y) in enumerate(zip(*(batch[k].to_pylist() for k in (group, "cell", "a", "b")))):
                if now != (g, cell):
                    now, whole = (g, cell), {}
                if y is None:
                    whole[x] = np.unique(s[i].values.to_numpy())
                else:
                    common = len(np.intersect1d(whole[x], whole[y], assume_unique=True))
                    at.append(i)
                    found.append(common / (len(whole[x]) + len(whole[y]) - common))
            told = batch.select([group, "a", "b"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*told.columns, pa.array(found, pa.float64())], names=[group, "a", "b", "similarity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in able.schema)
    return rows.mapInArrow(run, f"{kinds}, similarity double")


def expanded(found: Similar) -> DataFrame:
    """(group, a, b, similarity) for all pairs a < b of texts, copies among them: as many rows as
    pairs, which grow with the square of a class."""
    group, key, members = found.group, found.key, found.members
    of = lambda s, name: members.select(group, c("set").alias(s), c(key).alias(name))
    other = found.pairs.select(group, c("a").alias("sa"), c("b").alias("sb"), "similarity").join(of("sa", "x"), [group, "sa"]).join(of("sb", "y"), [group, "sb"])
    other = other.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    copies = of("set", "a").join(of("set", "b"), [group, "set"]).where("a < b").select(group, "a", "b", F.lit(1.0).alias("similarity"))
    return other.unionByName(copies)


def linked(found: Similar) -> DataFrame:
    """(group, key, set, copies, links): for each text its class, the other texts of its class,
    and the texts of other classes that are similar to it."""
    group, key = found.group, found.key
    sizes = found.members.groupBy(group, "set").agg(F.count(F.lit(1)).alias("n"))
    both = found.pairs.select(group, c("a").alias("set"), c("b").alias("other")).unionByName(found.pairs.select(group, c("b").alias("set"), c("a").alias("other")))
    near = both.join(sizes.select(group, c("set").alias("other"), "n"), [group, "other"]).groupBy(group, "set").agg(F.sum("n").alias("links"))
    told = sizes.join(near, [group, "set"], "left").select(group, "set", (c("n") - 1).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return found.members.join(told, [group, "set"]).select(group, key, "set", "copies", "links")


def first_partners(found: Similar, base: DataFrame, same: float) -> DataFrame:
    """(group, key, same, partner, similarity): for each text the first text after it, by key, of
    another base address that is similar to it: one of similarity same or more, and one of less.
    base: (group, key, base)."""
    group, key = found.group, found.key
    near = found.pairs.withColumn("same", c("similarity") >= same)
    turned = near.select(group, c("b").alias("a"), c("a").alias("b"), "similarity", "same")
    own = found.members.groupBy(group, c("set").alias("a")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(group, "a", c("a").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same"))
    links = cut(near.unionByName(turned).unionByName(own))
    held = found.members.join(base, [group, key]).select(group, "set", c(key).alias("at"), "base")
    asked = held.join(links.select(group, c("a").alias("set"), "same").distinct(), [group, "set"])
    targets = links.select(group, c("a").alias("of"), c("b").alias("set"), "same").join(held, [group, "set"]).select(group, c("of").alias("set"), "same", "at", "base")
    met = next_of_another(asked, targets, [group, "set", "same"])
    of = found.members.select(group, c(key).alias("partner"), c("set").alias("b"))
    told = met.join(of, [group, "partner"]).join(links.select(group, c("a").alias("set"), "b", "similarity"), [group, "set", "b"])
    return told.select(group, c("at").alias(key), "same", "partner", "similarity")


def next_of_another(asked: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, partner): for each asked row (keys, at, base) the first target (keys, at, base)
    behind it, by at, whose base is another.

    If the next target has the same base, the answer is where the run of that base ends: the next
    target whose base isn't that of the target before it. Keys are sorted in blocks of BLOCK
    numbers, so a key with most rows is many tasks' work; a block's first and last targets tell
    the other blocks what they need."""
    block = F.floor(c("at") / BLOCK).alias("block")
    targets = cut(targets.select(*keys, block, "at", "base"))
    ahead, inside = Window.partitionBy(*keys).orderBy("block"), Window.partitionBy(*keys, "block").orderBy("at")
    lasts = targets.groupBy(*keys, "block").agg(F.max_by("base", "at").alias("last"))
    before = lasts.select(*keys, "block", F.lag("last").over(ahead).alias("before"))
    seen = F.coalesce(F.lag("base").over(inside), c("before"))
    placed = targets.join(before, [*keys, "block"]).withColumns({"starts": seen.isNull() | (seen != c("base")), "nth": F.row_number().over(inside)})
    start = F.when(c("starts"), c("at"))
    told = placed.groupBy(*keys, "block").agg(F.min(F.struct("at", "base")).alias("first"), F.min(start).alias("run"), F.min(F.when(c("nth") > 1, start)).alias("other_run"))
    rows = asked.select(*keys, block, "at", "base", F.lit(False).alias("target"), F.lit(False).alias("starts"))
    rows = rows.unionByName(placed.select(*keys, "block", "at", "base", F.lit(True).alias("target"), "starts"))
    # Blocks with asked rows only need what lies behind them as well.
    later = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.select(*keys, "block").distinct().join(told, [*keys, "block"], "left").withColumn("next_run", F.last("run", True).over(later))
    first = F.when(c("first").isNotNull(), F.struct(c("first.at").alias("at"), c("first.base").alias("base"), F.coalesce("other_run", "next_run").alias("end")))
    behind = blocks.withColumn("whole", first).select(*keys, "block", "next_run", F.last("whole", True).over(later).alias("next_first"))
    # From the last row to the first; an asked row comes before a target at its own place, so it doesn't see it.
    back = Window.partitionBy(*keys, "block").orderBy(F.desc("at"), F.asc("target")).rowsBetween(Window.unboundedPreceding, -1)
    ended = rows.join(behind, [*keys, "block"]).withColumn("end", F.coalesce(F.last(start, True).over(back), c("next_run")))
    found = ended.withColumn("next", F.coalesce(F.last(F.when(c("target"), F.struct("at", "base", "end")), True).over(back), c("next_first")))
    answer: Column = F.when(c("next.base") != c("base"), c("next.at")).otherwise(c("next.end"))
    return found.where("NOT target").select(*keys, "at", answer.alias("partner")).where("partner IS NOT NULL")
