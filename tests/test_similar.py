"""Similar texts against brute force: classes, pairs, links and first partners."""

import random

import pytest
from pyspark.sql import functions as F

from siteloom.operators import similar

SCHEMA = "scan_id string, seq long, base string, shingles array<string>"


def frame(spark, data):
    return spark.createDataFrame([(g, i, b, list(s)) for g, i, b, s in data], SCHEMA)


def near(a, b, threshold):
    return bool(a and b) and len(a & b) >= threshold * len(a | b)


def some(n, seed, kinds=14, most=9):
    """Small sets of few kinds, so that copies and near copies abound; numbers with gaps."""
    random.seed(seed)
    sets = [frozenset(f"t{random.randrange(kinds)}" for _ in range(random.randrange(most))) for _ in range(n // 3)]
    at = sorted(random.sample(range(-20, n * 4), n))
    return [(f"g{i % 2}", at[i], f"b{random.randrange(3)}", random.choice(sets)) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_similar_against_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    data = some(90, seed=block + int(threshold * 10))
    docs = frame(spark, data)
    found = similar.similar(docs, threshold)
    held = [(g, i, b, s) for g, i, b, s in data if s]
    named = {}
    for g, i, _, s in held:
        named[g, s] = min(i, named.get((g, s), i))
    assert {(r["scan_id"], r["seq"], r["set"]) for r in found.members.collect()} == {(g, i, named[g, s]) for g, i, _, s in held}
    pairs = [(g, i, j, a, b) for g, i, _, a in held for h, j, _, b in held if g == h and i < j and near(a, b, threshold)]
    want = {(g, *sorted((named[g, a], named[g, b])), round(len(a & b) / len(a | b), 9)) for g, i, j, a, b in pairs if a != b}
    assert sorted((r["scan_id"], r["a"], r["b"], round(r["similarity"], 9)) for r in found.pairs.collect()) == sorted(want)
    assert {(r["scan_id"], r["a"], r["b"]) for r in similar.expanded(found).collect()} == {p[:3] for p in pairs}
    told = {(r["scan_id"], r["seq"]): (r["copies"], r["links"]) for r in similar.linked(found).collect()}
    for g, i, _, a in held:
        other = [b for h, j, _, b in held if g == h and i != j and near(a, b, threshold)]
        assert told[g, i] == (sum(b == a for b in other), sum(b != a for b in other))
    same = (1 + threshold) / 2
    got = {(r["scan_id"], r["seq"], r["same"]): (r["partner"], round(r["similarity"], 9)) for r in similar.first_partners(found, docs.select("scan_id", "seq", "base"), same).collect()}
    first = {}
    for g, i, x, a in sorted(held, key=lambda h: h[1]):
        for h, j, y, b in sorted(held, key=lambda h: h[1]):
            if g == h and i < j and x != y and near(a, b, threshold):
                first.setdefault((g, i, near(a, b, same)), (j, round(len(a & b) / len(a | b), 9)))
    assert got == first and len(first) > 20


def test_many_copies(spark, monkeypatch):
    """10,000 copies in one group: rows in proportion, no task with all of them."""
    monkeypatch.setattr(similar, "BLOCK", 512)
    docs = spark.range(10_000).select(F.lit("g").alias("scan_id"), F.col("id").alias("seq"), (F.col("id") % 2).cast("string").alias("base"), F.array(*(F.lit(f"w{k}") for k in range(20))).alias("shingles"))
    docs = docs.withColumn("shingles", F.when(F.col("seq") % 100 == 99, F.concat("shingles", F.array(F.concat(F.lit("x"), F.col("seq").cast("string"))))).otherwise(F.col("shingles")))
    found = similar.similar(docs, 0.7)
    assert found.members.count() == 10_000
    # 100 sets of their own and that of all others: pairs of sets, not of texts.
    assert found.pairs.count() == 100 * 99 // 2 + 100
    partners = similar.first_partners(found, docs.select("scan_id", "seq", "base"), 0.9).collect()
    assert len(partners) == 9_999 and all(r["partner"] == r["seq"] + 1 and r["same"] for r in partners)
    assert similar.linked(found).agg(F.sum(F.col("copies") + F.col("links"))).first()[0] == 10_000 * 9_999


def test_nothing_is_similar(spark):
    found = similar.similar(frame(spark, [("g", 1, "b", []), ("g", 2, "b", [])]), 0.7)
    assert not found.members.count() and not found.pairs.count() and not similar.linked(found).count()
    assert not similar.first_partners(found, spark.createDataFrame([], "scan_id string, seq long, base string"), 0.9).count()


@pytest.mark.parametrize("few, slots, ordered", [(1, 1, 1), (2, 4, 40), (5, 1024, 1 << 20)])
@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_pairs_however_often_a_shingle_is_held(spark, monkeypatch, threshold, few, slots, ordered):
    """All pairs, once, whether sets are joined at once, by rarity or one so and one so."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "SLOTS", slots)
    monkeypatch.setattr(similar, "ORDERED", ordered)
    monkeypatch.setattr(similar, "BUCKETS", 16)
    monkeypatch.setattr(similar, "TOGETHER", few)
    data = some(80, seed=few, kinds=14, most=9) + [("g0", 1000 + i, "b", frozenset(f"{i // 3}.{k}" for k in range(i % 3, 12))) for i in range(30)]
    found = similar.similar(frame(spark, data), threshold)
    firsts = {}
    for g, i, _, s in data:
        if s:
            firsts[g, s] = min(i, firsts.get((g, s), i))
    sets = [(g, i, s) for (g, s), i in firsts.items()]
    want = [(g, i, j, round(len(a & b) / len(a | b), 9)) for g, i, a in sets for h, j, b in sets if g == h and i < j and near(a, b, threshold)]
    assert sorted((r["scan_id"], r["a"], r["b"], round(r["similarity"], 9)) for r in found.pairs.collect()) == sorted(want) and len(want) > 20


def stages(spark):
    """Bytes written to shuffles by each stage."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    told = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList()))
    return {s.stageId(): s.shuffleWriteBytes() for s in told}


def test_a_family_is_compared_without_a_copy_of_a_set_for_each_pair(spark):
    """120 near copies: 7140 pairs, of which each had a whole set of 3.2 KB; it now goes to its family's cell."""
    docs = spark.range(120).select(F.lit("g").alias("scan_id"), F.col("id").alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.xxhash64(F.when(k > 390, F.col("id")).otherwise(-1), k)).alias("shingles"))
    before = stages(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for larger tables
    try:
        found = similar.similar(docs, 0.7)
        assert found.pairs.count() == 120 * 119 // 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert max(size for k, size in stages(spark).items() if k not in before) < 2 * 120 * 400 * 8


def test_whole_sets_are_not_shuffled(spark):
    """Of texts without a pair only prefixes are dealt out, once: 3 MB were, where the sets have 0.64."""
    docs = spark.range(400).select(F.lit("g").alias("scan_id"), F.col("id").alias("seq"), F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.xxhash64("id", k)).alias("shingles"))
    before = stages(spark)
    found = similar.similar(docs, 0.7)
    assert found.members.count() == 400 and not found.pairs.count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    written = sum(size for k, size in stages(spark).items() if k not in before)
    assert 0 < written < 400 * 200 * 8 * 1.5
