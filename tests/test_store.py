"""Batches and keyed updates that are repeated, broken off or written at once."""

import random

import pytest

from siteloom.sources.store import Store

SCHEMA = "k long, at long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def newest(rows):
    out = {}
    for k, at, v in rows:
        out[k] = max(out.get(k, (at, v or "")), (at, v or ""))
    return {k: x for k, x in out.items()}


def told(store):
    return {r["k"]: (r["at"], r["v"] or "") for r in store.state().collect()}


def test_merges_repeated_and_broken_off(spark, tmp_path, monkeypatch):
    random.seed(1)
    store = Store(spark, f"{tmp_path}/t")
    every = []
    for n in range(4):
        rows = [(random.choice([None, *range(30)]), random.randrange(8), random.choice("abc")) for _ in range(40)]
        if n == 2:  # the data is written, the commit isn't
            with monkeypatch.context() as broken:
                broken.setattr(Store, "_commit", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    store.merge(frame(spark, rows), ["k"], "at", f"b{n}", 4)
            assert told(store) == newest(every)
        assert store.merge(frame(spark, rows), ["k"], "at", f"b{n}", 4)
        assert not store.merge(frame(spark, rows[:3]), ["k"], "at", f"b{n}", 4)
        every += rows
        assert told(store) == newest(every) and store.state().count() == len(newest(every))
    store.compact()
    assert told(store) == newest(every) and len(store._names("data")) == 1
    assert store.merge(frame(spark, [(5, 99, "z")]), ["k"], "at", "late", 4) and told(store)[5] == (99, "z")
    assert not store.merge(frame(spark, [(6, 99, "z")]), ["k"], "at", "b0", 4)


def test_a_merge_writes_its_buckets_only(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t")
    store.merge(frame(spark, [(k, 0, "a") for k in range(200)]), ["k"], "at", "all", 16)
    before = store.commits()[-1]["where"]
    store.merge(frame(spark, [(7, 1, "b")]), ["k"], "at", "one", 16)
    after = store.commits()[-1]["where"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1


def test_two_writers_collide(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t")
    store.merge(frame(spark, [(1, 0, "a")]), ["k"], "at", "a")
    last = store.commits()[-1]
    with pytest.raises(Exception, match="exist"):
        store._commit(0, {k: v for k, v in last.items() if k != "version"})
    # A commit that broke off half-way is none, and its place is taken again.
    out = store.fs.create(store._at("commits/000000000001.json"), False)
    out.write(bytearray(b'{"version": 1, "ba'))
    out.close()
    assert len(store.commits()) == 1 and store.merge(frame(spark, [(2, 0, "b")]), ["k"], "at", "b") and set(told(store)) == {1, 2}


def test_batches_count_once(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/t")
    assert store.insert(frame(spark, [(1, 0, "a"), (1, 0, "a")]), "x") and not store.insert(frame(spark, [(9, 9, "z")]), "x")
    frame(spark, [(2, 0, "b")]).write.parquet(f"{tmp_path}/t/data/uncommitted")
    assert sorted(r["k"] for r in store.rows().collect()) == [1, 1]


def test_a_stream_that_repeats_its_batch(spark, tmp_path):
    """A new run from an older checkpoint hands over batch 0 again; its rows are there already."""
    frame(spark, [(k, 0, "a") for k in range(50)]).write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/t")
    for run in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        store.insert_stream(stream, f"{tmp_path}/check{run}").trigger(availableNow=True).start().awaitTermination()
        assert store.rows().count() == 50
    assert len(store.commits()) == 1
