"""The stream of requests that are judged in the order of their times."""

import random

from siteloom.streaming import limiter

SCHEMA = "key string, request_id long, at_ms long"


def one_by_one(data, limit, window):
    state, out = {}, {}
    for key, ident, at in sorted(data, key=lambda x: (x[2], x[1])):
        allowed, left, reset, state[key] = limiter.decide(state.get(key, []), at, limit, window)
        out[key, ident] = (allowed, left, reset)
    return out


def told(spark, tmp_path, batches, limit, window, late):
    """Every batch by a run of its own, as after a restart."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        run = limiter.limit_ordered(stream, limit, window, late).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(limiter.OUT).parquet(f"{tmp_path}/out").collect()
    out = {(r["key"], r["request_id"]): (r["allowed"], r["remaining"], r["reset_ms"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_batches_out_of_order(spark, tmp_path):
    """One key has half of all requests; batches overlap by less than what may be late."""
    random.seed(3)
    data = [(random.choice(["hot", "hot", "a", "b"]), i, random.randrange(100_000)) for i in range(400)]
    place = {i: (at + random.randrange(9000)) // 25_000 for _, i, at in data}
    batches = [[r for r in data if place[r[1]] == k] for k in range(5)]
    for rows in batches:
        random.shuffle(rows)
    batches = [b for b in batches if b]
    assert len(batches) >= 4
    got = told(spark, tmp_path, batches, 3, 700, 10_000)
    end = max(at for _, _, at in data) - 10_000
    times = {(key, i): at for key, i, at in data}
    assert got == {k: v for k, v in one_by_one(data, 3, 700).items() if times[k] < end}
    assert any(not v[0] for v in got.values())


def test_late_requests_ties_and_idle_keys(spark, tmp_path):
    """late comes at the watermark and is left out; equal times are judged by number; idle's state
    has gone when its key comes again, and it starts afresh."""
    batches = [
        [("k", 3, 1000), ("k", 2, 1000), ("k", 1, 1000), ("idle", 10, 1000), ("z", 20, 5000)],
        [("late", 30, 4000), ("z", 21, 60_000)],
        [("idle", 11, 70_000), (None, 40, 70_000), ("z", 22, 90_000)],
    ]
    got = told(spark, tmp_path, batches, 2, 500, 1000)
    assert {k: v[0] for k, v in got.items()} == {("k", 1): True, ("k", 2): True, ("k", 3): False, ("idle", 10): True, ("z", 20): True, ("z", 21): True, ("idle", 11): True, (None, 40): True}
    assert got["idle", 11] == (True, 1, 500)
    held = spark.read.format("statestore").load(f"{tmp_path}/state").select("key.key").collect()
    assert {r["key"] for r in held} == {"z"}


def test_many_keys_share_few_states(spark, tmp_path):
    """Buckets of keys decide as states of single keys do, over batches out of order; a bucket holds
    only keys that still wait or count, and one that holds none has no state."""
    random.seed(5)
    data = [(random.choice(["hot", None, *map(str, range(60))]), i, random.randrange(100_000)) for i in range(1500)]
    place = {i: (at + random.randrange(9000)) // 25_000 for _, i, at in data}
    batches = [[r for r in data if place[r[1]] == k] for k in range(5)] + [[("z", 5000, 200_000)], [("z", 5001, 300_000)]]
    out, states = {}, []
    for rows in filter(None, batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = limiter.limit_ordered(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 3, 4000, 10_000, buckets=3).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        states.append(spark.read.format("statestore").load(f"{tmp_path}/state").count())
    for r in spark.read.schema(limiter.OUT).parquet(f"{tmp_path}/out").collect():
        assert (r["key"], r["request_id"]) not in out
        out[r["key"], r["request_id"]] = (r["allowed"], r["remaining"], r["reset_ms"])
    assert out == one_by_one(data + [("z", 5000, 200_000)], 3, 4000) and any(not v[0] for v in out.values())
    assert max(states) == 3 and states[-1] == 1


def test_the_query_hands_over_few_states(spark, tmp_path, monkeypatch):
    """rate_limit_ordered calls Python for buckets of its users, not for each of them."""
    from siteloom import catalog

    asked = []
    made = limiter.limit_ordered
    monkeypatch.setattr(limiter, "limit_ordered", lambda *args: asked.append(args[4]) or made(*args))
    spark.range(3000).selectExpr("id AS event_id", "timestamp_seconds(id * 600) AS ts", "id % 1500 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.rate_limit_ordered(spark, str(tmp_path)).count() > 2000
    assert len(set(asked)) == 1 and asked[0] <= 16
    held = spark.range(100_000).selectExpr("CAST(id AS string) AS key", "id AS request_id", "id AS at_ms")
    assert 300 < limiter.buckets_for(held) < 500
