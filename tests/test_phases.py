"""Phases under a deadline."""

import time

import pytest
from pyspark.sql import functions as F

from siteloom.plans import phases


def slow(spark):
    """Far more seconds of work than any budget here."""
    nap = F.udf(lambda x: time.sleep(0.5) or x, "long")
    return spark.range(0, 4000, 1, 8).select(nap("id").alias("id"))


def test_a_slow_phase_is_cut_and_named(spark, tmp_path):
    began = time.time()
    made = {"first": lambda: spark.range(10), "slow": lambda: slow(spark), "last": lambda: spark.range(3)}
    told = phases.run(spark, made, f"{tmp_path}/run", budget=12, reserve=1).orderBy("place").collect()
    assert time.time() - began < 60
    assert [(r["phase"], r["outcome"], r["rows"]) for r in told] == [("first", "finished", 10), ("slow", "cut", None), ("last", "skipped", None)]
    assert [r["done"] for r in told] == sorted(r["done"] for r in told) and told[-1]["done"] == 1
    assert phases.result(spark, f"{tmp_path}/run", "first").count() == 10
    assert {r["phase"] for r in phases.completed(spark, f"{tmp_path}/run").where("NOT completed").collect()} == {"slow", "last"}
    assert spark.range(5).count() == 5  # jobs that follow carry no tag


def test_progress_is_there_while_phases_run(spark, tmp_path):
    seen = []

    def look():
        seen.append(phases.progress(spark, f"{tmp_path}/run").count())
        return spark.range(1)

    phases.run(spark, {"a": lambda: spark.range(2), "b": look, "c": look}, f"{tmp_path}/run")
    assert seen == [1, 2]


def test_an_error_isnt_taken_for_a_deadline(spark, tmp_path):
    with pytest.raises(ZeroDivisionError):
        phases.run(spark, {"a": lambda: spark.range(2), "b": lambda: 1 / 0}, f"{tmp_path}/run")
    assert phases.progress(spark, f"{tmp_path}/run").count() == 1 and phases.result(spark, f"{tmp_path}/run", "a").count() == 2


def test_only_tables_of_a_bounded_size_are_dealt_out(spark, tmp_path, monkeypatch):
    from siteloom.plans import lineage

    path = f"{tmp_path}/a b"  # a folder's name may hold a space
    spark.range(1000).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    assert lineage.spread(stored).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(lineage, "SPREAD_BYTES", 10)
    assert lineage.spread(stored) is stored
