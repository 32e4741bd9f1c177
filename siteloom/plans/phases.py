"""Phases of an audit under a deadline: each writes its own result, what is finished stays, and a
phase that would pass the deadline is cut off and named.

The jobs of a phase carry a tag; when the time is up, all jobs with the tag are cancelled. After each
phase a line of progress is written, with the rows of the phase, counted as they were written."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PROGRESS = "place int, phase string, outcome string, rows long, seconds double, done double"
#: Seconds of an audit, and those before its end at which no phase is begun.
BUDGET, RESERVE = 540.0, 30.0

Phase = Callable[[], DataFrame]


def run(spark: SparkSession, phases: dict[str, Phase], target: str, budget: float = BUDGET, reserve: float = RESERVE) -> DataFrame:
    """Run the phases in order and return the progress: finished, cut or skipped. A phase that fails
    by itself ends the run with its error; what was finished before stays."""
    end = time.monotonic() + budget
    for place, (name, make) in enumerate(phases.items(), 1):
        began = time.monotonic()
        outcome, rows = ("skipped", None) if end - began <= reserve else _one(spark, name, make, target, end - began)
        line = [(place, name, outcome, rows, time.monotonic() - began, place / len(phases))]
        spark.createDataFrame(line, PROGRESS).coalesce(1).write.mode("append").json(f"{target}/progress")
    return progress(spark, target)


def _one(spark: SparkSession, name: str, make: Phase, target: str, seconds: float) -> tuple[str, int | None]:
    context, tag, late = spark.sparkContext, f"phase-{uuid.uuid4().hex}", threading.Event()
    finished = threading.Event()

    def stop() -> None:
        late.set()
        while not finished.is_set():  # a phase may begin another job after one was cancelled
            context.cancelJobsWithTag(tag)
            finished.wait(0.2)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    seen = Observation()
    context.addJobTag(tag)
    timer.start()
    try:
        rows = make().observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{target}/results/{name}")
        return "finished", seen.get["n"]
    except Exception:
        if not late.is_set():
            raise
        return "cut", None
    finally:
        finished.set()
        timer.cancel()
        context.removeJobTag(tag)


def progress(spark: SparkSession, target: str) -> DataFrame:
    """The lines so far, in order; done is the share of phases that are over."""
    return spark.read.schema(PROGRESS).json(f"{target}/progress")


def result(spark: SparkSession, target: str, name: str) -> DataFrame:
    """What a finished phase has written."""
    return spark.read.parquet(f"{target}/results/{name}")


def completed(spark: SparkSession, target: str) -> DataFrame:
    """(phase, completed): what the check for skipped phases takes."""
    return progress(spark, target).select("phase", (F.col("outcome") == "finished").alias("completed"))
