"""Keyset pages from a laid-out table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siteloom.sources import keyset

ORDER = ["created_at", "run_id"]
START = datetime(2024, 1, 1)


def rows(spark, n):
    data = [(i, None if i % 50 == 7 else START + timedelta(minutes=i * 37 % 300), f"v{i}") for i in range(n)]
    return spark.createDataFrame(data, "run_id long, created_at timestamp, v string").repartition(3)


def walk(spark, path, frame, limit):
    seen, cursor, files = [], None, []
    while True:
        got = keyset.page(spark, path, frame.schema, ORDER, cursor, limit)
        files.append(len(got.inputFiles()))
        got = got.collect()
        seen += got[:limit]
        if len(got) <= limit:
            return seen, files
        cursor = (got[limit - 1]["created_at"], got[limit - 1]["run_id"])


def test_pages_read_few_files(spark, tmp_path):
    """Ties in time, null times and all pages in turn: each row once, in order, by two files a page."""
    frame = rows(spark, 1000)
    keyset.lay_out(frame, f"{tmp_path}/t", ORDER, file_rows=50)
    assert spark.read.parquet(f"{tmp_path}/t/index").count() >= 15
    seen, files = walk(spark, f"{tmp_path}/t", frame, 20)
    assert [r["run_id"] for r in seen] == [r["run_id"] for r in frame.orderBy(*(F.desc(k) for k in ORDER)).collect()]
    assert len(seen) == 1000 and max(files) <= 3


def test_files_smaller_than_a_page_and_empty_tables(spark, tmp_path):
    frame = rows(spark, 60)
    keyset.lay_out(frame, f"{tmp_path}/t", ORDER, file_rows=3)
    seen, _ = walk(spark, f"{tmp_path}/t", frame, 20)
    assert [r["run_id"] for r in seen] == [r["run_id"] for r in frame.orderBy(*(F.desc(k) for k in ORDER)).collect()]
    keyset.lay_out(frame.where("false"), f"{tmp_path}/e", ORDER)
    assert keyset.page(spark, f"{tmp_path}/e", frame.schema, ORDER).count() == 0
    assert keyset.page(spark, f"{tmp_path}/t", frame.schema, ORDER, (None, -1)).count() == 0


def test_row_groups_are_left_out_by_the_cursor(spark, tmp_path):
    frame = rows(spark, 100)
    keyset.lay_out(frame, f"{tmp_path}/t", ORDER)
    plan = keyset.page(spark, f"{tmp_path}/t", frame.schema, ORDER, (START + timedelta(minutes=90), 5))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan
