"""Grades, colours, labels, relative ages and next run times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(x: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    out = None
    for least, name in bands:
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out.otherwise(rest)


def grade(score: Column) -> Column:
    return _bands(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def colour(score: Column) -> Column:
    return _bands(score, [(90, "#22c55e"), (75, "#84cc16"), (50, "#eab308"), (25, "#f97316")], "#ef4444")


def mail_grade(score: Column) -> Column:
    return _bands(score, [(90, "Excellent"), (75, "Good"), (50, "Needs Improvement")], "Critical")


def effort(x: Column) -> Column:
    return F.when(x <= 2, "Easy").when(x == 3, "Medium").otherwise("Hard")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "P0", 0).when(severity == "P1", 1).when(severity == "P2", 2).when(severity == "P3", 3).otherwise(4)


def impact_score(impact: Column) -> Column:
    """Score of an accessibility violation's impact."""
    return F.when(impact == "critical", 5).when(impact == "serious", 4).when(impact == "moderate", 3).otherwise(2)


def impact_severity(impact: Column) -> Column:
    return F.when(impact == "critical", "P0").when(impact == "serious", "P1").when(impact == "moderate", "P2").otherwise("P3")


def next_run(frequency: Column, start: Column) -> Column:
    """Next 06:00 UTC run: daily, next Monday, or (as months overflow) the 1st of the month that
    a month after start falls in."""
    day = F.to_date(start)
    at6 = lambda d: F.to_timestamp(F.concat(d.cast("string"), F.lit(" 06:00:00")))
    daily = F.when(start >= at6(day), at6(F.date_add(day, 1))).otherwise(at6(day))
    first = F.add_months(F.trunc(day, "MM"), 1)
    overflow = F.dayofmonth(day) > F.dayofmonth(F.last_day(first))
    monthly = at6(F.when(overflow, F.add_months(first, 1)).otherwise(first))
    return F.when(frequency == "DAILY", daily).when(frequency == "WEEKLY", at6(F.next_day(day, "MON"))).when(frequency == "MONTHLY", monthly)


def time_ago(then: Column, now: Column) -> Column:
    s = F.floor((F.unix_micros(now) - F.unix_micros(then)) / 1_000_000).cast("long")
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).otherwise(ago(86400, "d"))


def until(then: Column, now: Column) -> Column:
    h = F.floor((F.unix_micros(then) - F.unix_micros(now)) / 3_600_000_000).cast("long")
    return F.when(then < now, "Overdue").when(h < 24, F.concat(F.lit("in "), h.cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("in "), F.floor(h / 24).cast("string"), F.lit("d")))
