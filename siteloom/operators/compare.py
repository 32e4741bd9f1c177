"""Comparing scans: new and resolved problems, differences of scores, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def p0_changes(current: DataFrame, previous: DataFrame, key: str = "pair_id") -> dict[str, DataFrame]:
    """new, resolved and unchanged critical issues of pairs of scans, by code and category.
    Repeats stay."""
    on = [key, "code", "category"]
    now, then = current.where("severity = 'P0'"), previous.where("severity = 'P0'")
    keys = lambda df: df.select(*on).distinct()
    return {"new": now.join(keys(then), on, "left_anti"), "resolved": then.join(keys(now), on, "left_anti"), "unchanged": now.join(keys(then), on, "left_semi")}


def diff_by_code(current: DataFrame, previous: DataFrame, key: str = "pair_id", order: str = "n") -> DataFrame:
    """(pair, code, status, severity): each code once, as fixed, new or persistent."""
    first = lambda df, name: df.groupBy(key, "code").agg(F.min_by("severity", order).alias(name))
    both = first(current, "now").join(first(previous, "before"), [key, "code"], "full")
    status = F.when(c("now").isNull(), "fixed").when(c("before").isNull(), "new").otherwise("persistent")
    return both.select(key, "code", status.alias("status"), F.coalesce("now", "before").alias("severity"))


def category_deltas(current: DataFrame, previous: DataFrame, key: str = "pair_id") -> DataFrame:
    """(pair, category, delta) of category scores; a category that one side lacks counts 0 there."""
    a, b = current.select(key, "category", c("score").alias("now")), previous.select(key, "category", c("score").alias("before"))
    return a.join(b, [key, "category"], "full").select(key, "category", (F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def alert_reasons(delta: Column, new_p0: Column, drop: int = 5, on_new_p0: bool = True) -> Column:
    """Why a comparison should raise an alert; empty if it shouldn't."""
    fell = F.when((delta < 0) & (F.abs(delta) >= drop), F.concat(F.lit("Score dropped by "), F.abs(delta).cast("string"), F.lit(" points")))
    new = F.when(F.lit(on_new_p0) & (new_p0 > 0), F.concat(new_p0.cast("string"), F.lit(" new critical issue(s) detected")))
    return F.array_compact(F.array(fell, new))
