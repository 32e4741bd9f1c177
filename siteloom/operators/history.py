"""Scan history: earlier scans, score lists and trends, the dashboard, pages of results, due
schedules. runs: (site, run_id, created_at, status, score, p0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions.text import round_half_up

c = F.col
ORDER = ["created_at", "run_id"]


def latest(runs: DataFrame) -> DataFrame:
    """The newest run of each site."""
    keys = [k for k in runs.columns if k != "site"]
    return runs.groupBy("site").agg(F.max_by(F.struct(*keys), F.struct(*ORDER)).alias("x")).select("site", "x.*")


def previous(runs: DataFrame) -> DataFrame:
    """Each finished run with the latest finished run of its site before it."""
    back = Window.partitionBy("site").orderBy(*ORDER)
    done = runs.where("status = 'SUCCEEDED'")
    return done.withColumns({"previous_run": F.lag("run_id").over(back), "previous_score": F.lag("score").over(back)})


def score_history(runs: DataFrame, depth: int = 9) -> DataFrame:
    """(site, run_id, created_at, score, place): the newest finished run and up to depth before
    it, oldest first; sites with fewer than two have none."""
    kept = recent(runs.where("status = 'SUCCEEDED'"), depth + 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site")))
    return kept.where("n >= 2").withColumn("place", c("n") - c("back")).select("site", "run_id", "created_at", "score", "place")


def recent(runs: DataFrame, most: int) -> DataFrame:
    """The newest runs of each site, with back, their place from the newest. The limit is a
    constant, so Spark keeps that many rows of a site before it shuffles."""
    newest = Window.partitionBy("site").orderBy(*(F.desc(k) for k in ORDER))
    return runs.withColumn("back", F.row_number().over(newest)).where(c("back") <= most)


def schedule_list(schedules: DataFrame, runs: DataFrame, enabled_only: bool = False, limit: int = 20, depth: int = 10) -> DataFrame:
    """The newest schedules, at most 100, each with its site's newest runs (run_id, created_at,
    status, score), newest first. schedules: (schedule_id, site, enabled, created_at, ...)."""
    if enabled_only:
        schedules = schedules.where("enabled")
    shown = schedules.orderBy(F.desc("created_at"), F.desc("schedule_id")).limit(min(limit, 100))
    last = recent(runs.join(F.broadcast(shown.select("site").distinct()), "site", "left_semi"), depth)  # 100 sites at most
    lists = last.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("back", "run_id", "created_at", "status", "score"))), lambda x: F.struct(x["run_id"], x["created_at"], x["status"], x["score"])).alias("runs"))
    return shown.join(lists, "site", "left")


def sparkline(history: DataFrame) -> DataFrame:
    """Adds low and high, the bounds of the drawing, and y, the score's share of the height."""
    site = Window.partitionBy("site")
    low, high = F.greatest(F.lit(0), F.min("score").over(site) - 5), F.least(F.lit(100), F.max("score").over(site) + 5)
    scaled = history.withColumns({"low": low, "high": high})
    return scaled.withColumn("y", (c("score") - c("low")) / F.when(c("high") == c("low"), 1).otherwise(c("high") - c("low")))


def trends(runs: DataFrame) -> DataFrame:
    """(site, delta): the newest finished score less the one before it."""
    last = previous(runs).groupBy("site").agg(F.max_by(c("score") - c("previous_score"), F.struct(*ORDER)).alias("delta"))
    return last.where("delta IS NOT NULL")


def dashboard(runs: DataFrame) -> DataFrame:
    """One row: mean of the latest scores, improving and declining sites, critical issues."""
    good = latest(runs).where("status = 'SUCCEEDED' AND score IS NOT NULL")
    stats = good.agg(round_half_up(F.avg("score")).alias("avg_score"), F.coalesce(F.sum("p0"), F.lit(0)).alias("total_p0"))
    moves = trends(runs).agg(F.count_if(c("delta") > 0).alias("improving"), F.count_if(c("delta") < 0).alias("declining"))
    return stats.crossJoin(moves)  # one row each


def page(runs: DataFrame, cursor: tuple | None = None, limit: int = 20) -> DataFrame:
    """The next runs after a cursor (created_at, run_id), newest first; one more than limit, at
    most 51, tells whether there are others."""
    if cursor:
        at, ident = F.lit(cursor[0]), F.lit(cursor[1])
        runs = runs.where((c("created_at") < at) | ((c("created_at") == at) & (c("run_id") < ident)))
    return runs.orderBy(*(F.desc(k) for k in ORDER)).limit(min(limit, 50) + 1)


def due(schedules: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """Enabled schedules whose next run has come, the longest waiting first."""
    return schedules.where(c("enabled") & (c("next_run_at") <= now)).orderBy("next_run_at", "schedule_id").limit(limit)


def spend_quota(leads: DataFrame, requests: DataFrame, default: int = 3) -> DataFrame:
    """(email, left): each lead's quota less its requests, 0 at least; new leads start with the
    default. Addresses are compared in lower case."""
    asked = requests.groupBy(F.lower(F.trim("email")).alias("email")).agg(F.count(F.lit(1)).alias("asked"))
    held = leads.select(F.lower(F.trim("email")).alias("email"), "quota")
    return asked.join(held, "email", "full").select("email", F.greatest(F.lit(0).cast("long"), F.coalesce("quota", F.lit(default)) - F.coalesce("asked", F.lit(0))).alias("left"))


def by_site(runs: DataFrame) -> DataFrame:
    """(site, runs, latest_run, latest_at, scores): each site's runs as one row, the newest site
    first in latest_at; scores are those of finished runs, oldest first, at most the last 50."""
    newest = Window.partitionBy("site").orderBy(*(F.desc(k) for k in ORDER))
    ranked = runs.withColumn("back", F.row_number().over(newest))
    done = F.when((c("status") == "SUCCEEDED") & (c("back") <= 50), F.struct(*ORDER, "score"))
    grouped = ranked.groupBy("site").agg(F.count(F.lit(1)).alias("runs"), F.max(F.struct(*ORDER)).alias("x"), F.array_sort(F.collect_list(done)).alias("s"))
    return grouped.select("site", "runs", c("x.run_id").alias("latest_run"), c("x.created_at").alias("latest_at"), F.transform("s", lambda v: v["score"]).alias("scores"))


def search(runs: DataFrame, term: str, column: str = "site") -> DataFrame:
    """Runs whose address holds the term, whatever its case."""
    return runs.where(F.contains(F.lower(c(column).cast("string")), F.lit(term.lower())))


def shared(runs: DataFrame, tokens: DataFrame, token: str) -> DataFrame:
    """The run that a share token names. tokens: (token, run_id)."""
    return runs.join(tokens.where(c("token") == token).select("run_id"), "run_id", "left_semi")


def active(schedules: DataFrame) -> DataFrame:
    return schedules.agg(F.count_if("enabled").alias("active"))
