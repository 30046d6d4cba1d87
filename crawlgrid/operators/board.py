"""I8, I9 (and U1): job runtimes and the jobs board (pending ∪ running ∪ recent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrid.constants import RECENT_FINISHED
from crawlgrid.operators.history import recent_finished


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end``; NULL if either is NULL."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("SECOND", s, e)


def job_runtimes(queue: DataFrame, history: DataFrame) -> DataFrame:
    """I8: running/stopping jobs: update − start; finished: complete − start."""
    q = queue.where(F.col("status").isin(1, 5)).select(
        F.col("id").alias("job_id"), F.lit("queue").alias("source"), "status",
        seconds_between("start_time", "update_time").alias("runtime_s"))
    h = history.select(
        F.col("id").alias("job_id"), F.lit("history").alias("source"), "status",
        seconds_between("start_time", "complete_time").alias("runtime_s"))
    return q.unionByName(h)


def jobs_board(queue: DataFrame, history: DataFrame, k: int = RECENT_FINISHED) -> DataFrame:
    """One listing of pending, running and the k latest finished jobs."""
    cols = ["job_id", "spider_id", "project_name", "spider_name", "status", "fire_time", "start_time"]

    def part(df, section, end, runtime):
        return df.select(F.lit(section).alias("section"), F.col("id").alias("job_id"), *cols[1:],
                         F.col(end).alias("end_time"), runtime.cast("long").alias("runtime_s"))

    pend = part(queue.where(F.col("status") == 0), "pending", "update_time", F.lit(None))
    run = part(queue.where(F.col("status") == 1), "running", "update_time",
               seconds_between("start_time", "update_time"))
    fin = part(recent_finished(history, k), "finished", "complete_time",
               seconds_between("start_time", "complete_time"))
    return pend.unionByName(run).unionByName(fin)
