"""Jobs as a table of updates: the state of each job, and what a list of jobs shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def job_states(updates: DataFrame) -> DataFrame:
    """job_id, status, progress, n_updates, created, updated. updates: job_id, status, progress, ts, seq. The latest update
    that has a status sets it, ties to the higher seq; progress never goes back. One map-side combined aggregation, which
    also runs on a stream. A job whose updates all lack a status has a null one."""
    at = F.struct("ts", "seq")
    return updates.groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"),
        F.max("progress").alias("progress"),
        F.count(F.lit(1)).alias("n_updates"),
        F.min("ts").alias("created"),
        F.max("ts").alias("updated"),
    )


def recent_jobs(states: DataFrame, running: list[str], last: int = 10) -> DataFrame:
    """All running jobs and the `last` others, by creation and then job_id. The window has no key, but Spark limits ranks
    within each partition first, so that a task sorts `last` rows of each partition and no more."""
    is_running = F.coalesce(F.col("status").isin(running), F.lit(False))
    place = F.row_number().over(Window.orderBy(F.desc("created"), F.desc("job_id")))
    done = states.where(~is_running).withColumn("__place", place).where(F.col("__place") <= last).drop("__place")
    return states.where(is_running).unionByName(done)
