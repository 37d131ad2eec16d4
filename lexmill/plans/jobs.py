"""Job queries: an event is an update of the job of its user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from .registry import query, table

STATES = "st AS (SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(value) AS progress, count(*) AS n_updates, epoch_us(min(ts)) AS created, epoch_us(max(ts)) AS updated FROM events GROUP BY user_id)"
RUNNING = ["click", "view"]


def updates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("value").alias("progress"), "ts", F.col("event_id").alias("seq"))


def micros(df):
    return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("created", "updated")})


@query(f"WITH {STATES} SELECT * FROM st")
def job_states(spark, sf_dir):
    return micros(jobs.job_states(updates(spark, sf_dir)))


@query(f"WITH {STATES}, d AS (SELECT * FROM st WHERE status NOT IN ('click', 'view') ORDER BY created DESC, job_id DESC LIMIT 10) SELECT * FROM st WHERE status IN ('click', 'view') UNION ALL SELECT * FROM d")
def recent_jobs(spark, sf_dir):
    return micros(jobs.recent_jobs(jobs.job_states(updates(spark, sf_dir)), RUNNING))
