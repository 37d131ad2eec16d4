"""The state of jobs, kept up to date from a stream of updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jobs import job_states

UPDATES = "job_id long, status string, progress double, ts timestamp, seq long"


def keep_states(updates: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the states that a batch changed to path/v=<batch>; `read_states` gives the whole. updates: a streaming DataFrame
    of job_id, status, progress, ts, seq. State is one row for each job; checkpoint is a folder that all executors share. A
    batch that is run again after a failure overwrites its own folder."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={n}")

    w = job_states(updates).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each job that `keep_states` has written."""
    written = spark.read.parquet(path)
    columns = [c for c in written.columns if c not in ("job_id", "v")]
    latest = written.groupBy("job_id").agg(F.max_by(F.struct(*columns), "v").alias("s"))
    return latest.select("job_id", *(F.col(f"s.{c}") for c in columns))
