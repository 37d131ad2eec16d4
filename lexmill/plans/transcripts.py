"""Transcript queries: a conversation is a transcript, a turn a line that starts seven seconds after the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import transcripts
from .registry import query, table


@query()
def transcript_sentences(spark, sf_dir):
    """The cut of long sentences depends on the cuts before it: tested on literal cases."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(T.format_timestamp(F.col("turn") * 7.0), F.lit(" "), T.squeezed(F.col("text")))
    return transcripts.sentences(c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("n"), line.alias("line"))).withColumn("sec", F.round("sec", 6))
